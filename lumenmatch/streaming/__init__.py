"""Streams of scans through the batch plan, and into the tables once a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.recognition import recognise
from ..plans.store import store


def stream_scans(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """New Parquet files of scans under path, each micro-batch given to handle(batch, id); stops when all is read."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_into(
    spark: SparkSession, path: str, schema: str, checkpoint: str, database: str, name: str, dictionary: DataFrame, printings: DataFrame,
    stored: DataFrame, remote: DataFrame, collection: DataFrame,
):
    """Recognise new files of scans under path and write what is found into the tables of the database.

    A micro-batch that is run again after a failure has the same id, so its cards are added once;
    name tells the streams of a database apart.
    """

    def handle(batch: DataFrame, number: int) -> None:
        written = store(spark, recognise(batch, dictionary, printings, stored, remote, collection), database, f"{name}-{number}")
        failed = {table: w.error for table, w in written.items() if not w.done}
        if failed:
            raise RuntimeError(f"batch {number}: {failed}")

    return stream_scans(spark, path, schema, handle, checkpoint)
