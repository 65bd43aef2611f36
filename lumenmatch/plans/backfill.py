"""Back-fill of stored hashes, and the per-set report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import materialize
from ..functions.text import extension
from ..operators.routing import audited
from ..operators.verify import new_hashes
from ..schemas import KEYS
from ..sources.keyed import insert_absent

#: Fixed value: names of a slice.
SLICE = 849


def numbered(dictionary: DataFrame) -> DataFrame:
    """name, place in text order from 0: numbered within ranges of names, after the counts of the ranges before."""
    parts = materialize(dictionary.select("name").repartitionByRange("name").withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))  # a row for each range
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("name")) - 1)
    return within.join(F.broadcast(counts.select("_p", before.alias("_b"))), "_p").select("name", (F.col("_b") + F.col("_n")).alias("place"))


def dictionary_slice(dictionary: DataFrame, start: int, stop: int) -> DataFrame:
    """Names at places start .. stop - 1 in text order."""
    return numbered(dictionary).where((F.col("place") >= start) & (F.col("place") < stop))


def hashable(printings: DataFrame) -> DataFrame:
    """Printings with a .jpg image; only the row without one is dropped."""
    return printings.where(extension(F.col("image_url")) == "jpg")


def backfill(names: DataFrame, printings: DataFrame, hashed: DataFrame, stored: DataFrame) -> DataFrame:
    """New rows for the stored hashes: hashed (image_url, hash) of the printings of the names."""
    p = hashable(printings.join(names.select("name").distinct(), "name", "left_semi"))
    rows = p.join(hashed.select("image_url", F.col("hash").alias("card_hash")), "image_url")
    rows = rows.select("name", "set_name", "card_hash", "is_foil", "is_promo", F.col("image_url").alias("card_url"))
    return new_hashes(rows, stored)


@dataclass(frozen=True)
class Ledger:
    """What became of the slices of a back-fill: rows (run, start, stop, state, names, hashed, at) appended under a path."""

    spark: SparkSession
    path: str
    schema = "run string, start long, stop long, state string, names long, hashed long, at timestamp"

    def note(self, run: str, start: int, stop: int, state: str, names: int = 0, hashed: int = 0) -> None:
        row = self.spark.createDataFrame([(run, start, stop, state, names, hashed)], self.schema.rsplit(",", 1)[0])
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:  # nothing was noted yet
            return self.spark.createDataFrame([], self.schema)

    def done(self, run: str) -> set[tuple[int, int]]:
        """The slices that are done; a row for each."""
        rows = self.rows().where((F.col("run") == run) & (F.col("state") == "done")).select("start", "stop").distinct().collect()
        return {(r.start, r.stop) for r in rows}


def run_backfill(
    dictionary: DataFrame, printings: DataFrame, hasher: Callable[[DataFrame], DataFrame], table: str, ledger: Ledger,
    slice_size: int = SLICE, most: int | None = None,
) -> int:
    """Hash the printings of all names slice by slice into the keyed table of stored hashes; the number of slices done now.

    hasher gives image_url, hash of the image_urls it is given. A run that stopped goes on with
    the slices that the ledger does not have as done, if the dictionary is the same, and with all if it
    changed. Printings whose image is stored are not hashed, so a slice that stopped half-way
    hashes only what is missing. most bounds the slices of this call.
    """
    spark = dictionary.sparkSession
    placed = materialize(numbered(dictionary))
    state = placed.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("name", "place")).alias("x")).first()
    run = f"{state.n}-{slice_size}-{(state.x or 0) & (1 << 64) - 1:016x}"
    todo = [(a, min(state.n, a + slice_size)) for a in range(0, state.n, slice_size)]
    have = ledger.done(run)
    todo = [s for s in todo if s not in have][:most]
    for start, stop in todo:
        names = materialize(placed.where((F.col("place") >= start) & (F.col("place") < stop)).select("name"))
        ledger.note(run, start, stop, "started", stop - start)
        stored = spark.table(table).join(names, "name", "left_semi")
        wanted = hashable(printings.join(names, "name", "left_semi")).select("image_url").distinct()
        missing = wanted.join(stored.select(F.col("card_url").alias("image_url")), "image_url", "left_anti")
        hashed = materialize(hasher(materialize(missing)))
        new = insert_absent(spark, table, audited(backfill(names, printings, hashed, stored)).withColumn("card_hash_id", F.xxhash64(*KEYS["card_hashes"])), KEYS["card_hashes"])
        ledger.note(run, start, stop, "done", stop - start, new.count())
    return len(todo)


def cards_by_set(hashes: DataFrame) -> DataFrame:
    """Rows per set, most first, ties by set downwards."""
    g = hashes.groupBy("set_name").agg(F.count(F.lit(1)).alias("cards_in_set"))
    return g.orderBy(F.desc("cards_in_set"), F.desc("set_name"))
