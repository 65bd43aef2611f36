"""Writes whose outcome is observed and logged: what was written, and whether it was."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import audited, transaction_log


@dataclass(frozen=True)
class Written:
    """The outcome of a write: whether it was done, the rows that passed into it, and the error if it failed."""

    done: bool
    rows: int
    error: str | None = None


def observed(rows: DataFrame, write: Callable[[DataFrame], None]) -> Written:
    """Run write(rows) and see what happens; the count is what the write itself read, not another pass."""
    seen = Observation()
    try:
        if rows.isEmpty():  # of no rows nothing is observed
            write(rows)
            return Written(True, 0)
        write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    except Exception as error:  # whatever it was, it is logged
        return Written(False, 0, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")
    return Written(True, seen.get["rows"])


def log_write(spark: SparkSession, database: str, rows: DataFrame, written: Written, table: str, kind: str, keys: list[str]) -> None:
    """A transaction row for each of the rows (written ones, or those of a write that failed)."""
    log = audited(transaction_log(rows.withColumn("_pk", F.xxhash64(*keys)), table, kind, "_pk", written.done))
    log = log.withColumn("transaction_id", F.xxhash64("transaction_type", "table_name", "pk", "created_at"))
    target = spark.table(f"{database}.transactions")
    picked = [(F.col(f.name) if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema]
    log.select(*picked).write.mode("append").insertInto(f"{database}.transactions")


def logged(
    spark: SparkSession, database: str, rows: DataFrame, write: Callable[[DataFrame], None], table: str, kind: str, keys: list[str],
) -> Written:
    """Write rows (written once before, so that the log tells of the same ones), then log what became of it."""
    written = observed(rows, write)
    log_write(spark, database, rows, written, table, kind, keys)
    return written
