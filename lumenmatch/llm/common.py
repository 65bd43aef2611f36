"""Small helpers shared by the corpus operators.

Every operator takes the names of the columns it reads and selects only those under names
of its own; where a table keeps all its columns, joined ones get names it does not have.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import BROADCAST_ROWS, clear, forget, free_shuffles, materialize, shared_folder, small_side, table

__all__ = ["clear", "forget", "free_shuffles", "materialize", "shared_folder", "small_side", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
NOT_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def private(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of docs has."""
    used = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out


def counted_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """df, written once, and whether its counted rows are at most max_rows; if so it has a broadcast hint."""
    kept = materialize(df)
    small = kept.count() <= max_rows
    return (F.broadcast(kept) if small else kept), small


def join_skewed(rows: DataFrame, names: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """rows left-joined with names (key, ..; keys distinct and none null), where one key may be in very many rows.

    Keys in more than this share of the rows are at most 1 / share; their names are broadcast,
    and only the other rows are shuffled by the key.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > share * rows.count()).select(key)
    hot = F.broadcast(materialize(hot))
    often = rows.join(hot, key, "left_semi").join(F.broadcast(names.join(hot, key, "left_semi")), key, "left")
    return often.unionByName(rows.join(hot, key, "left_anti").join(names, key, "left"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, whole texts go to Python in batches of at most so many rows; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_key(text: Column) -> Column:
    """A hash that tells texts apart where ids repeat; null is like the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Words between runs of space and \\t..\\r; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def plain_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and all non-ASCII characters; null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD_RUN), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
