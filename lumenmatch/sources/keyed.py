"""Keyed tables: rows dealt to buckets by a hash of their key, and writes that touch no more buckets than they must.

A keyed table is partitioned by ``bucket``. Beside it stands a table with a Bloom filter of the
keys of each bucket. An insert asks the filters first; keys that no filter knows are new, and
only buckets in which some key may be are read for an anti-join. An upsert reads and replaces
just the buckets of its rows. Other buckets keep their files.

Writes can be repeated. A filter learns its keys before the rows are appended, so a write that
was broken off leaves at most keys in a filter that are not in the table, which costs a read. An upsert
notes the id of its batch in each row it changes, in the same files; a batch that was
broken off between buckets is given again and changes only the rest. One writer at a time is
assumed for a table. Null is a key value like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import materialize

BITS_A_KEY = 12
PROBES = 4
LEAST_BITS = 1 << 10


def create_keyed(spark: SparkSession, table: str, columns: str, buckets: int, folder: str | None = None) -> None:
    """The table and the one of its filters, if absent; under folder, or in the warehouse if none is given."""
    at = lambda name: f"LOCATION '{folder}/{name}'" if folder else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, bucket int) USING parquet PARTITIONED BY (bucket) {at('rows')} TBLPROPERTIES ('buckets' = '{buckets}')")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table}_keys (n bigint, bits binary, bucket int) USING parquet PARTITIONED BY (bucket) {at('keys')}")


def truncate_keyed(spark: SparkSession, table: str) -> None:
    for name in (table, f"{table}_keys"):
        spark.sql(f"TRUNCATE TABLE {name}")


def buckets_of(spark: SparkSession, table: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {table} ('buckets')").first().value)


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _key_hash(keys: list[str]) -> Column:
    return F.xxhash64(F.lit(1), *keys, *[F.col(k).isNull() for k in keys])


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places of each key hash."""
    h = h.astype(np.int64).view(np.uint64)
    step = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _known(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Of the keys of a bucket those that its filter may know."""
    h = keys.column("h").to_numpy()
    maybe = np.zeros(len(h), bool)
    if filters.num_rows:
        held = np.frombuffer(filters.column("bits")[0].as_py(), np.uint8)
        at = _places(h, 8 * len(held))
        maybe = (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)
    return keys.filter(pa.array(maybe))


def _learned(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The filter of a bucket with more keys; one of its own size if there is none yet."""
    h = np.unique(keys.column("h").to_numpy())
    if not len(h):
        return filters
    if filters.num_rows:
        n, held = filters.column("n")[0].as_py(), np.frombuffer(filters.column("bits")[0].as_py(), np.uint8).copy()
    else:
        n, held = 0, np.zeros(max(LEAST_BITS, 1 << (2 * BITS_A_KEY * len(h) - 1).bit_length()) // 8, np.uint8)
    at = _places(h, 8 * len(held)).ravel()
    np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    row = {"n": [n + len(h)], "bits": [held.tobytes()], "bucket": keys.column("bucket")[:1].to_pylist()}
    return pa.table(row, pa.schema([("n", pa.int64()), ("bits", pa.binary()), ("bucket", pa.int32())]))


def _filters(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(f"{table}_keys").select("n", "bits", "bucket")


def _learn(spark: SparkSession, table: str, keys: list[str], new: DataFrame) -> None:
    """Give the filters the keys of new (bucket, h). A filter that gets too full is made anew from its bucket."""
    counts = new.groupBy("bucket").agg(F.count("*").alias("more")).join(_filters(spark, table), "bucket", "left")
    sized = counts.select("bucket", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"), (8 * F.length("bits")).alias("room")).collect()  # a row per bucket
    full = [r.bucket for r in sized if r.room is not None and BITS_A_KEY * r.n > r.room]
    have = _filters(spark, table).where(F.col("bucket").isin([r.bucket for r in sized]) & ~F.col("bucket").isin(full))
    again = spark.table(table).where(F.col("bucket").isin(full)).select("bucket", _key_hash(keys).alias("h"))
    every = new.select("bucket", "h").unionByName(again)
    learned = every.groupBy("bucket").cogroup(have.groupBy("bucket")).applyInArrow(_learned, "n bigint, bits binary, bucket int")
    _replace(spark, materialize(learned), f"{table}_keys")


def _replace(spark: SparkSession, rows: DataFrame, table: str) -> None:
    """Replace the buckets of the table that rows has, and no others."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        _picked(rows, spark.table(table)).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(name, before)


def _picked(rows: DataFrame, target: DataFrame) -> DataFrame:
    """The columns of target from rows, null where it has none; each bucket in one task."""
    have = {f.name: f.dataType for f in target.schema}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in have.items()]).repartition("bucket")


def absent_rows(spark: SparkSession, table: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows, one per key, those whose key the table lacks, with their bucket; written once."""
    fresh = rows.dropDuplicates(keys).withColumn("bucket", bucket(keys, buckets_of(spark, table)))
    fresh = materialize(fresh)
    asked = fresh.select("bucket", _key_hash(keys).alias("h"))
    doubtful = asked.groupBy("bucket").cogroup(_filters(spark, table).groupBy("bucket")).applyInArrow(_known, "bucket int, h long")
    touched = [r.bucket for r in doubtful.select("bucket").distinct().collect()]  # at most all bucket numbers
    if not touched:
        return fresh
    held = spark.table(table).where(F.col("bucket").isin(touched)).select("bucket", *keys).alias("t")
    same = [F.col("n.bucket") == F.col("t.bucket"), *[F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]]
    return materialize(fresh.alias("n").join(held, same, "left_anti"))


def append_absent(spark: SparkSession, table: str, rows: DataFrame, keys: list[str], watched: DataFrame | None = None) -> None:
    """Append what absent_rows gave; watched are the same rows, if the append itself is to be observed."""
    _learn(spark, table, keys, rows.select("bucket", _key_hash(keys).alias("h")))
    _picked(rows if watched is None else watched, spark.table(table)).write.mode("append").insertInto(table)


def insert_absent(spark: SparkSession, table: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows, one per key, whose key the table lacks; gives these."""
    absent = absent_rows(spark, table, rows, keys)
    append_absent(spark, table, absent, keys)
    return absent


def upserted_rows(spark: SparkSession, table: str, rows: DataFrame, keys: list[str], batch: str, add: str = "quantity") -> DataFrame:
    """The buckets that a batch changes as they will be, with ``changed`` for its own rows; written once.

    Rows with the same key are summed by ``add``, which is added to what the table has; of other
    columns the greatest value that is not null is taken. A row that the batch changed before
    stays as it is.
    """
    number = bucket(keys, buckets_of(spark, table))
    columns = [c for c in spark.table(table).columns if c not in (*keys, add, "bucket", "batches")]
    others = [F.max(c).alias(c) for c in columns if c in rows.columns]
    more = materialize(rows.groupBy(*keys).agg(F.sum(add).alias(add), *others).withColumn("bucket", number))
    touched = [r.bucket for r in more.select("bucket").distinct().collect()]
    held = spark.table(table).where(F.col("bucket").isin(touched)).alias("t")
    n, t = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"t.{c}"))
    same = [n("bucket") == t("bucket"), *[n(k).eqNullSafe(t(k)) for k in keys]]
    joined = held.join(more.alias("n"), same, "full")
    none = F.array().cast("array<string>")
    changed = n("bucket").isNotNull() & ~F.array_contains(F.coalesce(t("batches"), none), F.lit(batch))
    of = lambda c: F.when(changed, F.coalesce(n(c), t(c))).otherwise(t(c)) if c in rows.columns else t(c)
    out = joined.select(
        *[F.coalesce(t(k), n(k)).alias(k) for k in keys], F.coalesce(t("bucket"), n("bucket")).alias("bucket"), changed.alias("changed"),
        (F.coalesce(t(add), F.lit(0)) + F.when(changed, n(add)).otherwise(0)).alias(add), *[of(c).alias(c) for c in columns],
        F.when(changed, F.array_append(F.coalesce(t("batches"), none), F.lit(batch))).otherwise(t("batches")).alias("batches"),
    )
    out = materialize(out)
    return out.join(F.broadcast(out.where("changed").select("bucket").distinct()), "bucket", "left_semi")


def upsert(spark: SparkSession, table: str, rows: DataFrame, keys: list[str], batch: str, add: str = "quantity") -> DataFrame:
    """Add a batch to the table, once however often it is given; gives the rows that it changed."""
    out = materialize(upserted_rows(spark, table, rows, keys, batch, add))
    _learn(spark, table, keys, out.where("changed").select("bucket", _key_hash(keys).alias("h")))
    _replace(spark, out, table)
    return out.where("changed")
