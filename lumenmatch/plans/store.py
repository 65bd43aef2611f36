"""The writes of a run: collection, review rows and fresh hashes go into the tables, each write into the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import materialize
from ..operators.routing import audited
from ..schemas import KEYS
from ..sources.audit import Written, log_write, logged
from ..sources.keyed import append_absent, absent_rows, upsert
from .recognition import Outcome

_COLLECTION = {"name": "card_name", "set_name": "card_set", "type_line": "card_type", "magic_id": "magic_id", "image_url": "image_url", "est_value": "est_value", "automated": "automated"}
_ATTENTION = {"name": "card_name", "text": "extracted_text", "dirty_text": "dirty_extracted_text", "possible_sets": "possible_sets"}
_IMAGES = ("name_image", "type_image", "art_image", "flavor_image")


def batch_id(scans: DataFrame) -> str:
    """An id that the same scans have again: a digest of all rows, in whatever order."""
    found = scans.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(scans.columns))).alias("x")).first()
    return f"{found.n}-{(found.x or 0) & (1 << 64) - 1:016x}"


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in names.items() if a in df.columns])


def store(spark: SparkSession, outcome: Outcome, database: str, batch: str) -> dict[str, Written]:
    """Write what a run found; the same batch again changes nothing. A write that fails is logged, the others go on."""
    out: dict[str, Written] = {}
    cards = _named(outcome.collection.where(F.col("set_name").isNotNull()), _COLLECTION).withColumn("quantity", F.lit(1))
    out["card_catalog"] = _upserted(spark, database, materialize(audited(cards)), batch)
    texts = outcome.attention
    seen = _named(texts, _ATTENTION | {i: i for i in _IMAGES})
    if "dirty_extracted_text" not in seen.columns:
        seen = seen.withColumn("dirty_extracted_text", F.col("extracted_text"))
    for image in _IMAGES:
        seen = seen if image in seen.columns else seen.withColumn(image, F.lit(None).cast("string"))
    out["card_need_attn"] = _inserted(spark, database, "card_need_attn", seen)
    if outcome.fresh is not None:
        fresh = outcome.fresh
        url = F.col("card_url") if "card_url" in fresh.columns else F.lit(None).cast("string")
        out["card_hashes"] = _inserted(spark, database, "card_hashes", fresh.withColumn("card_url", url))
    return out


def _inserted(spark: SparkSession, database: str, table: str, rows: DataFrame) -> Written:
    keys, name = KEYS[table], f"{database}.{table}"
    absent = absent_rows(spark, name, audited(rows), keys)
    absent = absent.withColumn(spark.table(name).columns[0], F.xxhash64(*keys))
    return logged(spark, database, absent, lambda df: append_absent(spark, name, absent, keys, df), table, "insert", keys)


def _upserted(spark: SparkSession, database: str, rows: DataFrame, batch: str) -> Written:
    keys, name = KEYS["card_catalog"], f"{database}.card_catalog"
    try:
        changed = materialize(upsert(spark, name, rows.withColumn("card_id", F.xxhash64(*keys)), keys, batch))
    except Exception as error:  # whatever it was, it is logged
        written = Written(False, 0, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")
        log_write(spark, database, rows, written, "card_catalog", "upsert", keys)
        return written
    written = Written(True, changed.count())
    log_write(spark, database, changed, written, "card_catalog", "upsert", keys)
    return written
