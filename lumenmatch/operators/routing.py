"""Routing of resolved matches into collection rows and review rows, and their writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import merged

MONEY = "decimal(18,4)"


def route(resolved: DataFrame) -> DataFrame:
    """resolved (scan_id, ..) plus target: collection for a scan's only match, else attention."""
    n = F.count("*").over(Window.partitionBy("scan_id"))
    return resolved.withColumn("target", F.when(n == 1, "collection").otherwise("attention"))


def unmatched(scans: DataFrame, resolved: DataFrame) -> DataFrame:
    """Scans without any match: the reject sink of the router."""
    return scans.join(merged(resolved.select("scan_id").distinct()), "scan_id", "left_anti").withColumn("error", F.lit("No matches found"))


def est_value(usd: Column, quantity: Column) -> Column:
    """Price (text or number) times quantity with four places; null if the price is no number."""
    return F.round(usd.try_cast(MONEY) * quantity, 4).cast(MONEY)


def quantity_of(rows: DataFrame, collection: DataFrame) -> DataFrame:
    """rows (name, set_name) plus quantity in the collection, 0 where absent."""
    have = collection.groupBy("name", "set_name").agg(F.sum("quantity").cast("long").alias("quantity"))
    return rows.join(have, ["name", "set_name"], "left").withColumn("quantity", F.coalesce("quantity", F.lit(0).cast("long")))


def detail_of(printings: DataFrame) -> DataFrame:
    """One printing per name, the one with the smallest id: name, magic_id, usd, type_line, image_url."""
    cols = [c for c in ("magic_id", "usd", "type_line", "image_url") if c in printings.columns]
    best = printings.groupBy("name").agg(F.min_by(F.struct(*cols), "magic_id").alias("d"))
    return best.select("name", "d.*")


def collection_rows(routed: DataFrame, collection: DataFrame, printings: DataFrame) -> DataFrame:
    """The scans with one match, enriched: scan_id, name, set_name, quantity, magic_id, est_value, ..."""
    r = routed.where(F.col("target") == "collection").select("scan_id", "name", F.get("sets", F.lit(0)).alias("set_name"))
    r = quantity_of(r, collection).join(detail_of(printings), "name", "left")
    return r.withColumn("est_value", est_value(F.col("usd"), F.col("quantity"))).withColumn("automated", F.lit(True))


def attention_rows(routed: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per match of the other scans, with what was read and the possible sets as text."""
    r = routed.where(F.col("target") == "attention").select("scan_id", "name", F.array_join("sets", ",").alias("possible_sets"))
    return r.join(merged(scans), "scan_id")


def collection_upsert(collection: DataFrame, new: DataFrame) -> DataFrame:
    """collection (name, set_name, quantity) with one more of each new (name, set_name) row."""
    more = new.where(F.col("set_name").isNotNull()).select("name", "set_name", F.lit(1).cast("long").alias("quantity"))
    both = collection.select("name", "set_name", F.col("quantity").cast("long").alias("quantity")).unionByName(more)
    return both.groupBy("name", "set_name").agg(F.sum("quantity").alias("quantity"))


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, one per key, whose key the target lacks; null is a key value like others."""
    n, t = new.dropDuplicates(keys).alias("n"), target.select(*keys).distinct().alias("t")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return n.join(t, same, "left_anti")


def audited(rows: DataFrame, writer: str = "lumenmatch") -> DataFrame:
    """rows with the audit columns that every table has."""
    now = F.current_timestamp()
    return rows.withColumns({"created_at": now, "updated_at": now, "created_by": F.lit(writer), "updated_by": F.lit(writer)})


def transaction_log(rows: DataFrame, table: str, kind: str, key: str, successful: bool) -> DataFrame:
    """One audit row per row of a write: transaction_type, is_successful, table_name, pk."""
    return rows.select(F.lit(kind).alias("transaction_type"), F.lit(successful).alias("is_successful"), F.lit(table).alias("table_name"), F.col(key).alias("pk"))
