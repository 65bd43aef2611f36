"""Table schemas as DDL, and the statements that create and empty the tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sources.keyed import create_keyed, truncate_keyed

_AUDIT = "created_at timestamp, updated_at timestamp, created_by string, updated_by string"

TABLES = {
    "card_hashes": f"card_hash_id bigint, name string, set_name string, is_foil boolean, is_promo boolean, card_hash string, card_url string, {_AUDIT}",
    "card_catalog": f"card_id bigint, card_name string, card_type string, card_set string, quantity int, est_value decimal(18,4), automated boolean, magic_id int, image_url string, batches array<string>, {_AUDIT}",
    "card_need_attn": f"item_id bigint, card_name string, extracted_text string, dirty_extracted_text string, name_image string, type_image string, art_image string, flavor_image string, possible_sets string, {_AUDIT}",
    "image_results": f"image_hash_id bigint, name string, set_name string, art_image string, flavor_image string, art_image_hash string, flavor_image_hash string, art_match_percent double, flavor_match_percent double, {_AUDIT}",
    "transactions": f"transaction_id bigint, transaction_type string, is_successful boolean, table_name string, pk bigint, {_AUDIT}",
}
#: Keys that are unique per table; inserts go through an anti-join on them.
KEYS = {
    "card_hashes": ["name", "set_name", "card_hash", "is_foil", "is_promo"],
    "card_catalog": ["card_name", "card_set"],
    "card_need_attn": ["card_name", "extracted_text", "name_image"],
    "image_results": ["name", "set_name"],
}
CARD = (
    "name string, set_name string, type_line string, tcgplayer_id bigint, foil boolean, promo boolean, "
    "image_uris struct<small:string,normal:string,large:string,png:string,art_crop:string,border_crop:string>, "
    "prices struct<usd:string,usd_foil:string,eur:string,tix:string>"
)


#: Buckets of a keyed table; a partition each, so that one is a few hundred MB.
BUCKETS = 32


def create_tables(spark: SparkSession, database: str = "default", buckets: int = BUCKETS) -> None:
    """The tables that are absent; keyed ones are partitioned by bucket (sources/keyed.py)."""
    for name, columns in TABLES.items():
        if name in KEYS:
            create_keyed(spark, f"{database}.{name}", columns, buckets)
        else:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def truncate_tables(spark: SparkSession, database: str = "default") -> None:
    """Empty all tables but the stored hashes, which are dear to compute."""
    for name in TABLES:
        if name in KEYS and name != "card_hashes":
            truncate_keyed(spark, f"{database}.{name}")
        elif name not in KEYS:
            spark.sql(f"TRUNCATE TABLE {database}.{name}")
