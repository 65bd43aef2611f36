"""Readers: names and printings from catalog JSON, dictionaries, images, tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import materialize
from ..functions.text import extension
from ..schemas import CARD

_ENVELOPE = f"data array<struct<{CARD}>>"


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Catalog envelopes {data: [name, ..]} -> name; empty files give no rows."""
    d = spark.read.schema("data array<string>").json(path, multiLine=True)
    return d.select(F.explode("data").alias("name"))


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """List envelopes {data: [card, ..]}, all pages under path, as flat printings."""
    return printings_of(spark.read.schema(_ENVELOPE).json(path, multiLine=True).select(F.explode("data").alias("c")).select("c.*"))


def printings_of(cards: DataFrame) -> DataFrame:
    """Cards -> name, set_name, type_line, magic_id, is_foil, is_promo, image_url, usd; a missing or empty image falls back."""
    url = F.coalesce(F.nullif(F.col("image_uris.normal"), F.lit("")), F.col("image_uris.large"))
    return cards.select(
        "name", "set_name", "type_line", F.col("tcgplayer_id").alias("magic_id"), F.coalesce("foil", F.lit(False)).alias("is_foil"),
        F.coalesce("promo", F.lit(False)).alias("is_promo"), url.alias("image_url"), F.col("prices.usd").alias("usd"),
    )


def parse_cards(rows: DataFrame, column: str) -> DataFrame:
    """Cards as JSON text in a column -> flat printings; text that does not parse gives nulls."""
    return printings_of(rows.select(F.from_json(column, CARD).alias("c")).select("c.*"))


def parse_checked(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Cards as JSON text in a column -> (flat printings, the rows whose text is no card, with it as it was)."""
    c = F.from_json(column, f"{CARD}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = rows.where(F.col(column).isNotNull()).withColumn("_c", c)
    bad = F.col("_c").isNull() | F.col("_c._corrupt").isNotNull()
    return printings_of(parsed.where(~bad).select("_c.*")), parsed.where(bad).drop("_c")


def read_cards_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """List envelopes as read_cards has them -> (flat printings, path and text of files that are no envelope)."""
    options = {"multiLine": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    d = spark.read.schema(f"{_ENVELOPE}, _corrupt string").options(**options).json(path).select("*", F.col("_metadata.file_path").alias("path"))
    d = materialize(d)
    cards = d.where(F.col("_corrupt").isNull()).select(F.explode("data").alias("c")).select("c.*")
    return printings_of(cards), d.where(F.col("_corrupt").isNotNull()).select("path", F.col("_corrupt").alias("text"))


def read_bulk_cards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A catalogue in one large file, an array with a card a line or JSON lines -> (flat printings, path and text of bad lines).

    Lines are split among tasks, however large the file is.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.trim("value"), ",$", "").alias("text"))
    return parse_checked(lines.where(~F.col("text").isin("", "[", "]")), "text")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("name")


def read_vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """Closed vocabularies as JSON lines {kind, names: [..]} -> kind, name, without repeats."""
    d = spark.read.schema("kind string, names array<string>").json(path)
    return d.select("kind", F.explode("names").alias("name")).distinct()


def vocabulary(words: DataFrame, kind: str) -> DataFrame:
    """The words (kind, name) of one kind: name."""
    return words.where(F.col("kind") == kind).select("name").distinct()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; unreadable files are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path)


def read_images_checked(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Images by path -> (decoded images, path and error of those that are no image)."""
    images = materialize(spark.read.format("image").option("dropInvalid", False).load(paths))
    bad = F.col("image.height") <= 0
    return images.where(~bad), images.where(bad).select(F.col("image.origin").alias("path"), F.lit("No image").alias("error"))


def read_image_bytes(spark: SparkSession, path: str, suffix: str = "jpg") -> DataFrame:
    """Undecoded files with the suffix: path, content."""
    return spark.read.format("binaryFile").load(path).where(extension(F.col("path")) == suffix).select("path", "content")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational store; needs a driver jar on the class path (not tested here)."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def hashes_by_name(hashes: DataFrame, names: DataFrame) -> DataFrame:
    """Stored hashes of the given names."""
    return hashes.join(names.select("name").distinct(), "name", "left_semi").select("name", "card_hash", "set_name", "is_foil", "is_promo")


def image_results(results: DataFrame, name: str, set_name: str) -> DataFrame:
    """Stored image comparisons of one name and set."""
    found = results.where((F.col("name") == name) & (F.col("set_name") == set_name))
    return found.select("art_image", "flavor_image", "art_image_hash", "flavor_image_hash", "art_match_percent", "flavor_match_percent")
