"""Type classification of texts against closed vocabularies by token-level fuzzy lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import has_space, space_tokens
from .fuzzy import lookup

# The base types and the thresholds of the classification.
BASE_TYPES = [
    "Artifact", "Conspiracy", "Creature", "Enchantment", "Instant", "Land", "Phenomenon", "Plane", "Planeswalker",
    "Scheme", "Sorcery", "Tribal", "Vanguard",
]
CREATURE = "Creature"
CREATURE_SCORE = 0.50
BASE_SCORE = 0.15


def token_hits(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """texts (id, text) -> id, pos, name, score, rank: lookups of the whole text, or of its tokens if it has blanks."""
    tokens = F.when(has_space(F.col("text")), space_tokens(F.col("text"))).otherwise(F.array("text"))
    t = texts.where(F.col("text") != "").select("id", F.posexplode(tokens).alias("pos", "token"))
    found = lookup(t.select(F.col("token").alias("text")), vocabulary)
    return t.join(found, t.token == found.text).select("id", "pos", "name", "score", "rank")


def base_types(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """All hits in token order: id, n (from 1), name, score."""
    order = F.row_number().over(Window.partitionBy("id").orderBy("pos", "rank"))
    return token_hits(texts, vocabulary).withColumn("n", order).select("id", "n", "name", "score")


def creature_first_hit(texts: DataFrame, creatures: DataFrame) -> DataFrame:
    """Best score of the first token with any hit: id, score."""
    hits = token_hits(texts, creatures).where(F.col("rank") == 1)
    return hits.groupBy("id").agg(F.min_by("score", "pos").alias("score"))


def match_type(texts: DataFrame, vocabulary: DataFrame, creatures: DataFrame) -> DataFrame:
    """One type per text: a creature by the base list, else by the creature list, else the first base hit; id, type, score."""
    base = base_types(texts, vocabulary)
    sure = (F.col("name") == CREATURE) & (F.col("score") >= CREATURE_SCORE)
    b = base.groupBy("id").agg(
        F.min_by(F.when(sure, F.col("score")), F.when(sure, F.col("n"))).alias("base_creature"),
        F.min_by(F.struct("name", "score"), "n").alias("first"),
    )
    c = creature_first_hit(texts, creatures).where(F.col("score") >= CREATURE_SCORE).withColumnRenamed("score", "list_creature")
    j = b.join(c, "id", "full")
    creature = F.coalesce("base_creature", "list_creature")
    usable = F.col("first.score") >= BASE_SCORE
    out = j.select(
        "id", F.when(creature.isNotNull(), F.lit(CREATURE)).otherwise(F.when(usable, F.col("first.name"))).alias("type"),
        F.coalesce(creature, F.when(usable, F.col("first.score"))).alias("score"),
    )
    return out.where(F.col("type").isNotNull())
