"""Fuzzy dictionary lookup: n-gram cosine shortlist, edit-distance re-rank, confidence policy.

Queries are looked up once per distinct text, in an index of the dictionary's grams (grams.py),
so no pair without a common gram is ever formed. Ranks are windows per query text with a limit,
which Spark prunes before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import materialize, merged
from ..functions.text import edit_similarity
from .grams import SHORTLIST, GramIndex, index_of, nearest

# Fixed values of the lookup and its policy.
SIZES = (3, 2)
MIN_SCORE = 0.33
HIGH = 0.95
LOW = 0.70
MAX_MATCHES = 5


def dictionary_of(names: DataFrame, col: str = "name") -> DataFrame:
    """Distinct names by lower case, the first in text order of each: name."""
    return names.where(F.col(col).isNotNull()).groupBy(F.lower(F.col(col)).alias("_l")).agg(F.min(col).alias("name")).select("name")


def shortlist(texts: DataFrame, dictionary: DataFrame, n: int, keep: int = SHORTLIST) -> DataFrame:
    """texts (text) and dictionary (name) -> text, name, cos, cos_rank: the nearest by n-gram cosine."""
    return nearest(texts, index_of(dictionary, n), keep)


def _ranked(texts: DataFrame, index: GramIndex) -> DataFrame:
    s = nearest(texts, index).withColumn("score", edit_similarity(F.col("text"), F.col("name")))
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "cos_rank"))
    return s.withColumn("rank", rank).where(F.col("score") >= MIN_SCORE).select("text", "name", "score", "rank")


def lookup(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """texts (text) -> text, name, score, rank. Grams of 2 are tried only where grams of 3 give nothing."""
    return _lookup(texts, [lambda n=n: index_of(dictionary, n) for n in SIZES])


def lookup_in(texts: DataFrame, *indexes: GramIndex) -> DataFrame:
    """texts (text) -> text, name, score, rank, by the first of the indexes that gives a text anything."""
    return _lookup(texts, [lambda i=i: i for i in indexes])


def _lookup(texts: DataFrame, indexes: list[Callable[[], GramIndex]]) -> DataFrame:
    texts = materialize(texts.select("text").where(F.col("text").isNotNull()).distinct())
    out = materialize(_ranked(texts, indexes[0]()))
    for make in indexes[1:]:
        texts = materialize(texts.join(out.select("text").distinct(), "text", "left_anti"))
        if texts.isEmpty():
            break
        out = out.unionByName(_ranked(texts, make()))
    return out


def lookup_one(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The best name of each text: text, name, score; an empty text has none."""
    return lookup(texts.where(F.col("text") != ""), dictionary).where(F.col("rank") == 1).drop("rank")


def fuzzy_topk(scans: DataFrame, dictionary: DataFrame) -> DataFrame:
    """scans (scan_id, text) -> scan_id, text, name, score, rank; scans without a hit have no row."""
    return scans.join(merged(lookup(scans, dictionary)), "text").select("scan_id", "text", "name", "score", "rank")


def confidence_policy(matches: DataFrame, key: str = "scan_id", max_matches: int = MAX_MATCHES) -> DataFrame:
    """Keep only scores >= HIGH where a key has more than one of them, else all >= LOW; at most max_matches + 1."""
    high = F.sum(F.when(F.col("score") >= HIGH, 1).otherwise(0)).over(Window.partitionBy(key))
    kept = matches.withColumn("_high", high).where(F.col("score") >= F.when(F.col("_high") > 1, HIGH).otherwise(LOW))
    order = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    return kept.withColumn("_n", order).where(F.col("_n") <= max_matches + 1).drop("_high", "_n")
