"""Candidate printings of matched names and their verification by hash similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import merged, small_side
from ..functions.hashing import REMOTE, STORED, Profile, bands, parts, reaches
from .routing import insert_if_absent

GRAM = 3


def candidate_printings(matches: DataFrame, printings: DataFrame) -> DataFrame:
    """matches (.., name) with all printings of the name; matches without one stay, with nulls."""
    return matches.join(printings, "name", "left")


def names_containing(queries: DataFrame, printings: DataFrame) -> DataFrame:
    """queries (query) -> printings whose name contains the query, case-insensitive.

    A query meets the names on the rarest of its grams of GRAM characters (itself, if shorter).
    """
    grams = lambda text, n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    some = lambda text, n: F.when(F.length(text) >= n, grams(text, n)).otherwise(F.array().cast("array<string>"))
    name, asked = F.lower("name"), F.lower("query")
    every = F.array_distinct(F.concat(F.array(F.lit("")), *[some(name, n) for n in range(1, GRAM + 1)]))
    cut = printings.select("name").where(F.col("name").isNotNull()).distinct().select("name", F.explode(every).alias("_gram"))
    counts = cut.groupBy("_gram").agg(F.count("*").alias("_n"))
    keys = queries.select("query").where(F.col("query").isNotNull()).distinct()
    keys = keys.select("query", F.explode(F.when(F.length(asked) >= GRAM, F.array_distinct(some(asked, GRAM))).otherwise(F.array(asked))).alias("_gram"))
    keys = keys.join(counts, "_gram").groupBy("query").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    found = cut.join(small_side(keys), "_gram").where(F.contains(name, asked)).select("name", "query")
    return printings.join(found, "name").join(queries, "query").select(*printings.columns, *queries.columns)


def banded_pairs(scans: DataFrame, hashes: DataFrame, profile: Profile, keys: list[str]) -> DataFrame:
    """All pairs of scans (keys, hash, ..) and hashes (keys, card_hash, ..) that can reach the profile, each once.

    Of two hashes that do, one band is equal (hashing.bands), so they meet on (keys, band) in place
    of all hashes of the same keys. A pair that has several equal bands is taken at its first.
    Besides the columns of both: hash_parts, card_parts.
    """
    size = F.length("hash")
    asked = scans.where(size > 0).withColumns({"_size": size, "_bands": bands(F.col("hash"), size, profile), "hash_parts": parts(F.col("hash"))})
    sizes = asked.select(*keys, "_size").distinct()
    held = hashes.where(F.col("card_hash").isNotNull()).withColumn("card_parts", parts(F.col("card_hash"))).join(sizes, keys)
    held = held.withColumn("_held", bands(F.col("card_hash"), F.col("_size"), profile))
    # of the outer form no filter is inferred, which would work the bands out once more below the projections
    each = lambda df, c: df.select("*", F.posexplode_outer(c).alias("_k", "_band"))
    met = each(asked, "_bands").join(merged(each(held, "_held")), [*keys, "_size", "_k", "_band"])
    before = F.exists(F.arrays_zip(F.slice("_bands", F.lit(1), F.col("_k")), F.slice("_held", F.lit(1), F.col("_k"))), lambda z: z["0"] == z["1"])
    return met.where((F.col("_k") == 0) | ~before).drop("_size", "_bands", "_held", "_k", "_band")


def hash_matches(scans: DataFrame, hashes: DataFrame, profile: Profile, keys: list[str]) -> DataFrame:
    """scans (keys, hash) against hashes (keys, card_hash, set_name): rows whose three scores reach the profile."""
    pairs = banded_pairs(scans, hashes.select(*keys, "card_hash", "set_name"), profile, keys)
    return pairs.where(reaches(F.col("hash_parts"), F.col("card_parts"), profile)).select(*scans.columns, "set_name")


def matched_sets(
    scans: DataFrame, stored: DataFrame, remote: DataFrame, keys: list[str], id_cols: list[str], strict_db: bool = False,
) -> DataFrame:
    """Sets of stored hashes, then of remote ones, without repeats: id_cols, sets.

    Each kind is compared by its own profile. With strict_db a scan without a stored match gets none at all.
    Scans with the same keys and hash are compared once.
    """
    one = [*keys, "hash"]
    asked = scans.select(*one).distinct()

    def hits(df: DataFrame, profile: Profile, src: int) -> DataFrame:
        named = df.select(*keys, "card_hash", F.coalesce("set_name", F.lit("")).alias("set_name")).distinct()
        return hash_matches(asked, named, profile, keys).select(*one, F.col("set_name").alias("s"), F.lit(src).alias("src"))

    every = hits(stored, STORED, 0).unionByName(hits(remote, REMOTE, 1))
    per = every.groupBy(*one).agg(F.collect_set(F.struct("src", "s")).alias("_x"), F.min("src").alias("_lo"))
    back = scans.select(*dict.fromkeys([*id_cols, *one])).join(merged(per), one)
    g = back.groupBy(*id_cols).agg(F.array_sort(F.flatten(F.collect_set("_x"))).alias("x"), F.min("_lo").alias("lo"))
    out = g.select(*id_cols, "lo", F.array_distinct(F.transform("x", lambda x: x["s"])).alias("sets"))
    return (out.where(F.col("lo") == 0) if strict_db else out).drop("lo")


def new_hashes(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Hashes not stored yet, by name, set, hash, foil and promo."""
    keys = ["name", "set_name", "card_hash", "is_foil", "is_promo"]
    return insert_if_absent(stored, found, keys)


def dispatch(matches: DataFrame, printings: DataFrame) -> DataFrame:
    """matches (scan_id, name) -> also n_printings, only_set: none, one (taken as it is) or many (to be verified)."""
    counted = printings.groupBy("name").agg(F.count("*").alias("_n"), F.min("set_name").alias("_s"))
    j = matches.join(counted, "name", "left").withColumn("n_printings", F.coalesce("_n", F.lit(0)))
    how = F.when(F.col("n_printings") == 0, "none").when(F.col("n_printings") == 1, "one").otherwise("many")
    return j.select(*matches.columns, "n_printings", F.when(F.col("n_printings") == 1, F.col("_s")).alias("only_set"), how.alias("action"))


def resolve_sets(
    matches: DataFrame, printings: DataFrame, stored: DataFrame, remote: DataFrame, strict_db: bool = False,
) -> DataFrame:
    """matches (scan_id, name, hash) -> scan_id, name, sets. Only names with several printings are hash-verified."""
    d = dispatch(matches, printings)
    many = d.where(F.col("action") == "many").select("scan_id", "name", "hash")
    verified = matched_sets(many, stored, remote, ["name"], ["scan_id", "name"], strict_db)
    none = F.array().cast("array<string>")
    out = d.join(merged(verified), ["scan_id", "name"], "left")
    return out.select("scan_id", "name", F.when(F.col("action") == "one", F.array("only_set")).otherwise(F.coalesce("sets", none)).alias("sets"))
