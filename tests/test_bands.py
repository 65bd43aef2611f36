import random

import pytest
from pyspark.sql import functions as F

from lumenmatch.functions import hashing
from lumenmatch.operators import verify


def changed(r, h, k):
    out = list(h)
    for i in r.sample(range(len(h)), min(k, len(h))):
        out[i] = r.choice("0123456789abcdef")
    return "".join(out)


@pytest.mark.parametrize("profile", [hashing.STORED, hashing.REMOTE, hashing.Profile(1.0, 1.0, 1.0), hashing.Profile(0.0, 0.0, 0.0)])
def test_banded_matches_equal_all_pairs(spark, profile):
    """Hashes of several lengths, also of two that are unlike, with few or many digits changed; nulls and empty ones."""
    r = random.Random(3)
    base = ["".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (64, 64, 32, 33, 63, 5, 2, 1)]
    stored = [(f"n{k % 2}", changed(r, h, d), f"s{k}{d}") for k, h in enumerate(base) for d in (0, 1, 2, 4, 8, 20)] + [("n0", None, "x"), ("n0", "", "y"), (None, base[0], "z")]
    scans = [(100 * k + d, f"n{k % 2}", changed(r, h, d)) for k, h in enumerate(base) for d in (0, 1, 3, 9, 30)] + [(1, "n0", None), (2, "n0", ""), (3, None, base[0]), (4, "n0", base[0][:60]), (5, "n0", base[0] + "ab")]
    a = spark.createDataFrame(scans, "id long, name string, hash string")
    b = spark.createDataFrame(stored, "name string, card_hash string, set_name string")
    scores = hashing.compare(F.col("hash"), F.col("card_hash"))
    every = a.join(b, "name").select("id", "set_name", *scores).where((F.col("two") >= profile.two) & (F.col("four") >= profile.four) & (F.col("string") >= profile.string))
    got = verify.hash_matches(a, b, profile, ["name"]).select("id", "set_name")
    assert sorted(map(tuple, got.collect())) == sorted((x.id, x.set_name) for x in every.collect())


def test_a_name_with_many_printings_is_compared_with_few(spark):
    n = 100_000
    b = spark.range(n).select(F.lit("n").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("card_hash"), F.col("id").cast("string").alias("set_name"))
    a = spark.range(0, n, 500).select("id", F.lit("n").alias("name"), F.overlay(F.sha2(F.col("id").cast("string"), 256), F.lit("00"), F.lit(9)).alias("hash"))
    pairs = verify.banded_pairs(a, b, hashing.STORED, ["name"])
    assert pairs.count() < 400  # of 200 scans x 100,000 printings
    found = verify.hash_matches(a, b, hashing.STORED, ["name"])
    assert found.where(F.col("id").cast("string") == F.col("set_name")).count() == found.count() == 200
