import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from lumenmatch.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int, v int, cluster int, centroid string"


def brute(rows, k=8, rounds=10):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(1024 * float(np.float32(c))) for c in x]))
    order = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        for j, g in groups.items():
            cents[j] = [sum(c) // len(g) for c in zip(*g)]
    found = [(i, *near(x)) for i, x in kept]
    inertia = sum(d for _, d, _ in found)
    of = lambda j: sum(d for _, d, y in found if y == j)
    return sorted(((i, j, d, of(j), inertia, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def answer(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, x, 1, 2, 3, "c") for i, x in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op13_centroid_clustering(spark, str(tmp_path))
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert out.columns == cols
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(n, seed=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [float(np.float32(c + r.gauss(0, 0.3))) for c in r.choice(centres)]) for i in range(n)]


def test_clusters_equal_brute_force(spark, tmp_path):
    rows = vectors(150)
    rows += [(200, None), (201, [1.0] * 63), (202, [None] + [1.0] * 63), (203, [float("nan")] * 64), (204, [float("inf")] * 64), (205, [])]
    rows += [rows[0], rows[0], (None, rows[3][1]), *[(300 + i, rows[7][1]) for i in range(120)]]
    assert answer(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 9])
def test_few_vectors(spark, tmp_path, n):
    rows = vectors(n)
    assert answer(spark, rows, tmp_path) == brute(rows)


def test_equal_vectors_make_one_cluster(spark, tmp_path):
    rows = [(i, [0.25] * 64) for i in range(20)]
    got = answer(spark, rows, tmp_path)
    assert got == brute(rows) and {r[1] for r in got} == {0}


def test_too_large_components_fail(spark, tmp_path):
    with pytest.raises(PySparkException, match="too large"):
        answer(spark, [(1, [1e9] * 64)], tmp_path)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    x = np.floor(1024 * (r.normal(0, 1, (12, 64))[r.integers(0, 12, 500)] + r.normal(0, 0.1, (500, 64)))).astype(np.int64)
    simplex = centroids.Simplex.of(np.vstack([x[:10], x[:3], x[10:16]]))
    assert len(simplex.pivots) <= 16
    c = x[300:308]
    apex = simplex.project(x.astype(float))
    low, high = centroids.bounds(apex, simplex.project(c.astype(float)))
    exact = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()
    which, d, compared = centroids.nearest(x, apex, c, simplex)
    assert (which == exact.argmin(1)).all() and (d == exact.min(1)).all() and compared < 500 * 8 / 2
