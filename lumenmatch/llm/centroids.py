"""Exact centroid clustering of integer vectors, filtered by an n-simplex projection.

The distances of a vector to several pivots are computed once and turned into the coordinates
of an apex over the simplex of the pivots: all but the last coordinate are the vector's place
in the pivots' plane, the last is its height above it. Of two apexes the Euclidean distance,
with the heights subtracted or added, is a lower or an upper bound of the distance of the two
vectors. A round projects the few centroids alike, drops for each vector those whose lower
bound is above the least upper bound, and compares only the rest, in exact whole numbers.

Vectors and apexes are written once as packed rows. A round reads them, sums per task and
cluster, and brings one row per centroid to the driver. All sums are exact.

Defined results: a vector that is null, has another number of components, or one that is null
or not finite is left out. A component x becomes floor(scale * x), as long as that is below
2**26 in size, else the query fails. Rows that repeat an id are rows of their own; of equal
ids the starting order takes the smaller vector first, and null ids come last. Fewer vectors than
centroids give as many centroids as vectors. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

CLUSTERS = 8
ROUNDS = 10
PIVOTS = 16
SCALE = 1024
SIZE = 64
#: Whole numbers up to this size keep a squared distance of any row far inside a long.
LARGEST = 1 << 26
#: Bounds are widened by this share, far above what rounding can do to them.
SLACK = 1e-6


def whole_vectors(df: DataFrame, vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """df with v, the array of floor(scale * x); rows without a usable vector go."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = (F.size(vector_col) == size) & F.forall(F.col(vector_col), lambda x: finite(x.cast("double")))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fits = F.forall(whole, lambda x: F.abs(x) < LARGEST)
    error = F.raise_error(F.lit(f"a component is too large: its whole number must be below {LARGEST}"))
    return df.where(F.coalesce(good, F.lit(False))).withColumn("v", F.when(fits, whole).otherwise(error.cast("array<bigint>")))


@dataclass(frozen=True)
class Simplex:
    """Pivots and the coordinates of their simplex: row k is the apex of pivot k over those before it."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Simplex:
        """The simplex of those vectors that stand clear of the plane of the ones before."""
        pivots, rows = vectors[:1].astype(float), np.zeros((1, 0))
        for v in vectors[1:].astype(float):
            apex = cls(pivots, rows).project(v[None])[0]
            if apex[-1] > 0.05 * max(1.0, float(np.linalg.norm(v - pivots[0]))):
                rows = np.vstack([np.pad(rows, ((0, 0), (0, 1))), apex])
                pivots = np.vstack([pivots, v])
        return cls(pivots, rows)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Apexes of vectors, one row each: len(pivots) coordinates, the last is the height."""
        d = ((x[:, None, :] - self.pivots[None]) ** 2).sum(2)
        m = len(self.pivots)
        out = np.zeros((len(x), m))
        # plane coordinates from differences of squared distances, one pivot at a time
        for k in range(1, m):
            b = self.base[k]
            out[:, k - 1] = (d[:, 0] - d[:, k] + (b**2).sum() - 2 * out[:, : k - 1] @ b[: k - 1]) / (2 * b[k - 1])
        out[:, m - 1] = np.sqrt(np.maximum(0, d[:, 0] - (out[:, : m - 1] ** 2).sum(1)))
        return out


def bounds(apexes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, len(apexes) x len(others)."""
    plane = ((apexes[:, None, :-1] - others[None, :, :-1]) ** 2).sum(2)
    a, b = apexes[:, None, -1], others[None, :, -1]
    scale = SLACK * ((apexes**2).sum(1)[:, None] + (others**2).sum(1)[None] + 1)
    return plane + (a - b) ** 2 - scale, plane + (a + b) ** 2 + scale


def nearest(v: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Per vector the nearest centroid (the smaller number of equals), its squared distance, and how many were compared."""
    low, high = bounds(apexes, simplex.project(centroids.astype(float)))
    row, c = np.nonzero(low <= high.min(1)[:, None])
    d = ((v[row] - centroids[c]) ** 2).sum(1)
    best = np.full((len(v), len(centroids)), np.iinfo(np.int64).max)
    best[row, c] = d
    which = best.argmin(1)
    return which, best[np.arange(len(v)), which], len(row)


def _longs(column: pa.Array, kind: str = "<i4") -> np.ndarray:
    """The packed rows of a binary column as a matrix."""
    width = len(column[0].as_py()) if len(column) else 0
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width // np.dtype(kind).itemsize)


def starting_centroids(whole: DataFrame, id_col: str, n: int, salt: str) -> list[list[int]]:
    """The v of the n rows with the smallest sha256 of salt and id; n rows reach the driver."""
    h = F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256)
    rows = whole.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(n).collect()
    return [r.v for r in rows]


def _packed(whole: DataFrame, id_col: str, simplex: Simplex) -> DataFrame:
    kind = whole.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            apex = simplex.project(v.astype(float))
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (v.astype("<i4"), apex.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([b.column(0), *packed], ["id", "v", "apex"])

    return materialize(whole.select(id_col, "v").mapInArrow(run, f"id {kind}, v binary, apex binary"))


def _moved(packed: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round: the exact floor of the mean of their vectors, an empty one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            v = _longs(b.column(0)).astype(np.int64)
            which, _, _ = nearest(v, _longs(b.column(1), "<f8"), centroids, simplex)
            np.add.at(total, which, v)
            count += np.bincount(which, minlength=len(count))
        used = np.flatnonzero(count)
        sums = pa.array(total[used].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), sums], ["c", "n", "s"])

    parts = packed.select("v", "apex").mapInArrow(run, "c int, n long, s array<long>")
    each = [F.sum(F.get("s", F.lit(k)).cast("decimal(38,0)")) for k in range(centroids.shape[1])]
    out = centroids.copy()
    for r in parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*each).alias("s")).collect():  # a row per centroid
        out[r.c] = [int(x) // r.n for x in r.s]
    return out


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    pivots: int = PIVOTS, size: int = SIZE, scale: int = SCALE, salt: str = "3:",
) -> DataFrame:
    """Per usable vector: its id, cluster, distance (squared), centroid, cluster_inertia and inertia."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    whole = whole_vectors(df.select(F.col(id_col), F.col(vector_col)), vector_col, size, scale)
    first = starting_centroids(whole, id_col, max(clusters, pivots), salt)
    schema = f"{id_col} {kind}, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{schema}, centroid array<long>, cluster_inertia long, inertia long")
    simplex = Simplex.of(np.array(first[:pivots], np.int64))
    centroids = np.array(first[:clusters], np.int64)
    packed = _packed(whole, id_col, simplex)
    for _ in range(rounds):
        centroids = _moved(packed, centroids, simplex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, d, _ = nearest(_longs(b.column(1)).astype(np.int64), _longs(b.column(2), "<f8"), centroids, simplex)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(which, pa.int32()), pa.array(d)], [id_col, "cluster", "distance"])

    found = materialize(packed.mapInArrow(run, schema))
    forget(packed)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(k, c.tolist(), sums.get(k, 0), sum(sums.values())) for k, c in enumerate(centroids)]
    per = spark.createDataFrame(rows, "cluster int, centroid array<long>, cluster_inertia long, inertia long")
    return found.join(F.broadcast(per), "cluster").select(id_col, "cluster", "distance", "centroid", "cluster_inertia", "inertia")


def cluster_sql(table: str = "embeddings", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, salt: str = "3:") -> str:
    """The columns of the registered query as SQL, a pair of steps for each round; every centroid is compared."""
    apart = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT rid, arg_min(k, d * {clusters} + k) AS k, min(d) AS d FROM (SELECT rid, k, {apart} AS d FROM kept, c{r}) GROUP BY rid)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x "
                f"FROM (SELECT k, unnest(v) AS x, unnest(range(0, {size})) AS i FROM kept JOIN a{r} USING (rid)) GROUP BY k, i) GROUP BY k)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.k = m{r}.k)")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM {table}
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v AS c FROM
  (SELECT sha256('{salt}' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {clusters})),
{", ".join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN c{rounds} f ON a.k = f.k
"""
