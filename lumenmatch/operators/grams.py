"""Inverted gram indexes of a dictionary, and the exact nearest names by n-gram cosine.

A shortlist meets no more postings than it must. The grams of a text are ordered rarest
first. A few names from the heads of the rarest postings are scored in full, which gives a
cosine that the last place of the shortlist has at least. A name that shares only the last,
most frequent grams has at most the norm of the text on these, so where that is below the
bound, their postings are not read at all; what those grams add to names that were met on the others
is read from the names' own vectors, and only where the bound can still be reached. A gram
that nearly all names have is thus left out just where it is of no use.

An index is a view of three tables: postings by gram, vectors by name, and the names of each
gram counted. ``index_of`` makes them for one job. ``GramTable`` keeps them as tables bucketed
by gram and by name, to which updates append: a row carries the number of the update that
wrote it, a dropped name the number at which it went. Reads of the tables need no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import BROADCAST_ROWS, delete_path, materialize, merged, spread
from ..functions.text import gram_counts, norm

SHORTLIST = 50
#: How many grams of a text give first names, how many names of each, as multiples of the shortlist.
SEED_GRAMS, SEED_NAMES = 4, 2
#: Where the grams of all texts are in no more postings than this, all are read, without a bound.
READ_ALL = 2_000_000
#: Bounds are compared with this margin, far above rounding.
MARGIN = 1e-9


@dataclass(frozen=True)
class GramIndex:
    """postings (gram, name, ct, norm), vectors (name, grams, norm) and frequencies (gram, df) of grams of n characters.

    small says whether the counted gram rows are few enough to broadcast each of them.
    """

    n: int
    postings: DataFrame
    vectors: DataFrame
    frequencies: DataFrame
    small: bool

    def side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else merged(df)


def vectors_of(df: DataFrame, col: str, n: int) -> DataFrame:
    """Distinct values of col with their gram counts and norm; null values go."""
    d = spread(df.select(col).where(F.col(col).isNotNull()), col).distinct()
    return d.select(col, gram_counts(F.col(col), n).alias("grams")).withColumn("norm", norm(F.col("grams")))


def set_of(grams: Column) -> Column:
    """What gram_dot needs of gram counts: all grams, and those that are repeated with their counts."""
    return F.struct(grams["gram"].alias("all"), F.filter(grams, lambda x: x["ct"] > 1).alias("repeated"))


def postings_of(vectors: DataFrame) -> DataFrame:
    return vectors.select("name", "norm", F.explode("grams").alias("g")).select(F.col("g.gram").alias("gram"), "name", F.col("g.ct").alias("ct"), "norm")


def index_of(dictionary: DataFrame, n: int, max_rows: int = BROADCAST_ROWS) -> GramIndex:
    """An index of the names for one job, written once."""
    vectors = materialize(vectors_of(dictionary, "name", n))
    rows = vectors.agg(F.sum(F.size("grams"))).first()[0] or 0
    postings = postings_of(vectors)
    return GramIndex(n, postings, vectors, postings.groupBy("gram").agg(F.count("*").alias("df")), rows <= max_rows)


def gram_dot(a: Column, b: Column) -> Column:
    """The product of the gram counts of two sets (set_of): what they share counts once, and repeated grams what they add to that."""
    count = lambda s, gram: F.aggregate(s["repeated"], F.lit(1.0), lambda n, y: F.when(y["gram"] == gram, y["ct"]).otherwise(n))
    added = lambda x, y, seen: F.aggregate(
        x["repeated"], F.lit(0.0),
        lambda n, g: n + F.when(F.array_contains(y["all"], g["gram"]) & seen(g), g["ct"] * count(y, g["gram"]) - 1).otherwise(0.0),
    )
    first = lambda g: F.lit(True)
    alone = lambda g: count(a, g["gram"]) == 1  # noqa: E731  else it was added with a's
    shared = F.size(F.array_intersect(a["all"], b["all"])).cast("double")
    return shared + added(a, b, first) + added(b, a, alone)


def _cosine(dot: Column) -> Column:
    return F.round(dot / (F.col("q_norm") * F.col("norm")), 12)


def _ordered(texts: DataFrame, index: GramIndex) -> DataFrame:
    """Per text its known grams, rarest first: text, q_norm, grams, rest (the text's share of norm from each gram on)."""
    q = vectors_of(texts, "text", index.n)
    each = q.select("text", F.col("norm").alias("q_norm"), F.explode("grams").alias("g"))
    each = each.select("text", "q_norm", F.col("g.gram").alias("gram"), F.col("g.ct").alias("ct")).join(index.side(index.frequencies), "gram")
    grams = F.sort_array(F.collect_list(F.struct("df", "gram", "ct"))).alias("grams")
    o = each.groupBy("text", "q_norm").agg(grams)
    total = lambda i: F.aggregate(F.slice("grams", i, F.size("grams")), F.lit(0.0), lambda s, x: s + x["ct"] * x["ct"])
    return materialize(o.withColumn("rest", F.transform(F.sequence(F.lit(1), F.size("grams")), lambda i: F.sqrt(total(i)) / F.col("q_norm"))))


def _least_cosines(q: DataFrame, index: GramIndex, keep: int) -> DataFrame:
    """text, floor: a cosine that keep names reach; texts of which fewer names were met are absent."""
    head = Window.partitionBy("gram").orderBy("norm", "name")
    heads = index.postings.withColumn("_n", F.row_number().over(head)).where(F.col("_n") <= SEED_NAMES * keep).select("gram", "name")
    seeds = spread(q, "text").select("text", F.explode(F.slice("grams", 1, SEED_GRAMS)["gram"]).alias("gram"))
    pairs = seeds.join(index.side(heads), "gram").select("text", "name").distinct()
    names = index.vectors.select("name", "norm", set_of(F.col("grams")).alias("d_set"))
    met = pairs.join(index.side(names), "name").join(q.select("text", "q_norm", set_of(F.col("grams")).alias("q_set")), "text")
    scored = met.select("text", _cosine(gram_dot(F.col("q_set"), F.col("d_set"))).alias("cos"))
    place = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("cos")))
    return scored.withColumn("_n", place).where(F.col("_n") == keep).select("text", F.col("cos").alias("floor"))


def with_prefix(q: DataFrame, floors: DataFrame) -> DataFrame:
    """q with floor (0 where unknown) and k: how many of the grams have postings to be read."""
    k = F.size(F.filter("rest", lambda r: r >= F.col("floor") - MARGIN))
    return q.join(floors, "text", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("k", k)


def nearest(texts: DataFrame, index: GramIndex, keep: int = SHORTLIST) -> DataFrame:
    """texts (text) -> text, name, cos, cos_rank: exactly the keep names of the greatest cosine, ties by name."""
    q = _ordered(texts, index)
    reads = q.agg(F.sum(F.aggregate("grams", F.lit(0).cast("long"), lambda n, g: n + g["df"]))).first()[0] or 0
    if reads > READ_ALL:
        q = materialize(with_prefix(q, _least_cosines(q, index, keep)))
    else:
        q = q.withColumns({"floor": F.lit(0.0), "k": F.size("grams")})
    rest = F.coalesce(F.get("rest", F.col("k")), F.lit(0.0)).alias("rest")
    read = spread(q, "text").select("text", "q_norm", "floor", rest, F.explode(F.slice("grams", F.lit(1), F.col("k"))).alias("g"))
    read = read.select("text", "q_norm", "floor", "rest", F.col("g.gram").alias("gram"), F.col("g.ct").alias("q_ct"))
    # what is the same for a text or a name is carried along, so that nothing is joined again
    carried = [F.first(c).alias(c) for c in ("q_norm", "norm", "floor", "rest")]
    sums = [F.sum(F.col("q_ct") * F.col("ct")).alias("dot"), F.sum(F.col("ct") * F.col("ct")).alias("used")]
    met = read.join(index.side(index.postings), "gram").groupBy("text", "name").agg(*sums, *carried)
    # the name's share of norm outside the grams that were met bounds what the others can add
    left = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("used") / (F.col("norm") * F.col("norm"))))
    met = met.where(F.col("dot") / (F.col("q_norm") * F.col("norm")) + F.col("rest") * left >= F.col("floor") - MARGIN)
    whole = met.where(F.col("rest") == 0).select("text", "name", _cosine(F.col("dot")).alias("cos"))
    tails = q.select("text", set_of(F.slice("grams", F.col("k") + 1, F.size("grams"))).alias("tail"))
    names = index.vectors.select("name", set_of(F.col("grams")).alias("d_set"))
    part = met.where(F.col("rest") > 0).join(index.side(names), "name").join(tails, "text")
    part = part.select("text", "name", _cosine(F.col("dot") + gram_dot(F.col("tail"), F.col("d_set"))).alias("cos"))
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("cos"), "name"))
    return whole.unionByName(part).withColumn("cos_rank", rank).where(F.col("cos_rank") <= keep)


@dataclass(frozen=True)
class GramTable:
    """An index kept as tables: base_postings, base_vectors and base_dropped, the first two bucketed.

    The tables lie under folder, or in the warehouse if none is given.
    """

    spark: SparkSession
    base: str
    n: int = 3
    buckets: int = 64
    folder: str | None = None

    def _save(self, rows: DataFrameWriter, kind: str) -> None:
        rows = rows.format("parquet").mode("append")
        (rows.option("path", f"{self.folder}/{kind}") if self.folder else rows).saveAsTable(f"{self.base}_{kind}")

    def _write(self, vectors: DataFrame, number: int) -> None:
        vectors = materialize(vectors)
        for kind, rows, key in (("vectors", vectors, "name"), ("postings", postings_of(vectors), "gram")):
            rows = rows.withColumn("number", F.lit(number)).repartition(self.buckets, key)
            self._save(rows.write.bucketBy(self.buckets, key).sortBy(key), kind)

    def build(self, names: DataFrame) -> None:
        """Make the tables anew from names (name)."""
        for kind in ("vectors", "postings", "dropped"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.base}_{kind}")
            if self.folder:
                delete_path(self.spark, f"{self.folder}/{kind}")
        self._write(vectors_of(names, "name", self.n), 0)
        self._save(self.spark.createDataFrame([], "name string, number int").write, "dropped")

    def _alive(self, kind: str) -> DataFrame:
        """The rows whose name was not dropped after they were written."""
        rows, gone = self.spark.table(f"{self.base}_{kind}"), self.spark.table(f"{self.base}_dropped")
        gone = gone.groupBy(F.col("name").alias("_name")).agg(F.max("number").alias("_at"))
        gone = F.broadcast(gone) if self.dropped() <= BROADCAST_ROWS else gone
        return rows.join(gone, (rows.name == F.col("_name")) & (rows.number < F.col("_at")), "left_anti").drop("number")

    def dropped(self) -> int:
        return self.spark.table(f"{self.base}_dropped").count()

    def update(self, added: DataFrame | None = None, dropped: DataFrame | None = None) -> None:
        """Drop names, then add those that are not there; both given twice change nothing more. Beyond the broadcast bound the tables are made anew."""
        last = [self.spark.table(f"{self.base}_{k}").agg(F.max("number")).first()[0] or 0 for k in ("vectors", "dropped")]
        number = max(last) + 1
        if dropped is not None:
            gone = dropped.select("name").distinct().join(self._alive("vectors"), "name", "left_semi")
            gone.select("name", F.lit(number).alias("number")).write.mode("append").insertInto(f"{self.base}_dropped")
        if added is not None:
            fresh = vectors_of(added, "name", self.n).join(self._alive("vectors").select("name"), "name", "left_anti")
            self._write(fresh, number)
        if self.dropped() > BROADCAST_ROWS:
            self.build(materialize(self._alive("vectors").select("name")))

    def index(self) -> GramIndex:
        postings, vectors = self._alive("postings"), self._alive("vectors")
        frequencies = postings.groupBy("gram").agg(F.count("*").alias("df"))
        return GramIndex(self.n, postings, vectors, frequencies, self.spark.table(f"{self.base}_postings").count() <= BROADCAST_ROWS)
