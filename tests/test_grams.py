import math
import random

import pytest

from lumenmatch.operators import fuzzy, grams


def brute(texts, names, n, keep):
    def counts(x):
        v = f"-{x.lower()}-".ljust(n, "-")
        out = {}
        for k in range(len(v) - n + 1):
            out[v[k : k + n]] = out.get(v[k : k + n], 0) + 1
        return out

    length = lambda c: math.sqrt(sum(v * v for v in c.values()))
    have = [(name, counts(name)) for name in set(names)]
    out = set()
    for t in {t for t in texts if t is not None}:
        q = counts(t)
        rows = []
        for name, c in have:
            dot = sum(v * c.get(g, 0) for g, v in q.items())
            if dot:
                rows.append((-round(dot / (length(q) * length(c)), 12), name))
        out |= {(t, name, round(-cos, 9), k + 1) for k, (cos, name) in enumerate(sorted(rows)[:keep])}
    return out


def words(seed, n):
    """Names that share frequent parts, short names, and names with repeated grams."""
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "zu", "re", "tan", "vor", "eli"]
    one = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    out = [f"{one()} {one()} collected edition {r.randrange(40)}" for _ in range(n)] + [one() for _ in range(n)]
    return [*out, "ananananan", "aaaa", "a", "éa éa éa", "kaka lolo"]


@pytest.fixture(autouse=True)
def bounded(monkeypatch):
    monkeypatch.setattr(grams, "READ_ALL", 0)


@pytest.fixture(scope="module")
def names():
    return words(1, 120)


@pytest.fixture(scope="module")
def texts(names):
    r = random.Random(2)
    out = [n.replace("o", "0") for n in r.sample(names, 40)] + r.sample(names, 20) + words(3, 10)
    return [*out, None, "", "qqqq", "aaaa anana", "collected edition"]


def rows(spark, values, col):
    return spark.createDataFrame([(v,) for v in values], f"{col} string").repartition(3)


def result(df):
    return {(r.text, r.name, round(r.cos, 9), r.cos_rank) for r in df.collect()}


@pytest.mark.parametrize(("n", "keep", "max_rows"), [(3, 50, 200_000), (3, 5, 10), (2, 8, 200_000)])
def test_nearest_equals_brute_force(spark, texts, names, n, keep, max_rows):
    index = grams.index_of(rows(spark, [*names, None, names[0]], "name"), n, max_rows)
    assert index.small == (max_rows > 10)
    assert result(grams.nearest(rows(spark, texts, "text"), index, keep)) == brute(texts, names, n, keep)


def test_few_postings_are_read_without_a_bound(spark, texts, names, monkeypatch):
    monkeypatch.setattr(grams, "READ_ALL", 10**6)
    index = grams.index_of(rows(spark, names, "name"), 3)
    assert result(grams.nearest(rows(spark, texts, "text"), index, 20)) == brute(texts, names, 3, 20)
    assert grams.nearest(rows(spark, ["qqqq"], "text"), index).count() == grams.nearest(rows(spark, [], "text"), index).count() == 0


def test_frequent_grams_are_not_read_where_they_cannot_help(spark, texts, names):
    index = grams.index_of(rows(spark, names, "name"), 3)
    q = grams._ordered(rows(spark, [t for t in texts if t and "edition" in t], "text"), index)
    cut = grams.with_prefix(q, grams._least_cosines(q, index, 5)).collect()
    read = sum(g.df for r in cut for g in r["grams"][: r.k])
    assert 0 < read < 0.4 * sum(g.df for r in cut for g in r["grams"])


def test_index_tables_follow_updates(spark, texts, names, tmp_path):
    table = grams.GramTable(spark, "lumen_names", 3, 4, str(tmp_path / "grams"))
    first, more = names[:150], names[100:]
    table.build(rows(spark, first, "name"))
    gone = [*names[20:60], names[140], "not there", None]
    for _ in range(2):
        table.update(rows(spark, more, "name"), rows(spark, gone, "name"))
    now = [n for n in first if n not in gone] + more
    text_rows = rows(spark, texts, "text")
    assert result(grams.nearest(text_rows, table.index(), 10)) == brute(texts, now, 3, 10)
    back = names[25:30]
    table.update(added=rows(spark, back, "name"))
    assert result(grams.nearest(text_rows, table.index(), 10)) == brute(texts, [*now, *back], 3, 10)
    assert spark.table("lumen_names_postings").where(f"name = '{names[26]}'").select("number").distinct().count() == 2
    assert result(grams.nearest(text_rows, grams.index_of(rows(spark, [*now, *back], "name"), 3), 10)) == brute(texts, [*now, *back], 3, 10)


def test_an_index_too_large_to_broadcast_is_read_without_a_shuffle(spark, names, tmp_path):
    table = grams.GramTable(spark, "lumen_large", 3, 4, str(tmp_path / "grams"))
    table.build(rows(spark, names, "name"))
    index = grams.GramIndex(3, *(getattr(table.index(), f) for f in ("postings", "vectors", "frequencies")), False)
    asked = rows(spark, ["kalo", "vortan"], "text").selectExpr("text", "substring(text, 1, 3) AS gram")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = asked.join(index.side(index.postings), "gram")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(gram") == 1
        counted = index.frequencies._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(gram" not in counted
        assert joined.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_second_gram_size_only_for_the_rest(spark, names):
    texts = rows(spark, ["kalo", "zu", "xxxxxx"], "text")
    a, b = grams.index_of(rows(spark, names, "name"), 3), grams.index_of(rows(spark, names, "name"), 2)
    assert sorted(map(tuple, fuzzy.lookup_in(texts, a, b).collect())) == sorted(map(tuple, fuzzy.lookup(texts, rows(spark, names, "name")).collect()))
