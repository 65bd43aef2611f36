import re
from itertools import combinations

from lumenmatch.llm import jaccard


def brute(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sets, 2):
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i: (len(s), root[i]) for i, s in sets.items()}


def test_components_equal_brute_force(docs, texts):
    got = jaccard.component_ids(docs).collect()
    assert len(got) == len(texts) + 2
    want = brute(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_small_blocks_and_hot_shingles_give_the_same(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 100)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 3)
    monkeypatch.setattr(jaccard, "TASK_ROWS", 50)
    got = jaccard.component_ids(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_keep_one(docs, texts):
    want = brute(texts)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_empty_and_null_ids(spark, empty, texts):
    assert jaccard.component_ids(empty).count() == 0
    rows = spark.createDataFrame([(None, texts[0][1]), (None, "lone words that nobody else has"), (4, texts[0][1])], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id) for r in jaccard.component_ids(rows).collect() if r.component_id) == [(76, 4), (76, 4)]


def test_a_class_without_ids_connects_others(spark):
    words = [f"w{k}" for k in range(60)]
    first, last = " ".join(words), " ".join([*words[8:], *[f"x{k}" for k in range(8)]])
    bridge = " ".join([*words[4:], *[f"x{k}" for k in range(4)]])
    rows = spark.createDataFrame([(1, first), (None, bridge), (None, bridge), (9, last)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.component_ids(rows).collect()} == {1}
    assert [r.doc_id for r in jaccard.keep_one(rows).collect()] == [1]
    assert {(r.doc_id, r.component_id) for r in jaccard.component_ids(rows.where("doc_id is not null")).collect()} == {(1, 1), (9, 9)}


def test_many_blocks_of_chained_families_equal_brute_force(spark, monkeypatch):
    """Families whose members link only along a chain, over many blocks, with outliers."""
    import random

    r = random.Random(11)
    texts, n = [], 0
    for _ in range(4):
        words = [f"f{r.randrange(10**6)}" for _ in range(70)]
        for _ in range(25):
            for _ in range(r.choice((1, 1, 2, 4))):
                words[r.randrange(70)] = f"c{r.randrange(10**6)}"
            texts.append((n, " ".join(words)))
            n += 1
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 400)
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_ids(rows).collect()}
    want = brute(texts)
    assert got == want
    assert 4 < len({c for _, c in want.values()}) < 90


def test_keep_one_with_clashing_columns(spark, texts):
    rows = [(i, t, 1, 2, 3, 4) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _k int, count int, text_key int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute(texts).items() if c == i)
