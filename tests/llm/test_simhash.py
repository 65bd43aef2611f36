import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lumenmatch.llm import queries, simhash


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_labels(prints, distance):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= distance:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def brute(texts):
    prints = [(i, brute_print(t)) for i, t in texts]
    label = brute_labels({p for _, p in prints}, 4)
    return [(i, f"{p:016x}", min((j for j, q in prints if label[q] == label[p] and j is not None), default=None)) for i, p in prints]


def answer(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op11_simhash_near_dedup(spark, str(tmp_path)).collect()), key=repr)


def test_rows_equal_brute_force(spark, docs, texts, tmp_path):
    want = brute(texts + [texts[3], texts[40]])
    assert answer(spark, tmp_path, docs) == sorted(want, key=repr)
    assert len({c for _, _, c in want}) < len(want) - 12


def test_empty_and_null_ids(spark, empty, texts, tmp_path):
    assert simhash.component_ids(empty).count() == 0
    rows = [(None, texts[0][1]), (None, "lone words that nobody else has"), (4, texts[0][1]), (9, None), (2, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(spark, tmp_path, df) == sorted(brute(rows), key=repr)


def crowded(r, n, families):
    """Random fingerprints and families that crowd in a few bits, links between some of them only along chains."""
    out = {r.getrandbits(64) for _ in range(n)}
    for _ in range(families):
        base, bits = r.getrandbits(64), r.sample(range(64), 14)
        for _ in range(60):
            x = base
            for b in r.sample(bits, r.randrange(11)):
                x ^= 1 << b
            out.add(x)
    return out


def as_labels(rows, prints):
    named = {r.node & (1 << 64) - 1: r.label for r in rows}
    groups = {}
    for p in prints:
        groups.setdefault(named.get(p, p - (p >> 63 << 64)), set()).add(p)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(("distance", "task_rows"), [(4, simhash.TASK_ROWS), (4, 400), (1, 60), (0, 50), (9, 500)])
def test_links_equal_brute_force(spark, distance, task_rows):
    prints = crowded(random.Random(distance), 250, 4)
    rows = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    got = as_labels(simhash.links(rows, distance, task_rows).collect(), prints)
    groups = {}
    for p, q in brute_labels(prints, distance).items():
        groups.setdefault(q, set()).add(p)
    assert got == sorted(map(sorted, groups.values()))


def test_one_cell_over_many_fragments(spark):
    """All fingerprints under one pattern, in islands that only some distant fragments join."""
    r = random.Random(4)
    high = 0xABC << 52 | 0x55 << 42
    prints = {high | r.getrandbits(42) & r.getrandbits(42) & r.getrandbits(42) for _ in range(900)}
    rows = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    got = as_labels(simhash.links(rows, 4, 300).collect(), prints)
    groups = {}
    for p, q in brute_labels(prints, 4).items():
        groups.setdefault(q, set()).add(p)
    assert got == sorted(map(sorted, groups.values()))
    assert 2 < len(got) < 900


@pytest.mark.parametrize("limit", [1, 50, simhash.FRONTIER])
def test_index_search_prunes_and_finds_all(limit):
    r = np.random.default_rng(3)
    p = np.unique(np.r_[r.integers(0, 1 << 63, 400), r.integers(0, 1 << 20, 500), (1 << 40) ^ (1 << r.integers(0, 50, 300))].astype(np.uint64))
    p = p[np.argsort(simhash.gray_rank(p))]
    assert (simhash.gray_code(simhash.gray_rank(p)) == p).all()
    label = simhash.connect(p, np.zeros(len(p), int), 4, limit=limit)
    want = brute_labels([int(x) for x in p], 4)
    groups = {}
    for x, k in zip(p, label, strict=True):
        groups.setdefault(int(k), set()).add(want[int(x)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_patterns_are_reversible():
    fp = np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64)
    for distance in (0, 1, 4, 9):
        patterns = simhash.Patterns(distance)
        for t in range(len(patterns.orders)):
            assert (patterns.restored(patterns.laid(fp, t), np.full(100, t)) == fp).all()
