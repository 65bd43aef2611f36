import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lumenmatch.llm import queries, runs


def brute_runs(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        k = 0
        while k + q < n:
            e = k
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e + q - k >= max(least, times * q) and (k, e + q - k) not in out:
                out[k, e + q - k] = q  # periods come in ascending order, so the smallest stays
            k = e + 1
    return sorted((s, q, size) for (s, size), q in out.items())


def brute(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    gone = {k for s, q, size in found for k in range(s + q, s + size)}
    s, q, size = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{a},{c},{b}\n" for a, b, c in found)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(found), s, size, q, None if q is None else 1000 * size // q, sha(lines), sha(kept))


def periodic(r, letters):
    """Words with nested and neighbouring repetitions."""
    w = [r.choice(letters) for _ in range(r.randrange(30))]
    for _ in range(r.randrange(1, 5)):
        block = [r.choice(letters) for _ in range(r.choice((1, 2, 3, 5, 9, 14)))]
        if r.random() < 0.5:
            block = block[: r.randrange(1, 4)] * r.randrange(2, 14) + block
        w += (block * 12)[: len(block) * r.randrange(2, 11) + r.randrange(len(block))]
        w += [r.choice(letters) for _ in range(r.randrange(12))]
    return w


@pytest.mark.parametrize(("letters", "least", "times"), [("ab", 24, 3), ("abc", 24, 3), ("ab", 6, 2), ("abcdefgh", 12, 3), ("a", 24, 3)])
def test_runs_equal_brute_force(letters, least, times):
    r = random.Random(letters)
    n = 0
    for _ in range(120):
        w = periodic(r, letters)
        want = brute_runs(w, least, times)
        assert runs.runs_of(w, least, times) == want
        starts, ends = runs.stretches(np.array([hash(x) & 0xFFFF for x in w], np.uint64), np.array([0, len(w)]), least, times)
        got = [(int(a) + s, q, size) for a, e in zip(starts, ends, strict=True) for s, q, size in runs.runs_of(w[a:e], least, times)]
        assert got == want
        n += len(want)
    assert n > 50


def test_query_equals_brute_force(spark, docs, texts, tmp_path):
    r = random.Random(8)
    more = [(1000 + k, ("\n" if k % 2 else " ").join(periodic(r, ["Ka", "ka", "é", "lo"]))) for k in range(60)]
    more += [(2000 + k, texts[k % 50][1]) for k in range(60)] + [(None, "x " * 50), (1001, "y z " * 40), (7, "w " * 3000)]
    df = docs.select("doc_id", "text", "h").unionByName(spark.createDataFrame([(i, t, "h") for i, t in more], "doc_id long, text string, h string"))
    df.selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS best").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute(i, t) for i, t in texts + [texts[3], texts[40]] + more]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert sum(x[1] for x in want) > 60


def test_empty_table(spark, empty):
    assert runs.find_runs(empty).count() == 0


def test_a_long_text_of_one_word_is_quick():
    assert runs.runs_of(["a"] * 100_000) == [(0, 1, 100_000)]
