import hashlib

import pytest

from lumenmatch.llm import repeats


def brute(texts):
    first, out = {}, {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot_least", "task_rows"), [(repeats.HOT_LEAST, repeats.TASK_ROWS), (2, repeats.TASK_ROWS), (repeats.HOT_LEAST, 300), (2, 100)])
def test_removal_equals_brute_force(docs, texts, hot_least, task_rows, monkeypatch):
    monkeypatch.setattr(repeats, "TASK_ROWS", task_rows)
    got = repeats.remove_repeats(docs, hot_least=hot_least).collect()
    assert len(got) == len(texts) + 2
    want = brute(texts)
    assert {r.doc_id: (r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), len(r.starts), r.kept_sha256) for r in got} == want
    assert sum(x[1] for x in want.values()) > 5000


def test_empty_and_null_ids(spark, empty):
    assert repeats.remove_repeats(empty).count() == 0
    rows = spark.createDataFrame([(None, "x" * 80), (3, "x" * 80), (5, "x" * 80)], "doc_id long, text string")
    got = {r.doc_id: len(r.kept) for r in repeats.remove_repeats(rows).collect()}
    assert got == {None: 80, 3: 80, 5: 0}


def test_an_id_on_several_texts(spark):
    """Rows of one id cover others with larger ids, but neither each other nor each other's places."""
    a, b, c = "a passage that is long enough to be found in another document, twice", "x1y2" * 50, "z9" * 60
    rows = [(1, a), (2, a), (2, a), (2, b), (2, c + b), (3, c), (3, b[:90] + a)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    kept = sorted((r.doc_id, bytes(r.kept).decode()) for r in got)
    assert kept == sorted([(1, a), (2, ""), (2, ""), (2, b), (2, c + b), (3, ""), (3, "")])


def test_masks_equal_brute_force():
    """Random contexts over two letters, so that windows agree by chance in every way."""
    import numpy as np

    r, length, depth = np.random.default_rng(3), 7, 3
    side, n = length - depth, 300
    context = r.integers(97, 99, (n, 2 * side + depth)).astype(np.uint8)
    left, right, doc = (r.integers(0, side + 1, n).astype(np.uint8), r.integers(0, side + 1, n).astype(np.uint8), r.integers(0, 40, n))
    got = repeats.covered_masks(context, left, right, doc, length, depth)
    for o in range(side + 1):
        key = {}
        rows = [k for k in range(n) if left[k] >= side - o and right[k] >= o]
        text = {k: (bytes(context[k, side : side + depth]), bytes(context[k, o : o + length])) for k in rows}
        for k in rows:
            key[text[k]] = min(key.get(text[k], 99), doc[k])
        assert [k for k in range(n) if got[k] >> o & 1] == [k for k in rows if key[text[k]] < doc[k]]


def test_digit_passes_order_like_whole_keys():
    import numpy as np

    r = np.random.default_rng(5)
    side, groups = r.integers(97, 99, (400, 19)).astype(np.uint8), r.integers(0, 30, 400)
    side[200:] = side[:200]
    order, shared = repeats._agreeing(side, groups)
    keys = [(groups[k], bytes(side[k])) for k in order]
    assert keys == sorted(keys) and sorted(order) == list(range(400))
    for k in range(1, 400):
        same = next((j for j in range(19) if keys[k][1][j] != keys[k - 1][1][j]), 19)
        assert shared[k] == (same if keys[k][0] == keys[k - 1][0] else -1)


def test_runs_of_one_letter_and_very_long_texts(spark):
    texts = [(1, "a" * 3000), (2, "b" + "a" * 700 + "c"), (3, "a" * 49), (4, "ab" * 9000 + "a" * 60), (5, "ab" * 100)]
    got = repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), hot_least=50).collect()
    want = brute(texts)
    assert {r.doc_id: (r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), len(r.starts), r.kept_sha256) for r in got} == want
