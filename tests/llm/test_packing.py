import zlib

import numpy as np
import pytest

from lumenmatch.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a <|endoftext|> B<|startoftext|>c", "don't I'LL 12 3.4", "́x ý", "İstanbul ΑΣ ΣΑΣ.", "a\x1cb\x85c　d", "x,. y., z.\tw, é, É.", "naïve—dash's ok"]


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_equal_the_tokenizer(spark, docs, texts):
    rows = texts + [(1000 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.piece): r for r in packing.pieces(df, PATH, capacity=512).collect()}
    want = 0
    for i, t in rows:
        ids = ids_of(t)
        for k, a in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[a : a + 512], "<u4")
            r = got[i, k]
            assert (r.start, r.length, r.ids_crc32) == (a, len(part), zlib.crc32(part.tobytes()))
            want += 1
    assert len(got) == want


def test_sequences_are_gapless_and_few(docs):
    placed = packing.pack_documents(docs, PATH, capacity=512).collect()
    by = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    total = sum(r.length for r in placed)
    assert len(by) <= -(-total // 512) + 2


def test_plan_uses_the_demand_exactly():
    demand = {2048: 3, 1500: 7, 548: 9, 300: 40, 7: 123, 1025: 11}
    got = {}
    for config, m in packing.plan(demand):
        assert sum(n * k for n, k in config.items()) <= 2048
        for n, k in config.items():
            got[n] = got.get(n, 0) + k * m
    assert got == demand
    assert packing.plan({}) == []


def test_sequences_round_trip_and_empty(spark, docs, empty, texts):
    some = docs.where("doc_id in (0, 1, 36, 40)")
    seq = packing.sequences(some, PATH).collect()
    ids = sorted(i for r in seq for i in r.ids)
    want = sorted(i for d in some.collect() for i in ids_of(d.text))
    assert ids == want
    assert packing.pack_documents(empty, PATH).count() == 0


def test_long_texts_null_ids_and_repeated_rows(spark, monkeypatch):
    """Segments between blanks give the ids of the whole text; every row is packed."""
    long = " ".join(["Some words, with marks. And\nlines <|x|> don't"] * 30)
    monkeypatch.setattr(packing, "SLICE_BYTES", 40)
    found, cut = packing._ids(packing.pa.array([long]), PATH)
    assert [*found.tolist(), 0] == ids_of(long) and cut.tolist() == [0, len(found)]
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, long)], "doc_id long, text string")
    out = packing.pack_documents(rows, PATH, capacity=64).collect()
    assert sum(x.length for x in out) == sum(len(ids_of(t)) for t in ("a b", "a b", "c", None, long))
    places = {(x.sequence_id, x.offset) for x in out}
    assert len(places) == len(out) and sum(x.doc_id is None for x in out) == 2


def test_a_frequent_length_is_ranked_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKETS", 4)
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    rows = spark.range(400).selectExpr("id AS doc_id", "0 AS piece", "IF(id < 300, 7L, 3L) AS length")
    out = packing.pack(rows, capacity=16).collect()
    assert len({(x.sequence_id, x.offset) for x in out}) == 400
    assert len({x.sequence_id for x in out}) <= 168  # the least is 167: 133 of two long ones, 34 of one with short ones
