import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lumenmatch.llm import secrets  # noqa: E402

from .conftest import SCHEMA, edited, rows_of, sentence  # noqa: E402
from .test_jaccard import brute as brute_components  # noqa: E402
from .test_rules import brute_cleaned, prose  # noqa: E402


def brute_cut(text, bench):
    """The text without words of 10-word windows of the items, and without what stands before each such word."""
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
    plain = [re.sub("[A-Z]", lambda m: m.group().lower(), w.group()) for w in words]
    gone = set()
    for item in bench:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), item))
        n = min(10, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
        for k in range(len(plain) - n + 1):
            if tuple(plain[k : k + n]) in wins:
                gone |= set(range(k, k + n))
    out, at = [], 0
    for k, w in enumerate(words):
        if k not in gone:
            out.append(text[at : w.end()])
        at = w.end()
    return "".join([*out, text[at:]])


def brute_masked(text):
    """The base patterns' spans masked, overlapping ones as one."""
    out, end = [], 0
    for a, _, e in secrets.base_spans(text):
        if a >= end:
            out += [text[end:a], "[SECRET]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def test_run_equals_a_brute_force_version(spark, tmp_path):
    """Banners, copies, near copies, benchmark passages, secrets, nulls and short texts on a small fixture, piece by piece."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    r = random.Random(18)
    line = prose(r, 15)
    texts = ["\n".join([line, prose(r, 50), prose(r, 25)]) for _ in range(24)] + ["\n".join([line, prose(r, 38)]) for _ in range(4)]
    texts += [prose(r, 90) for _ in range(10)]
    bench = [prose(r, 25), prose(r, 6)]
    texts += [texts[0], edited(r, texts[30], 0.01), edited(r, texts[31], 0.02), f"{prose(r, 60)} {bench[0].upper()}, {prose(r, 60)}", f"{prose(r, 60)}; {bench[1]}. {prose(r, 9)}"]
    texts += [f"{prose(r, 70)} password=abcdef0123456789 {prose(r, 30)} {'ab12' * 8}", None, "", "few words", prose(r, 3000)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows_of(rows), SCHEMA).withColumn("source", F.lit("one")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    verdict = brute_cleaned([(i, t, "one") for i, t in rows])
    kept = [(i, verdict[i, t][2]) for i, t in rows if verdict[i, t or ""][1]]
    assert not any(line in t for _, t in kept) and sum(v[0] > 0 and v[1] for v in verdict.values()) > 20
    assert {24, 25, 26, 27}.isdisjoint(i for i, _ in kept) and len(kept) > 35
    groups = brute_components(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    kept = [(i, brute_masked(brute_cut(t, bench))) for i, t in kept]
    assert sum("[SECRET]" in t for _, t in kept) == 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in kept:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048] = (k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in out} == want and len(out) == len(want)
    by = {}
    for x in out:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(by) <= -(-sum(n for _, n, _ in want.values()) // 2048) + 1


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    names = ("_id", "_k", "_spans", "_b", "_t", "known", "host", "h", "count", "text_key")
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    r = random.Random(1)
    for name, rows in (("none", []), ("some", [(k, prose(r, 80), "s", *range(10)) for k in range(3)] + [(None, prose(r, 80), None, *range(10))])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == ["doc_id", "text", "source", *names]
        assert docs.count() == len(rows)
        assert corpus_pipeline.run(spark, folder).count() == len(rows)


def test_stages_on_planted_cases(spark, tmp_path):
    r = random.Random(8)
    clean = [sentence(r, 120) for _ in range(12)]
    bench = sentence(r, 25)
    rows = list(enumerate(clean))
    rows += [(100, clean[0]), (101, edited(r, clean[1], 0.01)), (102, clean[2][:50])]
    rows += [(103, f"{sentence(r, 60)} {bench} {sentence(r, 60)}"), (104, f"{sentence(r, 70)} password=abcdef0123456789 {sentence(r, 30)}"), (105, None)]
    spark.createDataFrame(rows_of(rows), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "sid", "pos", "_t"]
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen.append({x.doc_id: x for x in docs.collect()})
    rules, near, cut, masked = seen
    assert set(rules) == {*range(12), 100, 101, 103, 104}
    assert set(near) == {*range(12), 103, 104}
    assert set(cut) == set(near) and all(w not in cut[103].text for w in [bench, bench[:60]])
    assert set(masked) == set(near) and "abcdef0123456789" not in masked[104].text
    assert all(masked[k].text == clean[k] for k in range(12))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == set(masked)
