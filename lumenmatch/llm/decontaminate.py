"""Benchmark decontamination with a broadcast hash set of word windows (native expressions only).

Items give windows of ``width`` consecutive words; an item with fewer words is one window.
Document windows of those lengths are hashed, looked up, and hits are verified word for
word. Only hits leave the scan, so the shuffle holds hits, not documents. The window table
is broadcast when its counted rows are at most BROADCAST_ROWS; beyond that places and hashes
are shuffled to it, and the words of a document meet its hits once.

Defined results: null or empty text has no words and no hits; a null or empty item has no
windows; repeated items and repeated rows count once each; empty tables give zero hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, NOT_WORD_RUN, counted_side, materialize, plain_words, private, small_side, text_key

WIDTH = 10


def _hash_at(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + k) for k in range(length)])


def item_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the items: len, h, window (the words), items (ids as strings)."""
    d = items.select(F.col(id_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    d = d.select("item", "w", n.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
    d = d.select("item", "len", F.slice("w", F.col("at") + 1, F.col("len")).alias("window"))
    return d.groupBy("len", "window").agg(F.collect_set("item").alias("items"))


def window_hits(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Verified hits: doc_id, text_key, at (word position from 0), len, items."""
    windows = materialize(item_windows(items, width, item_id, item_text))
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), plain_words(F.col(text_col)).alias("w"))
    if not lengths:
        empty = d.select("doc_id", "text_key", F.lit(0).alias("at"), F.lit(0).alias("len"), F.array(F.lit("")).alias("items"))
        return empty.where(F.lit(False))
    of_length = lambda n, words, at: F.when(F.col("len") == n, _hash_at(words, at, n))
    known, small = counted_side(windows.withColumn("h", F.coalesce(*[of_length(n, F.col("window"), F.lit(0)) for n in lengths])), broadcast_rows)
    # one pass: at each place the windows of all lengths that fit there
    every = d.where(F.size("w") >= lengths[0]).select("doc_id", "text_key", "w", F.explode(F.sequence(F.lit(0), F.size("w") - lengths[0])).alias("at"))
    if len(lengths) == 1:
        at = every.select("*", F.lit(lengths[0]).alias("len"), _hash_at(F.col("w"), F.col("at"), lengths[0]).alias("h"))
    else:
        here = [F.struct(F.lit(n).alias("len"), _hash_at(F.col("w"), F.col("at"), n).alias("h")) for n in lengths]
        at = every.select("*", F.explode(F.array(*here)).alias("x")).select("doc_id", "text_key", "w", "at", F.col("x.len").alias("len"), F.col("x.h").alias("h"))
        at = at.where(F.col("at") + F.col("len") <= F.size("w"))
    same = F.slice("w", F.col("at") + 1, F.col("len")) == F.col("window")
    if small:
        return at.join(known, ["len", "h"]).where(same).select("doc_id", "text_key", "at", "len", "items")
    # too many windows to broadcast: only places and hashes are exchanged, and a document's hits meet its words once
    found = at.drop("w").join(known, ["len", "h"]).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "len", "window", "items")).alias("x"))
    both = found.alias("f").join(d.dropDuplicates(["doc_id", "text_key"]).alias("d"), _same_text("f", "d")).select("f.doc_id", "f.text_key", "w", "x")
    sure = F.filter("x", lambda x: F.slice(F.col("w"), x["at"] + 1, x["len"]) == x["window"])
    return both.select("doc_id", "text_key", F.explode(sure).alias("x")).select("doc_id", "text_key", "x.at", "x.len", "x.items")


def _same_text(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def merge_hits(hits: DataFrame) -> DataFrame:
    """Per document with hits: doc_id, text_key, spans (disjoint start/end word positions), n_hit, items (sorted)."""
    g = hits.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("at", "len")).alias("_s"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.flatten(F.transform("_s", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))
    g = g.select("doc_id", "text_key", "items", F.sort_array(F.array_distinct(covered)).alias("_c"))
    c = F.col("_c")
    opens = F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1) < x - 1))
    closes = F.filter(c, lambda x, i: (i == F.size(c) - 1) | (F.get(c, i + 1) > x + 1))
    spans = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("at"), (b + 1).alias("end")))
    return g.select("doc_id", "text_key", "items", spans.alias("spans"), F.size(c).cast("long").alias("n_hit"))


def contamination(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (sorted strings), contaminated."""
    hits = merge_hits(window_hits(docs, items, width, id_col, text_col, item_id, item_text, broadcast_rows))
    base = docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"),
        F.size(plain_words(F.col(text_col))).cast("long").alias("n_words"),
    )
    j = base.alias("b").join(hits.alias("h"), _same_text("b", "h"), "left")
    none = F.array().cast("array<string>")
    return j.select(
        "b.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def remove_spans(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """docs with hit words, and the separators between them, cut from the text; other rows and columns unchanged.

    The few documents with hits are found by a join whose small side is checked for its size.
    """
    key, same, spans = private(docs, "_id", "_k", "_spans")
    hits = merge_hits(window_hits(docs, items, width, id_col, text_col, item_id, item_text)).select(
        F.col("doc_id").alias(key), F.col("text_key").alias(same), F.col("spans").alias(spans)
    )
    text = F.col(text_col)
    j = docs.join(small_side(hits), F.col(id_col).eqNullSafe(F.col(key)) & (text_key(text) == F.col(same)), "left")
    words = F.array_remove(F.split(text, NOT_WORD_RUN.replace(r"\x60", r"\x40\x5B-\x60")), "")
    gaps = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    # gap k stands before word k, also when it is empty; the last gap has no word
    pieces = F.zip_with(gaps, words, lambda gap, word: F.concat(gap, F.coalesce(word, F.lit(""))))
    inside = lambda k: F.exists(spans, lambda s: (k >= s["at"]) & (k < s["end"]))
    left = F.filter(pieces, lambda piece, k: ~inside(k))
    cut = F.when(F.col(spans).isNotNull(), F.array_join(left, "")).otherwise(text)
    return j.select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])
