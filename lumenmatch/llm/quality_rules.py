"""Quality rules by cross-document line frequency (native expressions only).

One pass over the texts gives each document's counts and its lines, normalised (A-Z lower-cased,
blank runs to one space) and hashed; the rest works on these. Per host the distinct documents
that carry a line are counted. A line on more than ``max(min_documents, share * documents of the
host)`` of them is a candidate.

A candidate is boilerplate if its carriers differ in what else they say: each carrier votes with
the longest word outside its candidate lines (none, if all its lines are candidates), and the
line needs more distinct votes than documents are allowed. Copies, exact or edited, say the same
and give few votes however many they are; pages that share a banner give nearly one each.

Boilerplate lines are removed. A document is depleted, and rejected, if fewer than MIN_WORDS
words are left of it or more than ``depleted_percent`` of its words are gone.

A host has at most (lines a document / share) candidates, so they fit an array a host. A document
is a (doc_id, text); repeated rows count once.

Defined results: null text is empty, has zero counts and fails the base rule. A null host
is a host of its own. Repeated rows get the same verdict each. An empty table gives an
empty result. Extra columns are ignored by ``judge`` and kept by ``clean_documents``. Of rows that
repeat an id and a text under several hosts, all go if one is rejected, and the lines of one host go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, LOWER, UPPER, blank_words, counted_side, join_skewed, lower_ascii, materialize, private, small_side, text_key

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCUMENTS = 5
SHARE = 0.03
DEPLETED_PERCENT = 70
HOSTS = 2000  # rows with arrays that are still broadcast


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, and only where the result is needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(windows: Column) -> Column:
    """Words in windows of three (given by their hashes in order) that occur twice or more."""

    def places(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(none, F.lit(0)).otherwise(_let(_let(ordered, places), covered)).cast("long")


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: doc_id, text_key, host, the base counts, base_failed, lines (pos, h, words, longest) that have a word."""
    text = F.col("_t")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select(
        "doc_id", "host", text_key(text).alias("text_key"), F.split(text, "\n").alias("_l"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    d = d.withColumn("_w", F.transform("_l", blank_words)).withColumn("_words", F.flatten("_w"))
    words = F.col("_words")
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    full = F.filter("_l", lambda x, i: F.size(F.get(F.col("_w"), i)) > 0)
    longest = lambda w: F.array_max(F.transform(w, lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))
    line = lambda w, i: F.struct(
        i.alias("pos"), F.xxhash64(lower_ascii(F.array_join(w, " "))).alias("h"), F.size(w).alias("words"), longest(w).alias("longest")
    )
    d = d.select(
        "doc_id", "text_key", "host", "word_chars", "n_symbols", F.size(words).cast("long").alias("n_words"), full.alias("_full"),
        F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))).alias("_h"),
        F.filter(F.transform("_w", line), lambda x: x["words"] > 0).alias("lines"),
    )
    d = d.select(
        "doc_id", "text_key", "host", "n_words", "word_chars", "n_symbols",
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_h")).alias("n_repeat_words"), "lines",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def _same_host(a: str, b: str) -> Column:
    return F.col(f"{a}.host").eqNullSafe(F.col(f"{b}.host"))


def _with_host_lines(rows: DataFrame, lines: DataFrame, *aggregates: Column) -> DataFrame:
    """rows with known, the lines (host, h) of their host (null if it has none), and the aggregates of these.

    Beyond HOSTS hosts the look-up is a join on the host, of which the hosts with many rows are broadcast.
    """
    found, small = counted_side(lines.groupBy(F.col("host").alias("_host")).agg(F.collect_list("h").alias("known"), *aggregates), HOSTS)
    if small:
        return rows.join(found, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    key = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), c))
    return join_skewed(rows.withColumn("_key", key("host")), found.withColumn("_key", key("_host")).drop("_host"), "_key").drop("_key")


def frequent_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """Boilerplate lines of document_lines(..): host, h."""
    hashes = F.transform("lines", lambda x: x["h"])
    texts = rows.where(F.size("lines") > 0).select("host", "doc_id", "text_key", "lines")
    hosts = texts.select("host", "doc_id", "text_key").distinct().groupBy("host").agg(
        F.greatest(F.lit(float(min_documents)), share * F.count("*")).alias("limit")
    )
    counts = texts.select("host", "doc_id", "text_key", F.explode(F.array_distinct(hashes)).alias("h")).distinct()
    counts = counts.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > min_documents)
    found = counts.alias("c").join(hosts.alias("n"), _same_host("c", "n")).where(F.col("docs") > F.col("limit"))
    carriers = _with_host_lines(texts, found.select("c.host", "h", "limit"), F.max("limit").alias("limit")).where(F.col("known").isNotNull())
    carriers = carriers.select("host", "limit", "lines", F.array_intersect(hashes, F.col("known")).alias("has"))
    rest = F.filter("lines", lambda x: ~F.array_contains(F.col("has"), x["h"]))
    vote = F.coalesce(F.array_max(F.transform(rest, lambda x: x["longest"]))["word"], F.lit(""))
    votes = carriers.where(F.size("has") > 0).select("host", "limit", F.explode("has").alias("h"), vote.alias("vote"))
    votes = votes.groupBy("host", "h", "vote").agg(F.max("limit").alias("limit"))
    votes = votes.groupBy("host", "h").agg(F.count("*").alias("n"), F.max("limit").alias("limit"))
    return votes.where(F.col("n") > F.col("limit")).select("host", "h")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_documents: int = MIN_DOCUMENTS, share: float = SHARE, depleted_percent: int = DEPLETED_PERCENT,
) -> DataFrame:
    """Per row of docs: doc_id, text_key, the base counts, base_failed, removed_words, positions (removed lines) and kept."""
    rows = materialize(document_lines(docs, id_col, text_col, host_col))
    joined = _with_host_lines(rows, frequent_lines(rows, min_documents, share))
    hit = F.when(F.col("known").isNull(), F.array().cast(rows.schema["lines"].dataType)).otherwise(
        F.filter("lines", lambda x: F.array_contains("known", x["h"]))
    )
    joined = joined.withColumn("_hit", hit).drop("lines", "host", "known")
    gone = F.aggregate("_hit", F.lit(0), lambda a, x: a + x["words"]).cast("long")
    out = joined.withColumn("removed_words", gone).withColumn("positions", F.transform("_hit", lambda x: x["pos"])).drop("_hit")
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (100 * F.col("removed_words") <= depleted_percent * F.col("n_words")))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, their texts without boilerplate lines, with all other columns as they are."""
    key, text, kept, gone = private(docs, "_id", "_k", "_kept", "_gone")
    verdict = judge(docs, id_col, text_col, host_col)
    changes = verdict.where(~F.col("kept") | (F.size("positions") > 0)).groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(text)).agg(
        F.min("kept").alias(kept), F.min("positions").alias(gone)
    )
    mine = F.col(id_col).eqNullSafe(F.col(key)) & (text_key(F.col(text_col)) == F.col(text))
    joined = docs.join(small_side(changes), mine, "left").where(F.coalesce(F.col(kept), F.lit(True)))
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    return joined.withColumn(text_col, F.when(F.size(gone) > 0, left).otherwise(F.col(text_col))).drop(key, text, kept, gone)


def judge_sql(table: str = "documents") -> str:
    """The columns of the registered query as SQL."""
    words = f"list_filter(regexp_split_to_array({{}}, '{BLANK_RUN}'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM {table}),
w AS (SELECT rid, {words.format('t')} AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, CAST(len(w) AS BIGINT) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM again) GROUP BY rid),
cut AS (SELECT rid, doc_id, host, t, unnest(string_split(t, chr(10))) AS x FROM d),
lines AS (SELECT rid, doc_id, host, t, x, translate(array_to_string(w, ' '), '{UPPER}', '{LOWER}') AS line, len(w) AS words,
  list_sort(list_transform(w, lambda y: struct_pack(n := length(y), word := y)))[-1] AS longest
  FROM (SELECT *, {words.format('x')} AS w FROM cut) WHERE len(w) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY rid),
hosts AS (SELECT host, greatest({MIN_DOCUMENTS}, {SHARE} * count(DISTINCT (doc_id, t))) AS most FROM lines GROUP BY host),
cands AS (SELECT l.host, l.line, most FROM lines l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host GROUP BY ALL HAVING count(DISTINCT (doc_id, t)) > most),
flagged AS (SELECT l.*, most FROM lines l LEFT JOIN cands c ON l.host IS NOT DISTINCT FROM c.host AND l.line = c.line),
votes AS (SELECT rid, max(CASE WHEN most IS NULL THEN longest END).word AS vote FROM flagged GROUP BY rid),
boiler AS (SELECT host, line FROM flagged JOIN votes USING (rid) WHERE most IS NOT NULL GROUP BY host, line, most HAVING count(DISTINCT coalesce(vote, '')) > most),
gone AS (SELECT rid, sum(words) AS n FROM lines l JOIN boiler b ON l.host IS NOT DISTINCT FROM b.host AND l.line = b.line GROUP BY rid),
counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{BLANK_RUN}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  CAST(coalesce(g.n, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN repeated r USING (rid) LEFT JOIN gone g USING (rid)),
ruled AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND n_words - removed_words >= {MIN_WORDS} AND 100 * removed_words <= {DEPLETED_PERCENT} * n_words AS kept FROM ruled
"""
