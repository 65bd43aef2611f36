"""Language identification by rank-order n-gram profiles.

A language's profile is its PROFILE most frequent n-grams (1 to 3 letters, words padded
with a blank) in rank order, learned from at most SAMPLE labelled documents a language
(chosen by a hash of the id). A document's own ranking is compared with each profile: the
out-of-place distance sums how far each n-gram's ranks lie apart, PROFILE where the profile
lacks it. The nearest language wins, ties by name.

Defined results: null text, or text without letters, is ``und`` with score 0. Whole texts
are ranked. Rows without a language are never learned from. With nothing to learn from all
is ``und``. N-grams of one count rank by code. Repeated rows, and rows with a null id, are judged
each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROFILE = 300
SAMPLE = 4000
NONE = "und"
_SPLIT = 1 << 60
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as packed code points, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    full = is_letter()[codes]
    if not full.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.where(full, codes, 32).astype(np.int64)
    c = c[full | np.r_[False, full[:-1]]]
    c = np.pad(c, (1, int(c[-1] != 32)), constant_values=32)
    pair = c[:-1] | (c[1:] << 21)
    return np.unique(np.concatenate([c[c != 32], pair, pair[:-1] | (c[2:] << 42)]), return_counts=True)


def ranking(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    grams, counts = ngram_counts(text)
    return grams[np.lexsort((grams, -counts))[:size]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def profiles(labelled: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> dict[str, np.ndarray]:
    """labelled (doc_id, text, lang) -> ranked n-grams by language. Only profiles come to the driver."""
    named = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r.lang: min(1.0, sample / r["n"]) for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    cut = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * _SPLIT))])
    some = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SPLIT)) < cut[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.setdefault(lang, []).append(ngram_counts(text))
            for lang, found in total.items():
                grams, where = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
                total[lang] = [(grams, np.bincount(where, np.concatenate([x[1] for x in found]), len(grams)).astype(np.int64))]
        for lang, ((grams, counts),) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    sums = some.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in sums.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def distances(ranked: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Out-of-place distance to each profile, given as (sorted n-grams, their ranks)."""
    out = np.zeros(len(known))
    place = np.arange(len(ranked))
    for k, (grams, ranks) in enumerate(known):
        at = np.minimum(np.searchsorted(grams, ranked), len(grams) - 1)
        out[k] = np.where(grams[at] == ranked, np.abs(ranks[at] - place), size).sum()
    return out


def identify(
    docs: DataFrame, learned: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE,
) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (one minus the distance as a share of the largest possible)."""
    names = sorted(learned)
    known = [(np.sort(learned[n]), np.argsort(learned[n])) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, score = [], []
            for text in b.column(1).to_pylist():
                ranked = ranking(text, size) if text and known else ()
                if len(ranked):
                    d = distances(ranked, known, size)
                    k = int(d.argmin())
                    found.append(names[k])
                    score.append(1.0 - float(d[k]) / (size * len(ranked)))
                else:
                    found.append(NONE)
                    score.append(0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
