"""Quality classifier by co-training of a text view and a metadata view.

Text view: how often up to VOCABULARY telling words and word beginnings occur (chosen from the
labelled sample by the difference of their document shares), and character-class shares of the
whole text. Metadata view: source, language and length columns. Each view is a logistic
regression. Over ROUNDS rounds each view scores all unlabelled documents, and its most confident
ones of either class, CONFIDENT of all but at most EXCHANGE, join the other view's training set
with that label; documents with equal features count once. A held-out part of the labels
calibrates both views and weighs them into one score for every document. The threshold keeps
KEEP of the held-out good documents.

Bounds: at most SAMPLE labelled documents of each class, chosen by a hash of the id, and EXCHANGE
pseudo-labelled ones a view, class and round train the model; their features, of fixed size,
reach the driver. Counts over the vocabulary, the search for confident documents and the scores
cover all documents by their whole texts.

Defined results: null text is empty, null metadata is a value of its own. Labels that are
null, or of unknown documents, are left out; of repeated labels a bad one wins. Rows that repeat
an id train once; rows with a null id are unlabelled and scored. With fewer than LEAST labels of
a class, or too few in either part, there is no model: the score is 1 and all documents are kept.
Ties in confidence go by a hash of the features. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import materialize, small_side

SAMPLE = 2500
EXCHANGE = 500
LEAST = 30
VOCABULARY = 512
ROUNDS = 3
CONFIDENT = 0.05
KEEP = 0.995
META = 128
BEGINNINGS = (5, 7)

_WORD = np.ones(256, bool)
_WORD[:128] = [chr(c).isalnum() for c in range(128)]
_CLASSES = np.zeros((7, 256), bool)
for _k, _s in enumerate(("#*$%&<>^~=+@", "|_\\/{}[]()", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", "!?;:\"'")):
    _CLASSES[_k, [ord(c) for c in _s]] = True


def text_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts and of their first bytes, the text of each, and the words of each text."""
    data = A.LOWER_TABLE[data]
    full = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(full & (edge[:-1] | ~np.r_[True, full[:-1]]))
    ends = np.flatnonzero(full & (edge[1:] | ~np.r_[full[1:], True])) + 1
    s = A.prefix_hash(data)
    words = np.diff(np.searchsorted(starts, off))
    text = np.repeat(np.arange(len(words)), words)
    h, where = [A.span_hash(s, starts, ends)], [text]
    for n in BEGINNINGS:
        longer = ends - starts > n
        h.append(A.mix(A.span_hash(s, starts[longer], starts[longer] + n) + np.uint64(n)))
        where.append(text[longer])
    return np.concatenate(h), np.concatenate(where), words


def text_features(column: pa.Array, vocabulary: np.ndarray) -> np.ndarray:
    """Presence and rate of the vocabulary in steps of 1/255, and character-class shares; one row per text."""
    seen = np.zeros((len(column), len(vocabulary)), np.float32)
    rest = np.zeros((len(column), len(_CLASSES) + 2), np.float32)
    for first, rows, data, off in A.text_chunks(column):
        h, text, words = text_hashes(data, off)
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[at] == h
            count = np.bincount(text[hit] * len(vocabulary) + at[hit], minlength=rows * len(vocabulary)).reshape(rows, -1)
            rate = np.minimum(1, 25 * count / np.maximum(words, 1)[:, None])
            seen[first : first + rows] = np.round(255 * (0.5 * (count > 0) + 0.5 * rate)) / 255
        size = np.maximum(np.diff(off), 1)
        for k, members in enumerate(_CLASSES):
            total = np.r_[0, np.cumsum(members[data])]
            rest[first : first + rows, k] = 10 * (total[off[1:]] - total[off[:-1]]) / size
        rest[first : first + rows, -2] = np.log1p(words) / 4
        rest[first : first + rows, -1] = np.minimum(size / np.maximum(words, 1), 30) / 10
    return np.concatenate([seen, rest], 1)


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, and a bucket of the length."""
    out = np.zeros((len(source), META + 2), np.float32)
    for r, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        for name in (f"s{s}", f"l{g}", f"n{None if n is None else int(max(n, 0)).bit_length()}"):
            out[r, xxhash.xxh64_intdigest(name.encode()) % META] = 1
        out[r, META] = 0 if n is None else np.log1p(max(n, 0)) / 8
        out[r, META + 1] = n is None
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    weight = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        g = x.T @ (weight * (p - y)) + penalty * beta
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        beta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return beta


def _apply(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1].astype(x.dtype) + beta[-1]


class Model:
    """Vocabulary, the two views' coefficients, their combination and the threshold."""

    def __init__(self, vocabulary, text, meta, mix, threshold):
        self.vocabulary, self.text, self.meta, self.mix, self.threshold = vocabulary, text, meta, mix, threshold

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = _apply(text, self.text), _apply(meta, self.meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(np.c_[a, b] @ self.mix[:2] + self.mix[2])


def vocabulary_of(known: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """The words and beginnings whose shares of the documents of known (good, text) differ most between the classes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = b.column(0).to_numpy(zero_copy_only=False)
            for first, rows, data, off in A.text_chunks(b.column(1)):
                h, text, _ = text_hashes(data, off)
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(good[first + text[new]].astype(np.int32))], ["h", "good"])

    n = {r.good: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    counts = known.select("good", "text").mapInArrow(run, "h long, good int").groupBy("h").agg(
        F.sum("good").alias("k1"), F.sum(1 - F.col("good")).alias("k0")
    )
    share = lambda k: (F.col(f"k{k}") + 0.5) / (n.get(k, 0) + 1)
    gain = F.abs(F.log(share(0) / share(1)))
    best = counts.where(F.col("k0") + F.col("k1") >= 8).select("h", gain.alias("gain")).where(F.col("gain") > 0.5)
    return np.sort(np.array([r.h for r in best.orderBy(F.desc("gain"), "h").limit(size).collect()], np.int64).view(np.uint64))


_FEATURES = "doc_id long, seen binary, rest binary, source string, lang string, n_chars long"


def features(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per row of docs (doc_id, text, source, lang, n_chars): the text's features, a byte each for the vocabulary, and the metadata."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                b = whole.slice(a, 2000)
                x = text_features(b.column(1), vocabulary)
                seen, rest = np.round(255 * x[:, :size]).astype(np.uint8), x[:, size:]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([r.tobytes() for r in seen], pa.binary()), pa.array([r.tobytes() for r in rest], pa.binary()), *b.columns[2:]],
                    ["doc_id", "seen", "rest", "source", "lang", "n_chars"],
                )

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, _FEATURES)


def _views(seen: list[bytes], rest: list[bytes], source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(b"".join(seen), np.uint8).reshape(len(seen), -1).astype(np.float32) / np.float32(255)
    shape = np.frombuffer(b"".join(rest), np.float32).reshape(len(rest), -1)
    return np.concatenate([words, shape], 1), meta_features(source, lang, n_chars)


def _confident(pool: DataFrame, beta: list[np.ndarray], n: int) -> list[tuple]:
    """(view that says so, label, features) of the n most confident documents of the pool by each view and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            views = _views(*(c.to_pylist() for c in b.columns[1:]))
            p = [pa.array(_sigmoid(_apply(x, w)), pa.float64()) for x, w in zip(views, beta, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *p], [*b.schema.names, "p0", "p1"])

    scored = materialize(pool.mapInArrow(run, f"key long, {_FEATURES.removeprefix('doc_id long, ')}, p0 double, p1 double"))
    out = []
    for view in (0, 1):
        p = F.col(f"p{view}")
        for label, sure, order in ((0, p < 0.05, p), (1, p > 0.95, -p)):
            rows = scored.where(sure).orderBy(order, "key").limit(n).drop("p0", "p1").collect()
            out += [(view, label, r) for r in rows]
    return out


def _one_each(df: DataFrame) -> DataFrame:
    """Of the rows of each doc_id the smallest."""
    return df.groupBy("doc_id").agg(F.min(F.struct(*[c for c in df.columns if c != "doc_id"])).alias("r")).select("doc_id", "r.*")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exchange: int = EXCHANGE) -> Model | None:
    """docs (doc_id, text, source, lang, n_chars) and labels (doc_id, good 0/1) -> Model."""
    labels = labels.dropna().groupBy("doc_id").agg(F.min("good").cast("int").alias("good"))
    labels = labels.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0)
    some = [labels.where(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = materialize(some[0].unionByName(some[1]))
    known = materialize(_one_each(docs.join(F.broadcast(chosen), "doc_id")))
    have = {(r.good, r.held): r["n"] for r in known.groupBy("good", "held").agg(F.count("*").alias("n")).collect()}
    if any(have.get((k, True), 0) + have.get((k, False), 0) < LEAST or min(have.get((k, h), 0) for h in (True, False)) < 5 for k in (0, 1)):
        return None
    vocabulary = vocabulary_of(known.where(~F.col("held")))
    feats = materialize(features(docs, vocabulary))
    pool = feats.join(small_side(labels.select("doc_id")), "doc_id", "left_anti").drop("doc_id").distinct()
    pool = materialize(pool.select(F.xxhash64(*pool.columns).alias("key"), "*"))
    n = min(exchange, max(1, int(CONFIDENT * pool.count())))
    rows = _one_each(feats.join(F.broadcast(chosen), "doc_id")).orderBy("doc_id").collect()
    text, meta = _views(*([r[c] for r in rows] for c in ("seen", "rest", "source", "lang", "n_chars")))
    good, held = np.array([r.good for r in rows]), np.array([r.held for r in rows])
    x = [text[~held], meta[~held]]
    y = good[~held]
    beta = [logistic(v, y) for v in x]
    taught: tuple[dict, dict] = ({}, {})  # for each view, what the other taught it: key -> (label, row)
    for _ in range(ROUNDS):
        for view, label, row in _confident(pool, beta, n):
            taught[1 - view][row.key] = (label, row)
        for view, learned in enumerate(taught):
            if learned:
                label = np.array([k for k, _ in learned.values()])
                more = _views(*([r[c] for _, r in learned.values()] for c in ("seen", "rest", "source", "lang", "n_chars")))[view]
                weight = np.r_[np.ones(len(y)), np.full(len(label), 0.3)]
                beta[view] = logistic(np.concatenate([x[view], more]), np.r_[y, label], weight)
    z = np.c_[_apply(text[held], beta[0]), _apply(meta[held], beta[1])].astype(np.float64)
    mix = logistic(z, good[held].astype(float))
    kept = np.sort(_sigmoid(z @ mix[:2] + mix[2])[good[held] == 1])
    return Model(vocabulary, beta[0], beta[1], mix, min(0.5, float(kept[int((1 - KEEP) * len(kept))])))


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of docs (doc_id, text, source, lang, n_chars): doc_id, p_text, p_meta, score, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                b = whole.slice(a, 2000)
                if model is None:
                    p = (np.ones(b.num_rows),) * 3
                else:
                    p = model.score(text_features(b.column(1), model.vocabulary), meta_features(*(c.to_pylist() for c in b.columns[2:])))
                kept = p[2] >= (model.threshold if model else 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[pa.array(x, pa.float64()) for x in p], pa.array(kept)], ["doc_id", "p_text", "p_meta", "score", "kept"]
                )

    schema = "doc_id long, p_text double, p_meta double, score double, kept boolean"
    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, schema)
