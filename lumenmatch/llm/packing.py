"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised and cut into pieces of at most ``capacity`` ids. Only the histogram
of piece lengths (at most ``capacity`` numbers) reaches the driver. There a covering program
over configurations (multisets of lengths that fit a sequence) is solved by multiplicative
weights; each round prices configurations by a knapsack dynamic program over the weights.
The fractional solution is rounded down to whole sequences, and what is left is packed best
fit, longest first, a length and a class of equal sequences at a time. The plan says for
each length which ranks go where; pieces are ranked by length in the cluster, with counts
per (length, bucket), where buckets grow with the pieces, so a length that a third of all
pieces share stays spread.

Defined results: null text is empty and gives one piece with the closing id only. Repeated
rows, and rows with a null id, are packed each. A very long text is tokenised in segments
between blanks. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import release, text_chunks
from .common import materialize, small_batches

CAPACITY = 2048
END_ID = 0
ROUNDS = 300
EPSILON = 0.3
CACHE_BYTES = 24 << 20
SLICE_BYTES = 1 << 20
BUCKETS = 256
BUCKET_ROWS = 200_000
_KEY = 1 << 40


class _Words:
    """Ids of space- and newline-separated chunks; the tokenizer never merges across these."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: lower case, white space dropped, word ends marked: chunks between blanks are independent
        self.by_words = "Lowercase" in str(self.tokenizer.normalizer) and bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        # byte-level vocabularies show a byte without a printable Latin-1 character as the next one from U+0100
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in printable)}
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.held = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.used = 0

    def slots(self, words: list[str]) -> np.ndarray:
        if self.held > CACHE_BYTES:
            self.clear()
        known = self.slot
        new = [w for w in words if w not in known]
        for a in range(0, len(new), 20_000):
            self._add(new[a : a + 20_000])
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def _add(self, words: list[str]) -> None:
        """Plain lower-case Latin words need no normalising or splitting and go straight to the model."""
        plain = [w for w in words if w.isalpha() and w.islower() and (w.isascii() or (max(w) < "\u0250" and is_normalized("NFC", w)))]
        done = set(plain)
        rest = [w for w in words if w not in done]
        split = self.tokenizer.model.tokenize
        found = [[t.id for t in split(w if w.isascii() else self._shown(w))] for w in plain]
        self._put(plain, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))
        if rest:
            e = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            self._put(rest, np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(rest)))

    def _shown(self, word: str) -> str:
        """The characters that stand for the bytes of the word in the vocabulary."""
        return word.encode().decode("latin-1").translate(self.shown)

    def _put(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        first = len(self.slot)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while first + len(words) + 1 > len(self.start):
            self.start = np.r_[self.start, np.zeros_like(self.start)]
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first : first + len(words) + 1] = self.used + np.r_[0, np.cumsum(n)]
        self.used += len(ids)
        self.held += sum(map(len, words)) + 200 * len(words) + 4 * len(ids)  # about what Python takes for an entry
        self.slot.update(zip(words, range(first, first + len(words)), strict=True))


_words: dict[str, _Words] = {}


def _ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and where each text's ids start (plus the total)."""
    words = _words.get(path)
    if words is None:
        words = _words[path] = _Words(path)
    if not words.by_words:
        found = [e.ids for e in words.tokenizer.encode_batch(texts.cast(pa.large_string()).fill_null("").to_pylist(), add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)
    if len(texts) == 1 and len(whole := texts[0].as_py() or "") > SLICE_BYTES:
        parts = [_word_ids(pa.array([x], pa.large_string()), words)[0] for x in _segments(whole)]
        return np.concatenate(parts), np.array([0, sum(map(len, parts))])
    return _word_ids(texts.cast(pa.large_string()).fill_null(""), words)


def _segments(text: str) -> Iterator[str]:
    """Cuts of a long text at blanks, of about SLICE_BYTES characters."""
    at = 0
    while at < len(text):
        stop = text.find(" ", at + SLICE_BYTES)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop]
        at = stop + 1


def _word_ids(texts: pa.Array, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.replace_substring(texts, "\n", " ")
    if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else case could matter to a special token
        # fewer distinct chunks, the same ids: lower case, and a single mark after a letter is a token of its own
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-zß-öø-ÿ])([.,])( |$)", r"\1 \2\3")
    parts = pc.split_pattern(texts, " ")
    per_text = np.r_[0, np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    slot = words.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    n = words.start[slot + 1] - words.start[slot]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(words.start[slot] - (ends - n), n) + np.arange(total)
    return words.flat[at], np.r_[0, ends][per_text]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of the batch with about SLICE_BYTES of text together, one row at least."""
    for row, rows, _, _ in text_chunks(batch.column(1), SLICE_BYTES):
        yield batch.slice(row, rows)


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Tokenised pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                ids, cut = _ids(b.column(1), path)
                length = np.diff(cut) + 1
                full = np.full(len(ids) + len(length), end_id, "<u4")
                mask = np.ones(len(full), bool)
                mask[np.cumsum(length) - 1] = False
                full[mask] = ids
                n = -(-length // capacity)
                row = np.repeat(np.arange(len(length)), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = k * capacity
                size = np.minimum(length[row] - start, capacity)
                base = (np.cumsum(length) - length)[row] + start
                view = memoryview(full.tobytes())
                crc = [zlib.crc32(view[4 * x : 4 * (x + y)]) for x, y in zip(base.tolist(), size.tolist(), strict=True)]
                out = [b.column(0).take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                if keep_ids:
                    out.append(pa.array([full[x : x + y].astype(np.int32) for x, y in zip(base, size, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names)
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _price(weight: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of largest weight: an unbounded knapsack over lengths 1..capacity."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = weight[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(gain.argmax())
        best[c], pick[c] = gain[k], k + 1
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        n = int(pick[c])
        if weight[n] > 0:  # else n ids stay empty
            out[n] = out.get(n, 0) + 1
        c -= n
    return out


def fractional(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, eps: float = EPSILON) -> list[tuple[dict[int, int], float]]:
    """Multiplicative weights on the covering program: configurations and how many sequences each gets."""
    need = np.where(demand > 0, demand, 1).astype(float)
    log = np.where(demand > 0, 0.0, -np.inf)
    cover = np.zeros(capacity + 1)
    got: list[tuple[dict[int, int], float]] = []
    for _ in range(rounds):
        w = np.exp(log - log.max()) / need
        config = _price(np.where(np.arange(capacity + 1) > 0, w * 1e6, 0), capacity)
        step = min(need[n] / k for n, k in config.items())
        got.append((config, step))
        for n, k in config.items():
            cover[n] += k * step / need[n]
            log[n] -= eps * k * step / need[n]
    top = cover.max()
    return [(c, x / top) for c, x in got] if top > 0 else []


def plan(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Whole sequences: (configuration, how many), using up the demand exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in demand.items():
        left[n] = k
    out: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        out.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    if not left.any():
        return out
    solved = fractional(left, capacity, rounds)
    for share in (1.0, float("inf")):  # rounded down; then whole sequences that the rest still fills
        for config, x in solved:
            if sum(n * k for n, k in config.items()) < capacity:
                continue
            most = min(int(left[n]) // k for n, k in config.items())
            m = most if share > 1 else min(most, int(x))
            if m:
                out.append((config, m))
                for n, k in config.items():
                    left[n] -= k * m
    free: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    for n in range(capacity, 0, -1):
        c = int(left[n])
        while c:
            f = next((f for f in range(n, capacity + 1) if free[f]), None)
            config, m = free[f].pop() if f else ({}, c)
            f = f or capacity
            k = min(f // n, c)
            t = min(m, c // k)
            if m > t and config:
                free[f].append((config, m - t))
            free[f - k * n].append((config | {n: k}, t))
            c -= k * t
    return out + [x for group in free for x in group]


def _table(sequences: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Per (length, first rank): pieces of that length in a sequence, first sequence, first offset; sorted by key."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for config, m in sequences:
        offset = 0
        for n, k in sorted(config.items(), reverse=True):
            rows.append((n * _KEY + rank.get(n, 0), k, first, offset))
            rank[n] = rank.get(n, 0) + k * m
            offset += n * k
        first += m
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(cols[:, i]) for i in range(4))


def pack(found: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """found (with doc_id, piece, length) plus sequence_id and offset."""
    spark = found.sparkSession
    buckets = max(BUCKETS, found.count() // BUCKET_ROWS)
    found = found.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = materialize(found.groupBy("length", "_b").count())
    demand = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    table = spark.sparkContext.broadcast(_table(plan(demand, capacity, rounds)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    number = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1
    ranked = found.withColumn("_n", number).join(base, ["length", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_n")).drop("_b", "_base", "_n")
    names = [c for c in ranked.columns if c != "_rank"]
    schema = ranked.select(*names).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, per, first, offset = table.value
        for b in batches:
            n = b.column(b.schema.get_field_index("length")).to_numpy()
            r = b.column(b.schema.get_field_index("_rank")).to_numpy()
            at = np.searchsorted(key, n * _KEY + r, side="right") - 1
            within = r - (key[at] - n * _KEY)
            out = [b.column(b.schema.get_field_index(c)) for c in names]
            out += [pa.array(first[at] + within // per[at]), pa.array(offset[at] + within % per[at] * n)]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def _written(found: DataFrame) -> DataFrame:
    with small_batches(found.sparkSession):
        return materialize(found)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(_written(pieces(docs, path, capacity, id_col=id_col, text_col=text_col)), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (of all its pieces in order), doc_ids."""
    placed = pack(_written(pieces(docs, path, capacity, keep_ids=True, id_col=id_col, text_col=text_col)), capacity)
    g = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return g.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
