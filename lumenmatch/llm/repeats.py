"""Removal of byte strings that an earlier document has, by depth-limited radix passes over suffixes.

A byte is removed if a ``LENGTH``-byte string that covers it also starts in a document with
a smaller id. Suffixes are ordered most significant digit first, only as deep as that takes;
each pass keeps the groups that still span documents and closes the others:

1. First digit: the ``DEPTH``-byte gram at a sampled position. Every window of LENGTH bytes is
   represented by the smallest hashed gram in it, so equal windows meet under the same gram.
   Grams of one document only are closed. In a group of equal whole contexts (all bytes that
   a window through the gram can have) all documents but the first are covered entirely.
2. Further digits: the bytes of the contexts still open go to their gram's bucket and are
   ordered there byte by byte, to the right of the gram and, backwards, to its left. Common
   prefix lengths of neighbours say which suffixes agree to which depth; at full depth LENGTH,
   groups are exactly the repeated windows, and the smallest document of each covers the others.
3. Grams that occur very often in the corpus (by bucket counts over all documents) would be one
   large group. They are dealt by context in pass 1, and in pass 2 every distinct window goes
   by a fingerprint of its own, one record for all its places in a batch.

Bytes are compared in pass 2. Hashes only bring records together, but for whole contexts (80
bits beside the gram's 48) and windows of frequent grams (128 bits), where they stand for them.

Defined results: null text is empty; documents under LENGTH bytes lose nothing; repeats
inside one document stay. Rows that repeat an id are one document: each is judged by its own
text, and none covers another with the same id. Rows with a null id are kept whole and cover
nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import materialize, partitions, small_batches, small_side, text_key

LENGTH = 50
DEPTH = 16
FLUSH = 200_000
HOT_LEAST = 20_000
HOT_FACTOR = 8
MAX_SKETCH_BITS = 20
TASK_ROWS = 1 << 21
SLICE = 1000
_TOP = np.uint64((1 << 64) - 1)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, which bounds what a task holds at once."""
    for b in batches:
        for a in range(0, b.num_rows, SLICE):
            yield b.slice(a, SLICE)
        pa.default_memory_pool().release_unused()


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every width consecutive values; len(x) - width + 1 values."""
    if len(x) < width:
        return x[:0]
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, off: np.ndarray, length: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the grams that represent windows, their hashes, and the prefix hashes of data."""
    s = A.prefix_hash(data)
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), s
    width = length - depth + 1
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # bytes up to the end of the document
    at = np.arange(n - depth + 1)
    h = A.span_hash(s, at, at + depth)
    h[left[: len(h)] < depth] = _TOP
    low = _slide(h, width, np.minimum)
    low[left[: len(low)] < length] = 0
    pad = np.zeros(width - 1, np.uint64)
    best = _slide(np.r_[pad, low, pad], width, np.maximum)
    pos = np.flatnonzero((best[: len(h)] == h) & (h != 0) & (h != _TOP))
    return pos, h[pos], s


def _first_of(key: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys then doc; with it the start flags of equal keys and each row's smallest doc, in that order."""
    order = np.lexsort((doc, *key[::-1]))
    new = _starts([k[order] for k in key], len(order))
    at = np.flatnonzero(new)
    return order, new, np.repeat(doc[order][at], np.diff(np.r_[at, len(order)]))


def _starts(key: list[np.ndarray], n: int) -> np.ndarray:
    """Where a row of sorted keys differs from the one before."""
    new = np.zeros(n, bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    return new


def _wide(new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows lie in groups (from their start flags) of several documents."""
    at = np.flatnonzero(new)
    if not len(at):
        return new
    return np.repeat(np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at), np.diff(np.r_[at, len(doc)]))


#: A row of a gram at byte pos: state 0 open, 1 covered, 2 open and frequent; mask has bit o for a covered window that
#: starts at pos - (LENGTH - DEPTH) + o. twin is 0, or tells apart the texts of a repeated id.
_ROWS = "doc_id long, twin long, pos int, state int, mask long"
_ALL = -1


def _rows(doc: np.ndarray, twin: np.ndarray, pos: np.ndarray, state: np.ndarray | int, mask: np.ndarray | int) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc.astype(np.int64)), pa.array(twin.astype(np.int64)), pa.array(pos.astype(np.int32)),
            pa.array(np.broadcast_to(np.int32(state), n).astype(np.int32)), pa.array(np.broadcast_to(np.int64(mask), n).astype(np.int64)),
        ],
        ["doc_id", "twin", "pos", "state", "mask"],
    )


def _squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _spread(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _tagged(rows: pa.RecordBatch | None, blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows that are settled already (bucket -1, as a blob) and blobs for the exchange."""
    out = list(blobs)
    if rows is not None and rows.num_rows:
        out.append((-1, A.pack([rows.column(k).to_numpy() for k in (0, 1, 2, 4)])))
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array([b[0] for b in out], pa.int32()), pa.array([_squeeze(b[1]) for b in out], pa.binary())], ["bucket", "blob"]
        )


def _exchange(tagged: DataFrame, work) -> DataFrame:
    """work on the blobs of each bucket; blobs of bucket -1 hold finished rows."""

    def run(t: pa.Table) -> pa.Table:
        blobs = [_spread(x) for x in t.column("blob").to_pylist()]
        if t.column("kind")[0].as_py() < 0:
            doc, twin, pos, mask = A.unpack(blobs, ["int64", "int64", "int32", "int64"])
            return pa.Table.from_batches([_rows(doc, twin, pos, 1, mask)])
        return pa.Table.from_batches([work(blobs, t.column("bucket")[0].as_py())])

    # finished rows travel in the same exchange, spread by their content
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("blob"), F.lit(1 << 30)).cast("int")).otherwise(F.col("bucket"))
    kind = F.when(F.col("bucket") < 0, F.lit(-1)).otherwise(F.lit(0))
    return tagged.select(kind.alias("kind"), spread.alias("bucket"), "blob").groupBy("kind", "bucket").applyInArrow(run, _ROWS)


def frequent_grams(docs: DataFrame, length: int, depth: int, least: int):
    """What tells frequent grams, by bucket counts over the anchors of all documents, and how many anchors there are."""

    def hashes(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, off in A.text_chunks(b.column(0)):
            yield anchors(data, off, length, depth)[1]

    bits = min(MAX_SKETCH_BITS, max(16, docs.count().bit_length()))
    counts = A.bucket_totals(docs.select("text"), hashes, bits)
    hot = np.packbits(counts >= max(least, min(HOT_FACTOR * counts.mean(), max(TASK_ROWS, 2 * counts.mean()))))
    return docs.sparkSession.sparkContext.broadcast((hot, bits)), int(counts.sum())


def _is_hot(held, gram: np.ndarray) -> np.ndarray:
    hot, bits = held.value
    at = (gram >> np.uint64(64 - bits)).astype(np.int64)
    return (hot[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _buckets(docs: DataFrame, rows: int) -> int:
    """As many buckets as keep each at about TASK_ROWS of the counted rows."""
    return max(2 * partitions(docs.sparkSession), -(-rows // TASK_ROWS))


def gram_rows(docs: DataFrame, length: int, depth: int, held, rows: int) -> DataFrame:
    """First digit: grams shared by documents, as rows: covered where the whole context is in a smaller document, else open."""
    buckets = _buckets(docs, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for b in batches:
            ids, twins = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, _, data, off in A.text_chunks(b.column(2)):
                pos, h, s = anchors(data, off, length, depth)
                row = np.searchsorted(off, pos, side="right") - 1
                a = np.maximum(off[row], pos - (length - depth))
                e = np.minimum(off[row + 1], pos + length)
                ctx = A.mix(A.span_hash(s, a, e) + (pos - a).astype(np.uint64) * np.uint64(1 << 20))
                more = A.span_hash(A.prefix_hash(data, 1), a, e, 1).astype(np.uint16)
                parts.append((h, ctx, more, ids[first + row], twins[first + row], (pos - off[row]).astype(np.uint32)))
                waiting += len(pos)
                if waiting > FLUSH:
                    yield from flush(parts)
                    parts, waiting = [], 0
        if waiting:
            yield from flush(parts)

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        gram, ctx, more, doc, twin, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, _, least = _first_of([gram, ctx, more], doc)
        gram, ctx, more, doc, twin, pos = (x[order] for x in (gram, ctx, more, doc, twin, pos))
        done = least < doc
        own = _rows(doc[done], twin[done], pos[done], 1, _ALL)
        gram, ctx, more, doc, twin, pos = (x[~done] for x in (gram, ctx, more, doc, twin, pos))
        hot = _is_hot(held, gram)
        key = np.where(hot, A.mix(gram ^ ctx), A.mix(gram))
        low, high = gram.astype(np.uint32), (gram >> np.uint64(32)).astype(np.uint16)
        yield from _tagged(own, list(A.dealt(key, [low, high, ctx, more, doc, twin, pos, hot.astype(np.uint8)], buckets)))

    def settle(blobs: list[bytes], _: int) -> pa.RecordBatch:
        low, high, ctx, more, doc, twin, pos, hot = A.unpack(blobs, ["uint32", "uint16", "uint64", "uint16", "int64", "int64", "uint32", "uint8"])
        gram = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        order, new, least = _first_of([gram, ctx, more], doc)
        gram, doc, twin, pos, hot = gram[order], doc[order], twin[order], pos[order], hot[order] == 1
        done = least < doc
        group = _starts([gram], len(gram))
        keep = done | hot | (_wide(group, doc) & _wide(group, np.cumsum(new)))
        state = np.where(done, 1, np.where(hot, 2, 0))
        return _rows(doc[keep], twin[keep], pos[keep], state[keep], np.where(done, _ALL, 0)[keep])

    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "twin", "text")
    return _exchange(known.mapInArrow(run, "bucket int, blob binary"), settle)


def _sieved(docs: DataFrame, sieve) -> DataFrame:
    """Documents whose id may be in the sieve, with the text compressed for an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            b = b.filter(pa.array(sieve.value.passes(b.column(0))))
            texts = b.column(2).cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([_squeeze(x) for x in texts], pa.binary())], ["doc_id", "twin", "text"])

    return docs.select("doc_id", "twin", "text").mapInArrow(run, "doc_id long, twin long, text binary")


def _opened(texts: pa.Array) -> list[bytes]:
    return [_spread(x) if x else b"" for x in texts.to_pylist()]


def _agreeing(side: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group, then by the bytes of side; and how many bytes each shares with the row before (-1: other group).

    The bytes are taken most significant digit first, eight to a digit. A pass orders the rows
    of the groups still open by their next digit, and closes those that are then alone.
    """
    n, width = side.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = side
    digits = padded.view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    place, group = np.arange(n), groups[order]
    for digit in digits.T:
        new = _starts([group], len(place))
        at = np.flatnonzero(new)
        open_ = np.repeat(np.diff(np.r_[at, len(place)]) > 1, np.diff(np.r_[at, len(place)]))
        place, group = place[open_], group[open_]
        if not len(place):
            break
        rows = order[place]
        by = np.lexsort((digit[rows], group))
        order[place] = rows = rows[by]
        group = np.cumsum(_starts([group, digit[rows]], len(place)))
    side, groups = side[order], groups[order]
    differs = side[1:] != side[:-1]
    shared = np.where(differs.any(1), differs.argmax(1), width)
    return order, np.r_[-1, np.where(groups[1:] == groups[:-1], shared, -1)][:n]


def _class_at(depth: int, order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its group of rows that agree to depth bytes, and the size of that group."""
    number = np.cumsum(shared < depth) - 1
    out = np.empty(len(order), np.int64)
    out[order] = number
    return out, np.bincount(number, minlength=1)[out]


def covered_masks(context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, length: int, depth: int) -> np.ndarray:
    """Which windows of each row a smaller document has too, by radix passes over the bytes of the contexts.

    context: n rows of (length - depth) bytes, the gram, (length - depth) bytes; left and right
    are how many of the outer bytes exist.
    """
    side = length - depth
    mask = np.zeros(len(doc), np.int64)
    alone = np.zeros(len(doc), np.int64)
    order, shared = _agreeing(context[:, side : side + depth], alone)
    group, _ = _class_at(depth, order, shared)
    wide = np.zeros(len(doc), bool)
    wide[order] = _wide(shared < depth, doc[order])
    open_ = np.flatnonzero(wide)
    if not len(open_):
        return mask
    context, left, right, doc, group = context[open_], left[open_], right[open_], doc[open_], group[open_]
    after = _agreeing(context[:, side + depth :], group)
    before = _agreeing(context[:, :side][:, ::-1], group)
    for o in range(side + 1):
        to_right, many = _class_at(o, *after)
        to_left, some = _class_at(side - o, *before)
        rows = np.flatnonzero((many > 1) & (some > 1) & (left >= side - o) & (right >= o))
        by, _, least = _first_of([to_left[rows], to_right[rows]], doc[rows])
        hit = rows[by[least < doc[rows][by]]]
        mask[open_[hit]] |= np.int64(1) << np.int64(o)
    return mask


def window_rows(docs: DataFrame, open_grams: DataFrame, length: int, depth: int) -> DataFrame:
    """Further digits: open grams whose windows a smaller document has too, as covered rows with a mask.

    The context bytes of a gram go to the gram's bucket and are ordered there. Frequent grams send
    fingerprints of their windows instead, dealt by these.
    """
    side = length - depth
    # a frequent gram sends up to each of its windows
    buckets = _buckets(docs, 4 * (open_grams.agg(F.sum(F.when(F.col("state") == 2, side + 1).otherwise(1))).first()[0] or 0))
    size = 2 * side + depth
    grams = F.collect_list(F.when(F.col("state") == 0, F.col("pos")))
    wanted = open_grams.groupBy("doc_id", "twin").agg(grams.alias("plain"), F.collect_list(F.when(F.col("state") == 2, F.col("pos"))).alias("frequent"))

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: list[tuple[np.ndarray, ...]] = []
        frequent: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for b in _sliced(batches):
            ids, twins = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = pa.array(_opened(b.column(2)), pa.large_binary())
            few, many = lists(b.column(3)), lists(b.column(4))
            for first, rows, data, off in A.text_chunks(texts):
                s = A.prefix_hash(data)
                for (flat, cut), out in ((few, plain), (many, frequent)):
                    row = np.repeat(np.arange(rows), np.diff(cut[first : first + rows + 1]))
                    at = flat[cut[first] : cut[first + rows]] + off[row]
                    if not len(at):
                        continue
                    if out is plain:
                        padded = np.r_[np.zeros(side, np.uint8), data, np.zeros(side, np.uint8)]
                        bytes_ = np.lib.stride_tricks.sliding_window_view(padded, size)[at]
                        left = np.minimum(at - off[row], side).astype(np.uint8)
                        right = np.minimum(off[row + 1] - at - depth, side).astype(np.uint8)
                        key = A.span_hash(s, at, at + depth)
                        out.append((key, ids[first + row], twins[first + row], (at - off[row]).astype(np.uint32), left, right, np.ascontiguousarray(bytes_).view(f"V{size}").ravel()))
                        waiting += 4 * len(at)
                    else:
                        mark = np.zeros(len(data) + 1, bool)
                        for k in range(side + 1):
                            start = at - k
                            mark[start[(start >= off[row]) & (start + length <= off[row + 1])]] = True
                        start = np.flatnonzero(mark)
                        doc = np.searchsorted(off, start, side="right") - 1
                        two = A.span_hash(A.prefix_hash(data, 1), start, start + length, 1)
                        out.append((A.span_hash(s, start, start + length), two, ids[first + doc], twins[first + doc], (start - off[doc] + side).astype(np.uint32)))
                        waiting += 2 * len(start)
                if waiting > FLUSH:
                    yield from flush(plain, frequent)
                    plain, frequent, waiting = [], [], 0
        yield from flush(plain, frequent)

    def flush(plain: list[tuple[np.ndarray, ...]], frequent: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if plain:
            key, *columns = (np.concatenate(x) for x in zip(*plain, strict=True))
            yield from _tagged(None, [(2 * k, x) for k, x in A.dealt(A.mix(key), columns, buckets)])
        if frequent:
            h, two, doc, twin, pos = (np.concatenate(x) for x in zip(*frequent, strict=True))
            order, new, least = _first_of([h, two], doc)
            h, two, doc, twin, pos = (x[order] for x in (h, two, doc, twin, pos))
            done = least < doc
            columns = [x[~done] for x in (h, two, doc, twin, pos)]
            yield from _tagged(_rows(doc[done], twin[done], pos[done], 1, 1), [(2 * k + 1, x) for k, x in A.dealt(columns[0], columns, buckets)])

    def settle(blobs: list[bytes], bucket: int) -> pa.RecordBatch:
        if bucket % 2:
            h, two, doc, twin, pos = A.unpack(blobs, ["uint64", "uint64", "int64", "int64", "uint32"])
            order, _, least = _first_of([h, two], doc)
            done = order[least < doc[order]]
            return _rows(doc[done], twin[done], pos[done], 1, 1)
        doc, twin, pos, left, right, context = A.unpack(blobs, ["int64", "int64", "uint32", "uint8", "uint8", f"V{size}"])
        mask = covered_masks(np.ascontiguousarray(context).view(np.uint8).reshape(len(doc), size), left, right, doc, length, depth)
        some = mask != 0
        return _rows(doc[some], twin[some], pos[some], 1, mask[some])

    sieve = docs.sparkSession.sparkContext.broadcast(A.sieve_of(open_grams.select("doc_id")))
    joined = _sieved(docs, sieve).join(wanted, ["doc_id", "twin"]).select("doc_id", "twin", "text", "plain", "frequent")
    return _exchange(joined.mapInArrow(run, "bucket int, blob binary"), settle)


def covered(docs: DataFrame, length: int = LENGTH, depth: int = DEPTH, hot_least: int = HOT_LEAST) -> DataFrame:
    """Covered windows by document (doc_id, twin): runs of (pos, mask)."""
    rows = materialize(gram_rows(docs, length, depth, *frequent_grams(docs, length, depth, hot_least)))
    windows = window_rows(docs, rows.where(F.col("state") != 1), length, depth)
    both = rows.where(F.col("state") == 1).unionByName(windows)
    return both.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("pos", "mask")).alias("runs"))


def _with_twins(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with twin: a key of the text where the id is on several rows, else 0."""
    several = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id", F.lit(1).alias("_several"))
    several = materialize(several)
    if several.isEmpty():
        return docs.withColumn("twin", F.lit(0).cast("long"))
    twin = F.when(F.col("_several").isNull(), F.lit(0).cast("long")).otherwise(text_key(F.col("text")))
    return docs.join(small_side(several), "doc_id", "left").select("doc_id", "text", twin.alias("twin"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, depth: int = DEPTH,
    hot_least: int = HOT_LEAST,
) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (removed [start, end) bytes), kept (the remaining bytes), kept_sha256."""
    docs = _with_twins(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    with small_batches(docs.sparkSession):
        found = materialize(covered(docs, length, depth, hot_least))
    schema = "doc_id long, n_bytes long, starts array<int>, ends array<int>, kept binary, kept_sha256 string"
    sieve = docs.sparkSession.sparkContext.broadcast(A.sieve_of(found.select("doc_id")))
    hit = _sieved(docs, sieve).join(found, ["doc_id", "twin"], "left").select("doc_id", "text", "runs")
    whole = _cut(length, depth)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole(b.filter(pa.array(~sieve.value.passes(b.column(0)))) for b in batches)

    return hit.mapInArrow(whole, schema).unionByName(docs.select("doc_id", "text").mapInArrow(untouched, schema))


def _cut(length: int, depth: int):
    side = length - depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            plain = b.num_columns == 2
            texts = b.column(1).cast(pa.binary()).fill_null(b"").to_pylist() if plain else _opened(b.column(1))
            found = [None] * len(texts) if plain else b.column(2)
            out: list[tuple] = []
            for r, text in enumerate(texts):
                runs = None if plain or not found[r].is_valid else found[r].values
                if runs is None or not len(runs) or len(text) < length:
                    out.append((len(text), [], [], text))
                    continue
                pos, mask = (runs.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                opens = np.zeros(len(text) + 1, np.int64)
                for o in range(side + 1):
                    start = pos[(mask >> o) & 1 == 1] - side + o
                    start = start[(start >= 0) & (start + length <= len(text))]
                    opens[start] = 1
                last = np.cumsum(opens)  # windows that start up to here
                gone = last[:-1] - np.r_[np.zeros(length, np.int64), last][: len(text)] > 0
                edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), kept))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32())),
                    pa.array([x[2] for x in out], pa.list_(pa.int32())), pa.array([x[3] for x in out], pa.binary()),
                    pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string()),
                ],
                ["doc_id", "n_bytes", "starts", "ends", "kept", "kept_sha256"],
            )

    return run
