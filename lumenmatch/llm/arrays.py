"""Numpy helpers for work on Arrow batches inside tasks: hashes of byte spans, words, blobs of records."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 18
MAX_SIEVE_BITS = 28
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, np.ndarray] = {}

LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32
BLANK_TABLE = np.zeros(256, dtype=bool)
BLANK_TABLE[[32, 9, 10, 11, 12, 13]] = True


def release() -> None:
    """Give back to the system what numpy and Arrow keep for later: a worker may idle beside other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_TABLES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(x)) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= CHUNK + 1:  # those of a very long text are not kept
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """s with s[j] - s[i] determined by data[i:j] and i; length len(data) + 1. Two independent hashes to choose from."""
    s = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_TABLES[which][data] * _power(_BASES[which], len(data)), out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes in each [start, end), the same wherever they stand."""
    return mix((s[end] - s[start]) * _power(pow(_BASES[which], -1, 1 << 64), len(s))[start])


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column as (first row, rows, bytes, offsets), about limit bytes each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.cast(pa.large_binary() if wide else pa.binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, int(off[row]) + limit, side="right")) - 1)
        stop = min(stop, n)
        yield row, stop - row, raw[off[row] : off[stop]], off[row : stop + 1].astype(np.int64) - int(off[row])
        row = stop


def blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and per text the index of its first word (plus the total)."""
    full = ~BLANK_TABLE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = full[:-1]
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = full[1:]
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length as byte planes, which compress well when sorted."""
    n = len(columns[0])
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() for c in columns)


def unpack(blobs: Iterable[bytes], dtypes: list[str]) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for t in dtypes)
    out: list[list[np.ndarray]] = [[] for _ in dtypes]
    for b in blobs:
        n, at = len(b) // width, 0
        for k, t in enumerate(dtypes):
            size = np.dtype(t).itemsize
            planes = np.frombuffer(b, np.uint8, n * size, at).reshape(size, n)
            out[k].append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
            at += n * size
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, dtypes, strict=True)]


def dealt(key: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Records sorted by key, cut into blobs by the bucket of the key."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        yield int(bucket[a]), pack([c[a:b] for c in columns])


def by_bucket(df: DataFrame, work, schema: str) -> DataFrame:
    """Apply work(list of blobs) -> Arrow batch to the blobs of each bucket of df (bucket int, blob binary)."""

    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([work(t.column("blob").to_pylist())])

    return df.groupBy("bucket").applyInArrow(run, schema)


def _gathered(parts: DataFrame, join, size: int) -> np.ndarray:
    """Arrays that tasks emit in 16 cuts (part, salt, blob), joined in two levels; size bytes reach the driver."""

    def run(t: pa.Table) -> pa.Table:
        blob = zlib.compress(join([zlib.decompress(x) for x in t.column("blob").to_pylist()]), 1)
        return pa.table({"part": t.column("part")[:1], "salt": t.column("salt")[:1], "blob": pa.array([blob], pa.binary())})

    level = parts.groupBy("part", "salt").applyInArrow(run, "part int, salt int, blob binary")
    rows = level.withColumn("salt", F.lit(0)).groupBy("part", "salt").applyInArrow(run, "part int, salt int, blob binary").collect()
    out = np.zeros(size, np.uint8)
    for r in rows:
        out[r.part * (size // 16) : (r.part + 1) * (size // 16)] = np.frombuffer(zlib.decompress(r.blob), np.uint8)
    return out


def _emitted(whole: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % 64
    blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(whole, 16)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(16), pa.int32()), pa.array([salt] * 16, pa.int32()), pa.array(blobs, pa.binary())], ["part", "salt", "blob"]
    )


def bucket_totals(df: DataFrame, hashes, bits: int) -> np.ndarray:
    """How often the top bits of hashes(batch) fall into each of 2**bits buckets, over all rows of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for b in batches:
            for h in hashes(b):
                waiting.append((h >> np.uint64(64 - bits)).astype(np.int32))
                size += len(h)
                if size > CHUNK:
                    total += np.bincount(np.concatenate(waiting), minlength=1 << bits)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=1 << bits)
        if total.any():
            yield _emitted(total)

    def add(blobs: list[bytes]) -> bytes:
        return sum(np.frombuffer(x, "<i8") for x in blobs).tobytes()

    return _gathered(df.mapInArrow(run, "part int, salt int, blob binary"), add, 8 << bits).view("<i8")


class Sieve:
    """A Bloom filter of long ids, sized for their count; without bits (too many ids) it passes all."""

    def __init__(self, bits: int, held: np.ndarray | None):
        self.bits, self.held = bits, held

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return (h >> np.uint64(64 - self.bits)).astype(np.int64), (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def passes(self, ids: pa.Array) -> np.ndarray:
        """Which ids may be in the sieve; null ids are not."""
        out = np.array(ids.is_valid())
        if self.held is not None:
            for at in self.places(ids.fill_null(0).to_numpy(zero_copy_only=False)):
                out &= (self.held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def sieve_of(ids: DataFrame) -> Sieve:
    """The sieve of a column of long ids: 12 bits an id, none beyond 2**MAX_SIEVE_BITS bits."""
    empty = Sieve(max(16, int(12 * max(ids.count(), 1)).bit_length()), None)
    if empty.bits > MAX_SIEVE_BITS:
        return empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (empty.bits - 3), np.uint8)
        for b in batches:
            for at in empty.places(b.column(0).drop_null().to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(held, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        if held.any():
            yield _emitted(held)

    def both(blobs: list[bytes]) -> bytes:
        return np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in blobs]).tobytes()

    return Sieve(empty.bits, _gathered(ids.mapInArrow(run, "part int, salt int, blob binary"), both, 1 << (empty.bits - 3)))
