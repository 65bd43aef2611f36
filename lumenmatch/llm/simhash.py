"""SimHash near-duplicate classes over a Gray-order hierarchical index.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Equal
fingerprints are one entry of the index. The 64 bits are cut into ``distance + 2`` parts: of
two linked fingerprints at least two parts are equal, so the uppermost nodes of the index are
the masked patterns of every two parts, and linked entries lie under one of them. Below such a
node entries are sorted by the Gray rank of their bits, those of the pattern first. Runs of
16 neighbours share further bits, which are factored into a node of their own, again and again
up to the pattern. A search carries the differences seen so far down the tree: a node adds
those in the bits that it fixes and its parent does not, and with more than ``distance`` of
them its whole group is left.

Neighbours in Gray order mostly differ in few bits, so their links are taken first. Then only
members of other than the largest class ask, and a node whose entries are all of the asker's
class is left too: a family of near copies costs little more than its size, never its pairs.

Spark sorts all (pattern, Gray rank) rows by ranges, so a part of the index holds equally many
entries however they crowd. A pattern that goes on in the next range gives a fragment to be
searched with its neighbour, then with other fragments whose shared bits are near and that
are not already of one class.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is linked
like any other. Repeated rows are rows of their own. A row with a null doc_id takes part by
its text and can connect others; a component is named by its ids that are not null (null if it
has none). An id on several texts gives each row what its text gives. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import release
from .common import forget, join_skewed, materialize, partitions, small_batches
from .graph import components

BITS = 64
WIDTH = 4
DISTANCE = 4
SEED = 42
FANOUT = 16
STRETCH = 1 << 16
TASK_ROWS = 1 << 20
FRONTIER = 1 << 22


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of a whole text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends + 1 - size
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[-n:]
    total = np.zeros(BITS, np.int64)
    for k in range(0, n, STRETCH):
        spans = zip(starts[k : k + STRETCH].tolist(), ends[k : k + STRETCH].tolist(), strict=True)
        h = np.frombuffer(b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in spans]), np.uint8)
        total += np.unpackbits(h.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row of docs: doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t or b"", width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
        release()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long")


class Patterns:
    """The uppermost nodes: which two parts a pattern fixes, and the order of bits below it."""

    def __init__(self, distance: int):
        n = distance + 2
        width = [BITS // n + (k < BITS % n) for k in range(n)]
        low = np.cumsum([0, *width])
        self.orders = [[*two, *(k for k in range(n) if k not in two)] for two in combinations(range(n), 2)]
        self.fixed = [width[o[0]] + width[o[1]] for o in self.orders]
        self.moves = []
        for order in self.orders:
            at, moves = BITS, []
            for k in order:
                at -= width[k]
                moves.append((np.uint64(low[k]), np.uint64(at), np.uint64((1 << width[k]) - 1)))
            self.moves.append(moves)

    def laid(self, fp: np.ndarray, t: int) -> np.ndarray:
        """Bits in the order of pattern t."""
        return np.bitwise_or.reduce([((fp >> a) & m) << b for a, b, m in self.moves[t]])

    def restored(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The fingerprints again."""
        out = np.zeros_like(p)
        for k in np.unique(t):
            rows = t == k
            out[rows] = np.bitwise_or.reduce([((p[rows] >> b) & m) << a for a, b, m in self.moves[k]])
        return out

    def cell(self, rank: np.ndarray, t: np.ndarray) -> np.ndarray:
        """What the pattern's bits are; the leading bits of a Gray rank tell those of its code."""
        return rank >> np.array([BITS - f for f in self.fixed], np.uint64)[t]


def gray_rank(p: np.ndarray) -> np.ndarray:
    """The place of a code in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        p = p ^ (p >> np.uint64(k))
    return p


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (indexes of members), with the classes a[k] and b[k] made one, named by the smallest."""
    parent = np.arange(len(label))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            return parent[label]
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up


class Index:
    """Nodes over entries that lie cell by cell in Gray order; level 0 are the entries, the last has a node for each cell."""

    def __init__(self, p: np.ndarray, sizes: np.ndarray):
        self.p = p
        self.low, self.high, self.starts = [p], [p], [np.arange(len(p) + 1)]
        while len(self.low) == 1 or (sizes > 1).any():
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cuts = np.flatnonzero(within % FANOUT == 0)
            self.starts.append(np.r_[cuts, len(within)])
            self.low.append(np.bitwise_and.reduceat(self.low[-1], cuts))
            self.high.append(np.bitwise_or.reduceat(self.high[-1], cuts))
            sizes = -(-sizes // FANOUT)
        self.mask = [~(a ^ b) for a, b in zip(self.low, self.high, strict=True)]

    def colour(self, label: np.ndarray) -> None:
        """The least and the greatest class below every node."""
        self.least, self.most = [label], [label]
        for cuts in self.starts[1:]:
            self.least.append(np.minimum.reduceat(self.least[-1], cuts[:-1]))
            self.most.append(np.maximum.reduceat(self.most[-1], cuts[:-1]))

    def search(self, q: np.ndarray, root: np.ndarray, distance: int, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Entries (asker, found) of different classes within the distance; None if more than limit nodes were open at once."""
        own, asker, node = self.least[0][q], np.arange(len(q)), root
        seen = np.bitwise_count((self.p[q] ^ self.low[-1][root]) & self.mask[-1][root])
        for level in range(len(self.low) - 2, -1, -1):
            first, n = self.starts[level + 1][node], np.diff(self.starts[level + 1])[node]
            if n.sum() > limit and len(q) > 1:
                return None
            child = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            above = np.repeat(self.mask[level + 1][node], n)
            asker, seen = np.repeat(asker, n), np.repeat(seen, n)
            fixed = self.mask[level][child] & ~above
            seen = seen + np.bitwise_count((self.p[q[asker]] ^ self.low[level][child]) & fixed)
            mine = own[asker]
            open_ = (seen <= distance) & ((self.least[level][child] != mine) | (self.most[level][child] != mine))
            asker, node, seen = asker[open_], child[open_], seen[open_]
        return q[asker], node


def connect(p: np.ndarray, cell: np.ndarray, distance: int, label: np.ndarray | None = None, limit: int = FRONTIER) -> np.ndarray:
    """Per entry the smallest index that links within its cell connect it with; p lies cell by cell in Gray order.

    label: classes known before, as indexes of members.
    """
    n = len(p)
    if not n:
        return np.zeros(0, np.int64)
    label = np.arange(n) if label is None else label
    near = np.flatnonzero((cell[1:] == cell[:-1]) & (np.bitwise_count(p[1:] ^ p[:-1]) <= distance))
    label = _merged(label, label[near], label[near + 1])
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, n])
    largest = np.maximum.reduceat(np.bincount(label, minlength=n)[label] * n + label, starts) % n
    asks = label != np.repeat(largest, sizes)
    searched = np.logical_or.reduceat(asks, starts)
    if not searched.any():
        return label
    rows = np.flatnonzero(np.repeat(searched, sizes))
    back = np.zeros(n, np.int64)
    back[rows] = np.arange(len(rows))
    home = np.repeat(np.arange(searched.sum()), sizes[searched])
    index, mine, largest = Index(p[rows], sizes[searched]), back[label[rows]], back[largest[searched]]
    index.colour(mine)
    queue, at, step = np.flatnonzero(asks[rows]), 0, 1024
    while at < len(queue):
        q = queue[at : at + step]
        q = q[mine[q] != mine[largest[home[q]]]]
        found = index.search(q, home[q], distance, limit)
        if found is None:
            step = max(1, step // 2)
            continue
        at, step = at + step, step * 2
        if len(found[0]):
            mine = _merged(mine, mine[found[0]], mine[found[1]])
            index.colour(mine)
    label = label.copy()
    label[rows] = rows[mine]
    return label


_EDGES = "u long, v long"
_FRAGMENT = "t int, cell long, part int, entries binary, roots binary, low long, mask long, lead long"


def _edges_of(fp: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = np.flatnonzero(label != np.arange(len(label)))
    return fp[other].view(np.int64), fp[label[other]].view(np.int64)


def index_rows(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints (fp) -> a row (t, rank) under each pattern."""
    patterns = Patterns(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for t in range(len(patterns.orders)):
                rank = gray_rank(patterns.laid(fp, t)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(rank)], ["t", "rank"])

    return prints.select("fp").mapInArrow(run, "t int, rank long")


def _searched(ordered: DataFrame, distance: int) -> DataFrame:
    """Edges inside the ranges of the index, and the fragments of the first and the last cell of each."""
    patterns = Patterns(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches]
        if not sum(len(t) for t, _ in held):
            return
        t, rank = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        cell, p = patterns.cell(rank, t), gray_code(rank)
        starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (cell[1:] != cell[:-1])])
        number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(p)]))
        label = connect(p, number, distance)
        fp = patterns.restored(p, t)
        u, v = _edges_of(fp, label)
        none = pa.nulls(len(u))
        columns = [none.cast(k) for k in (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())]
        names = ["u", "v", "t", "cell", "part", "entries", "roots", "low", "mask", "lead"]
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *columns], names)
        out = []
        for k in sorted({0, len(starts) - 1}):
            a, b = starts[k], starts[k + 1] if k + 1 < len(starts) else len(p)
            low, mask = np.bitwise_and.reduce(p[a:b]), ~(np.bitwise_and.reduce(p[a:b]) ^ np.bitwise_or.reduce(p[a:b]))
            lead = int(fp[a : a + 1].view(np.int64)[0]) if (label[a:b] == a).all() else None
            signed = [int(np.uint64(x).view(np.int64)) for x in (cell[a], low, mask)]
            roots = (label[a:b] - a).astype("<i4").tobytes()
            out.append((None, None, int(t[a]), signed[0], TaskContext.get().partitionId(), p[a:b].tobytes(), roots, signed[1], signed[2], lead))
        kinds = [pa.int64(), pa.int64(), *(c.type for c in columns)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        release()

    return ordered.mapInArrow(run, f"{_EDGES}, {_FRAGMENT}")


def _opened(pairs: DataFrame, fragments: DataFrame, distance: int) -> DataFrame:
    """Edges between the fragments of pairs (t, cell, part, part2)."""
    patterns = Patterns(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                t, *blobs = (c[r].as_py() for c in b.columns)
                p = [np.frombuffer(x, np.uint64) for x in blobs[:2]]
                roots = [np.frombuffer(x, "<i4").astype(np.int64) for x in blobs[2:]]
                label = np.r_[roots[0], roots[1] + len(p[0])]
                p = np.concatenate(p)
                label = connect(p, np.zeros(len(p), np.int8), distance, label)
                u, v = _edges_of(patterns.restored(p, np.full(len(p), t)), label)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        release()

    here = fragments.select("t", "cell", "part", "entries", "roots")
    there = here.select("t", "cell", F.col("part").alias("part2"), F.col("entries").alias("entries2"), F.col("roots").alias("roots2"))
    both = pairs.join(here, ["t", "cell", "part"]).join(there, ["t", "cell", "part2"])
    return both.select("t", "entries", "entries2", "roots", "roots2").mapInArrow(run, _EDGES)


def links(prints: DataFrame, distance: int = DISTANCE, task_rows: int = TASK_ROWS) -> DataFrame:
    """prints (fp, distinct) -> node, label: the smallest fingerprint that links connect each with; those without links are absent."""
    spark = prints.sparkSession
    rows = index_rows(prints, distance)
    parts = max(partitions(spark), -(-prints.count() * len(Patterns(distance).orders) // task_rows))
    found = materialize(_searched(rows.repartitionByRange(parts, "t", "rank").sortWithinPartitions("t", "rank"), distance))
    edges = found.where(F.col("u").isNotNull()).select("u", "v")
    fragments = found.where(F.col("t").isNotNull()).drop("u", "v")
    order = Window.partitionBy("t", "cell").orderBy("part")
    place = fragments.select("t", "cell", "part", "low", "mask", "lead", F.row_number().over(order).alias("k"))
    place = materialize(place)
    other = place.select("t", "cell", *[F.col(c).alias(f"{c}2") for c in ("part", "low", "mask", "lead", "k")])
    shared = F.col("low").bitwiseXOR(F.col("low2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2"))
    pairs = place.join(other, ["t", "cell"]).where((F.col("k") < F.col("k2")) & (F.bit_count(shared) <= distance))
    next_to = F.col("k2") == F.col("k") + 1
    near = materialize(_opened(pairs.where(next_to).select("t", "cell", "part", "part2"), fragments, distance))
    labels = components(edges.unionByName(near))
    rest = pairs.where(~next_to)
    if not rest.isEmpty():
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        rest = rest.join(of("lead"), "lead", "left").join(of("lead2"), "lead2", "left")
        apart = ~F.coalesce(F.col("lead_label") == F.col("lead2_label"), F.lit(False))
        far = _opened(rest.where(apart).select("t", "cell", "part", "part2"), fragments, distance)
        labels = components(edges.unionByName(near).unionByName(far))
    labels = materialize(labels)
    for used in (found, place, near):
        forget(used)
    return labels


def component_ids(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (smallest doc_id that links of fingerprints reach)."""
    with small_batches(docs.sparkSession):
        rows = materialize(fingerprints(docs, id_col, text_col, width))
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = links(prints, distance, task_rows)
    named = prints.join(labels, prints.fp == labels.node, "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = materialize(join_skewed(named, least, "label").select("fp", "component_id"))
    return join_skewed(rows, named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """A fingerprint as 16 lower-case digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
