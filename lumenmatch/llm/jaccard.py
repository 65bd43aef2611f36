"""Exact Jaccard self-join of word-shingle sets with a token-group matrix.

Texts with equal sets form one class, so copies are never compared. Shingles are ranked
rarest first by bucket counts over all documents; of two sets with Jaccard >= t the first
``n - ceil(t*n) + k`` shingles have at least k in common, here k = 1 + EXTRA percent of the
smaller set. Classes that share as many with classes of a possible size are candidates.
Candidates are partitioned into groups (by their most shared shingle, cut into blocks of
bounded size). Inside a block members ask for their links until all that have not asked are
of one component, so a family of near copies is not compared with itself.

Between blocks, the token-group matrix has a cell for each (shared shingle, block) with the
least and the greatest component in it. Of two components only the smaller one's members
ask; cells that can still join components bound how much two blocks have in common, and
only qualifying blocks are opened. There the overlap with the block's token union prunes
again. The matrix grows with blocks, not with members: a family of near copies costs rows
in proportion to its size, never its pairs. Shingles that occur very often are spread over
all tasks and treated as shared without a count.

Defined results: a text without words (null, empty, blank) has no shingles and links with
nothing; fewer words than the width give one shingle of all words. Repeated rows are copies
of one class. A row with a null doc_id takes part by its text and can connect others; a
component is named by its ids that are not null (null if it has none). An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import BROADCAST_ROWS, forget, free_shuffles, materialize, partitions, private, small_batches, small_side, text_key
from .graph import components

WIDTH = 5
PERCENT = 80
MAX_SKETCH_BITS = 20
BLOCK_TOKENS = 500_000
FLUSH = 1_000_000
HOT_FACTOR = 8
HOT_LEAST = 2000
TASK_ROWS = 1 << 21
EXTRA = 4


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingles) of every text of the column."""
    weights = [np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64)) for k in range(width)]
    for first, rows, data, off in A.text_chunks(column):
        data = A.LOWER_TABLE[data]
        starts, ends, cut = A.blank_words(data, off)
        h = A.span_hash(A.prefix_hash(data), starts, ends)
        full = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            full += h[k : k + len(full)] * weights[k]
        full = A.mix(full)
        for r in range(rows):
            a, b = cut[r], cut[r + 1]
            if b - a >= width:
                yield first + r, np.unique(full[a : b - width + 1])
            elif b > a:
                part = (h[a:b] * np.array(weights[: b - a], np.uint64)).sum(dtype=np.uint64, keepdims=True)
                yield first + r, A.mix(part + np.uint64(b - a))
            else:
                yield first + r, np.zeros(0, np.uint64)


def _set_id(tokens: np.ndarray) -> int:
    """A 64-bit name of a set; its size is kept beside it."""
    return int((A.mix(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens))).view(np.int64)) if len(tokens) else 0


def _least_shared(n, extra: int = EXTRA):
    """How many prefix shingles two sets of at least n shingles share if they link."""
    return 1 + extra * n // 100


def _prefix_length(n: int, percent: int) -> int:
    return min(n, n - (percent * n + 99) // 100 + _least_shared(n))


def classes_of(docs: DataFrame, width: int) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_key, n_shingles, sid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [(len(s), _set_id(s)) for _, s in shingle_sets(b.column(1), width)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.int64())],
                ["doc_id", "text_key", "n_shingles", "sid"],
            )
        A.release()

    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, n_shingles long, sid long")


def shared_prefixes(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """Prefix shingles that classes of compatible size share: token, sid, n (its shingles), cnt (classes with the token)."""
    spark = docs.sparkSession
    # of a set of n shingles some n * (100 - percent + EXTRA) / 100 are in its prefix
    buckets = max(2 * partitions(spark), -(-int(counts.sum()) * (100 - percent + EXTRA) // (100 * TASK_ROWS)))
    held = spark.sparkContext.broadcast(counts)
    # a token that is not hot stands in one bucket, so its limit is also what a task may hold
    hot_from = int(max(HOT_LEAST, min(HOT_FACTOR * counts.mean(), max(TASK_ROWS, 2 * counts.mean()))))
    top = np.uint64(64 - (len(counts).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = held.value
        tokens: list[np.ndarray] = []
        names: list[int] = []
        sizes: list[int] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            tok = np.concatenate(tokens)
            per = [len(t) for t in tokens]
            sid, n = np.repeat(np.array(names, np.int64), per), np.repeat(np.array(sizes, np.uint32), per)
            hot = seen[(tok >> top).astype(np.int64)] >= hot_from
            key = np.where(hot, A.mix(tok ^ A.mix(sid.view(np.uint64))), tok)
            out = list(A.dealt(key, [tok, sid, n, hot.astype(np.uint8)], buckets))
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "blob"]
            )

        for b in batches:
            for _, s in shingle_sets(b.column(0), width):
                if len(s):
                    p = _prefix_length(len(s), percent)
                    tokens.append(s[np.lexsort((s, seen[(s >> top).astype(np.int64)]))[:p]])
                    names.append(_set_id(s))
                    sizes.append(len(s))
                    waiting += p
            if waiting > FLUSH:
                yield flush()
                tokens, names, sizes, waiting = [], [], [], 0
        if waiting:
            yield flush()
        tokens.clear()
        A.release()

    def detect(blobs: list[bytes]) -> pa.RecordBatch:
        tok, sid, n, hot = A.unpack(blobs, ["uint64", "int64", "uint32", "uint8"])
        order = np.lexsort((sid, n, tok))
        tok, sid, n, hot = tok[order], sid[order], n[order].astype(np.int64), hot[order].astype(bool)
        first = np.ones(len(tok), bool)
        first[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])
        tok, sid, n, hot = tok[first], sid[first], n[first], hot[first]
        near = (tok[1:] == tok[:-1]) & (100 * n[:-1] >= percent * n[1:])  # in order of size
        keep = np.r_[near, False] | np.r_[False, near] | hot
        _, inverse, cnt = np.unique(tok, return_inverse=True, return_counts=True)
        cnt = np.where(hot, held.value[(tok >> top).astype(np.int64)], cnt[inverse])
        return pa.RecordBatch.from_arrays(
            [pa.array(tok[keep].view(np.int64)), pa.array(sid[keep]), pa.array(n[keep]), pa.array(cnt[keep].astype(np.int64))],
            ["token", "sid", "n", "cnt"],
        )

    blobs = docs.select("text").mapInArrow(run, "bucket int, blob binary")
    out = materialize(A.by_bucket(blobs, detect, "token long, sid long, n long, cnt long"))
    held.destroy()
    free_shuffles(spark)
    return out


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the sets, and for each of its tokens the members that have it (start offsets, members)."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tok = np.concatenate(sets)
    order = np.argsort(tok, kind="stable")
    tok, member = tok[order], member[order]
    starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    return tok[starts], np.r_[starts, len(tok)], member


def _linked(query: np.ndarray, union: np.ndarray, starts: np.ndarray, member: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Members linked with the query; the overlap with the union bounds what any member can share."""
    at = np.searchsorted(union, query)
    inside = at < len(union)
    at, known = at[inside], query[inside]
    hit = at[union[at] == known]
    if 100 * len(hit) < percent * len(query):
        return np.zeros(0, np.int64)
    n = starts[hit + 1] - starts[hit]
    where = np.repeat(starts[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    common = np.bincount(member[where], minlength=len(sizes))
    return np.flatnonzero((common > 0) & (100 * common >= percent * (len(query) + sizes - common)))


def _blob_sets(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in blobs]


def component_ids(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return _named_rows(docs, id_col, text_col, width, percent).drop("text_key")


def _named_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        rows = materialize(classes_of(docs, width))
        classes = rows.where(F.col("n_shingles") > 0).groupBy("sid", "n_shingles").agg(F.min("doc_id").alias("rep"))
        labels = components(links(docs, classes, width, percent))
    named = classes.join(labels, classes.sid == labels.node, "left").select(
        "sid", "n_shingles", "rep", F.coalesce("label", "sid").alias("label")
    )
    # only components of several classes need a look-up, so that a large one is no key of a shuffle where these are few
    least = named.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    named = named.join(small_side(least), "label", "left").select("sid", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, ["sid", "n_shingles"], "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def links(docs: DataFrame, classes: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) between the sids of classes that connect what Jaccard links connect."""
    hashes = lambda b: (s for _, s in shingle_sets(b.column(0), width))
    bits = min(MAX_SKETCH_BITS, max(16, docs.count().bit_length()))
    shared = shared_prefixes(docs, A.bucket_totals(docs.select("text"), hashes, bits), width, percent)
    best = shared.groupBy("sid", "n").agg(F.max(F.struct("cnt", "token")).alias("b"), F.count("*").alias("k"))
    enough = F.floor(EXTRA * F.ceil(percent * F.col("n") / 100) / 100) + 1
    best = best.where(F.col("k") >= enough).select("sid", "n", F.col("b.token").alias("grp"), enough.alias("least"))
    chosen = best.join(classes.select("sid", "rep"), "sid")
    groups = chosen.groupBy("grp").agg(F.sum("n").alias("tokens"), F.min("sid").alias("leader"))
    groups = groups.select("grp", "leader", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks"))
    placed = materialize(
        chosen.join(groups, "grp").select(
            "sid", "rep", "grp", "least", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"),
            F.when(F.col("sid") == F.col("leader"), F.col("blocks")).alias("copies"),
        )
    )
    blocks = _blocks(docs, placed, width, percent)
    inner = blocks.select(F.explode(F.arrays_zip("sids", "roots")).alias("e")).select(F.col("e.sids").alias("u"), F.col("e.roots").alias("v"))
    inner = materialize(inner.where(F.col("u") != F.col("v")).distinct())
    pairs, members = _block_pairs(shared, placed, components(inner))
    asking = pairs.groupBy("g1", "b1").agg(F.max("top").alias("reach"))
    asking = asking.join(members.toDF("g1", "b1", "members"), ["g1", "b1"])
    askers = asking.join(blocks.select(F.col("grp").alias("g1"), F.col("block").alias("b1"), "sids", "tokens"), ["g1", "b1"])
    askers = askers.select("g1", "b1", "reach", "members", "sids", "tokens").mapInArrow(_askers, _ASKERS)
    target = blocks.select(F.col("grp").alias("g2"), F.col("block").alias("b2"), F.col("sids").alias("sids2"), F.col("tokens").alias("tokens2"))
    opened = pairs.join(askers, ["g1", "b1"]).join(target, ["g2", "b2"])
    cross = opened.select("top", "askers", "tokens", "sids2", "tokens2").mapInArrow(_open(percent), "u long, v long")
    edges = materialize(inner.unionByName(cross.distinct()))
    for used in (shared, placed, blocks, inner):
        forget(used)
    free_shuffles(docs.sparkSession)
    return edges


def _blocks(docs: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """The blocks of candidates, a group's leader in all of its blocks: grp, block, sids, roots, tokens."""
    key = lambda rep: F.coalesce(rep, F.col("sid"))  # noqa: E731  a class without an id is known by its sid
    sieve = A.sieve_of(placed.select(key(F.col("rep"))))
    held = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            b = b.filter(pa.array(held.value.passes(b.column(0)) | ~np.asarray(b.column(0).is_valid())))
            ids = b.column(0).to_pylist()
            sids, tokens = [], []
            for r, s in shingle_sets(b.column(1), width):
                sid = _set_id(s)
                if ids[r] is None and len(seen) < FLUSH:
                    if sid in seen:
                        continue
                    seen.add(sid)
                sids.append(sid)
                tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(tokens, pa.binary())], ["sid", "tokens"])
        A.release()

    where = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array("block"))
    known = placed.select("sid", "grp", "block", "copies")
    known = F.broadcast(known) if placed.count() <= BROADCAST_ROWS else known
    sets = docs.mapInArrow(run, "sid long, tokens binary").join(known, "sid")
    sets = sets.select("grp", "sid", "tokens", F.explode(where).alias("block"))
    schema = "grp long, block int, sids array<long>, roots array<long>, tokens array<binary>"
    blocks = materialize(sets.groupBy("grp", "block").applyInArrow(_block(percent), schema))
    held.destroy()
    free_shuffles(docs.sparkSession)
    return blocks


def _roots(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest index that links connect it with.

    Sets ask one by one; one that is already in the largest component waits. At the end all that
    wait are in one component, so every link between components has been asked for.
    """
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root
    sizes = np.array([len(s) for s in sets])
    union, starts, member = _postings(sets)
    shares = np.add.reduceat(np.repeat(np.diff(starts), np.diff(starts))[np.argsort(member, kind="stable")], np.r_[0, np.cumsum(sizes)[:-1]])
    order = np.argsort(-shares / sizes, kind="stable")  # who shares most goes first
    waits = np.ones(len(sets), bool)
    largest = -1
    while True:
        asks = [k for k in order if waits[k] and root[k] != largest]
        if not asks:
            return root
        for k in asks:
            if root[k] == largest:
                continue
            waits[k] = False
            near = root[_linked(sets[k], union, starts, member, sizes, percent)]
            if len(near) and near.max() != near.min():
                root[np.isin(root, near)] = near.min()
                largest = int(np.bincount(root).argmax())


def _block(percent: int):
    """All that links inside a block connect, as each member's smallest connected sid."""

    def run(t: pa.Table) -> pa.Table:
        seen: dict[int, bytes] = dict(zip(t.column("sid").to_pylist(), t.column("tokens").to_pylist(), strict=True))
        sids = sorted(seen)
        root = _roots(_blob_sets([seen[s] for s in sids]), percent)
        named = np.array(sids, np.int64)
        return pa.table(
            {
                "grp": t.column("grp")[:1], "block": t.column("block")[:1], "sids": pa.array([sids], pa.list_(pa.int64())),
                "roots": pa.array([named[root].tolist()], pa.list_(pa.int64())),
                "tokens": pa.array([[seen[s] for s in sids]], pa.list_(pa.binary())),
            }
        )

    return run


def _block_pairs(shared: DataFrame, placed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks g1, b1 that must ask block g2, b2 (top: its greatest component), and the members of each block.

    A component's rank is (size, label). A cell of the matrix is a (token, block) with the least
    and the greatest rank of its members that have the token. A link between two components is
    asked for from the smaller one, so cells pair only from a lower least to a greater greatest.
    """
    member = placed.join(labels, placed.sid == labels.node, "left").select(
        "sid", "grp", "block", "least", F.coalesce("label", "sid").alias("label")
    )
    sizes = small_side(member.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") > 1))
    rank = F.struct(F.coalesce("size", F.lit(1).cast("long")).alias("size"), "label").alias("rank")
    member = materialize(member.join(sizes, "label", "left").select("sid", "grp", "block", "least", rank))
    # tokens of one component only, most of them, cannot join any
    found = shared.select("token", "sid").join(member.select("sid", F.col("rank.label").alias("label")), "sid")
    mixed = found.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h")).where(F.col("l") != F.col("h")).select("token")
    rows = shared.select("token", "sid").join(small_side(mixed), "token").join(member, "sid")
    cells = materialize(
        rows.groupBy("token", "grp", "block").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.min("least").alias("least"))
    )
    top = cells.groupBy("token").agg(F.max("high").alias("h"), F.count("*").alias("n")).where(F.col("n") > 1)
    cells = cells.join(top.select("token", "h"), "token")
    asks = cells.where(F.col("low") < F.col("h")).select("token", "low", "least", F.col("grp").alias("g1"), F.col("block").alias("b1"))
    holds = cells.select("token", "high", F.col("grp").alias("g2"), F.col("block").alias("b2"))
    other = (F.col("g1") != F.col("g2")) | (F.col("b1") != F.col("b2"))
    met = asks.join(holds, "token").where(other & (F.col("low") < F.col("high")))
    met = met.groupBy("g1", "b1", "g2", "b2").agg(F.count("*").alias("k"), F.min("least").alias("least"), F.max("high").alias("top"))
    pairs = materialize(met.where(F.col("k") >= F.col("least")).select("g1", "b1", "g2", "b2", "top"))
    return pairs, member.groupBy("grp", "block").agg(F.collect_list(F.struct("sid", "rank")).alias("members"))


_RANK = "struct<size:long,label:long>"
_ASKERS = f"g1 long, b1 int, askers array<struct<sid:long,rank:{_RANK}>>, tokens array<binary>"


def _askers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the members that ask any block: those ranked below the greatest component it may ask."""
    for b in batches:
        out: list[tuple] = []
        for reach, members, sids, tokens in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
            have = dict(zip(sids, tokens, strict=True))
            asking = [m for m in members if (m["rank"]["size"], m["rank"]["label"]) < (reach["size"], reach["label"])]
            out.append((asking, [have[m["sid"]] for m in asking]))
        rank = pa.struct([("size", pa.int64()), ("label", pa.int64())])
        kind = pa.list_(pa.struct([("sid", pa.int64()), ("rank", rank)]))
        columns = [pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *columns], ["g1", "b1", "askers", "tokens"])


def _open(percent: int):
    """What links between the askers of a block and the members of another connect, one edge a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us: list[int] = []
            vs: list[int] = []
            for r in range(b.num_rows):
                top, askers, tokens, sids2, tokens2 = (c[r].as_py() for c in b.columns)
                sets = _blob_sets(tokens2)
                union, starts, member = _postings(sets)
                sizes = np.array([len(s) for s in sets])
                root = np.arange(len(sids2))
                met: list[tuple[int, int]] = []
                for who, q in zip(askers, tokens, strict=True):
                    if (who["rank"]["size"], who["rank"]["label"]) < (top["size"], top["label"]):
                        near = _linked(np.frombuffer(q, np.uint64), union, starts, member, sizes, percent)
                        if len(near):
                            old = np.unique(root[near])
                            root[np.isin(root, old)] = old[0]
                            met.append((who["sid"], int(near[0])))
                ends = [(sid, sids2[root[k]]) for sid, k in met] + [(sids2[k], sids2[x]) for k, x in enumerate(root) if x != k]
                us += [x for x, _ in ends]
                vs += [x for _, x in ends]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one whose id names it; texts without words stay.

    Rows with one id are one document. Rows that repeat an id and a text stay once; a null id
    counts as an id there. A row with a null id goes if its component has an id.
    """
    key, text = private(docs, "_id", "_k")
    found = materialize(_named_rows(docs, id_col, text_col, WIDTH, PERCENT)).withColumnsRenamed({"doc_id": key, "text_key": text})
    mine = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (text_key(F.col(text_col)) == F.col(text))
    goes = F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col(key))
    kept = docs.join(small_side(found.where(goes).select(key, text).distinct()), mine, "left_anti")
    repeated = found.groupBy(key, text).count().where(F.col("count") > 1).select(key, text)
    if repeated.isEmpty():
        return kept
    repeated = small_side(repeated)
    return kept.join(repeated, mine, "left_anti").unionByName(kept.join(repeated, mine, "left_semi").dropDuplicates([id_col, text_col]))
