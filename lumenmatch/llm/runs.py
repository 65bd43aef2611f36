"""Periodic runs of words, by a suffix automaton with link-cut access.

Words are appended to a suffix automaton one by one. Its link tree is held as a link-cut tree
whose preferred paths carry a colour: the last end of all strings on the path. An access of
the new prefix recolours the way to the root, and passes its old segments, deepest node first:
the longest string of a segment ends now and ended at the colour before. If the two ends are
at most its length apart they make a square, whose period is that distance; a square goes to
the right as far as the period holds and is then a run. A colour is the last end, so no
smaller period is possible, and the longest string of a segment is all the left extension
there is. Every run shows at the end of its first two periods.

Only stretches that can hold a long enough run are appended: in a run of ``least`` words and
``times`` periods, every word lies in a window of ``window`` words that comes again at most a
run's length over ``times`` apart. A sieve over window hashes leaves stretches of such windows, exactly: a
hash can only let too much through. Words are compared as they are.

All is local to a document: texts stay whole in one row, and no row depends on others.

Defined results: null, empty and blank texts have no words, no runs and an empty text. Repeated
rows, repeated and null ids are rows of their own. Very long texts are handled whole, in memory
in proportion to the text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import blank_words

LEAST = 24
TIMES = 3


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, period, length) of the maximal stretches of at least least words and times their smallest period."""
    total = len(words)
    step: list[dict] = [{}, {}]  # state 0 is none, state 1 the empty string
    length, link = [0, 0], [0, 0]
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]  # splay trees of the paths; a path's colour is at its root
    reach: dict[int, int] = {}
    found: list[tuple[int, int, int]] = []

    def rotate(x: int, f: int, g: int) -> None:
        if left[f] == x:
            b = left[f] = right[x]
            right[x] = f
        else:
            b = right[f] = left[x]
            left[x] = f
        if b:
            up[b] = f
        up[f], up[x] = x, g
        if g:
            if left[g] == f:
                left[g] = x
            elif right[g] == f:
                right[g] = x

    def splay(x: int) -> None:
        f = up[x]
        while f and (left[f] == x or right[f] == x):
            g = up[f]
            if g and (left[g] == f or right[g] == f):
                top, h = g, up[g]
                if (left[f] == x) == (left[g] == f):
                    rotate(f, g, h)
                    rotate(x, f, h)
                else:
                    rotate(x, f, g)
                    rotate(x, g, h)
                f = h
            else:
                top = f
                rotate(x, f, g)
                f = g
            colour[x] = colour[top]

    def grow(size: int, links: int, moves: dict) -> int:
        step.append(moves)
        length.append(size)
        link.append(links)
        left.append(0)
        right.append(0)
        up.append(links)
        colour.append(-1)
        return len(step) - 1

    last = 1
    for i, w in enumerate(words):
        p, last = last, grow(i + 1, 0, {})
        while p and w not in step[p]:
            step[p][w] = last
            p = link[p]
        if not p:
            above = 1
        else:
            above = step[p][w]
            if length[above] != length[p] + 1:
                q, above = above, grow(length[p] + 1, link[above], step[above].copy())
                while p and step[p].get(w) == q:
                    step[p][w] = above
                    p = link[p]
                link[q] = above
                splay(q)  # the copy enters the path of q just before it, and has its colour
                b = left[above] = left[q]
                if b:
                    up[b] = above
                left[q], up[above] = above, q
        link[last] = up[last] = above
        below, x = last, above
        while x:
            splay(x)
            c = colour[x]
            if right[x]:
                colour[right[x]] = c
            right[x] = below
            d = i - c
            if length[x] >= d and times * d <= total and reach.get(d, -1) < i:
                start, end = i - d - length[x] + 1, i + 1
                while end < total and words[end] == words[end - d]:
                    end += 1
                reach[d] = end - 1
                if end - start >= max(least, times * d):
                    found.append((start, d, end - start))
            below, x = x, up[x]
        colour[below] = i
    return sorted(found)


def stretches(h: np.ndarray, cut: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words (hashes h, texts cut at cut) that can hold a run."""
    window = least - least // times
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    at = np.flatnonzero(np.arange(len(h)) + window <= cut[1:][text])
    weights = A.mix(np.arange(1, window + 1, dtype=np.uint64))
    key = A.mix(text[at].astype(np.uint64))
    for k in range(window):
        key += h[at + k] * weights[k]
    key = A.mix(key)
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    if not len(again):
        return again, again
    gap = at[again + 1] - at[again]
    far = np.full(len(at), len(h))
    np.minimum.at(far, again, gap)
    np.minimum.at(far, again + 1, gap)
    held = far < len(h)
    at, far = at[held], far[held]
    edge = np.zeros(len(h) + 1, bool)
    edge[cut] = True
    while True:
        depth = np.zeros(len(h) + 1, np.int64)
        depth[at] += 1
        depth -= np.bincount(at + window, minlength=len(h) + 1)
        full = np.cumsum(depth)[:-1] > 0
        starts = np.flatnonzero(full & (~np.r_[False, full[:-1]] | edge[:-1]))
        ends = np.flatnonzero(full & (~np.r_[full[1:], False] | edge[1:])) + 1
        size = (ends - starts)[np.searchsorted(starts, at, side="right") - 1] if len(at) else at
        good = (times * far <= size) & (size >= least)
        if good.all():
            return starts, ends
        at, far = at[good], far[good]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    gone = np.zeros(len(words) + 1, np.int64)
    for start, period, length in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = (np.cumsum(gone)[:-1] == 0).tolist()
    return b" ".join([w for w, k in zip(words, kept, strict=True) if k])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of docs: doc_id, runs (start, period, length, in order), collapsed: the words that no run repeats, joined by blanks."""
    item = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs: list[list[tuple[int, int, int]]] = []
            texts: list[bytes] = []
            for _, rows, data, off in A.text_chunks(b.column(1)):
                starts, ends, cut = A.blank_words(data, off)
                first, stop = stretches(A.span_hash(A.prefix_hash(data), starts, ends), cut, least, times)
                owner = np.searchsorted(cut, first, side="right") - 1
                raw = data.tobytes()
                for r in range(rows):
                    words = raw[off[r] : off[r + 1]].split()
                    mine: list[tuple[int, int, int]] = []
                    for k in range(np.searchsorted(owner, r), np.searchsorted(owner, r, side="right")):
                        a, e = int(first[k] - cut[r]), int(stop[k] - cut[r])
                        mine += [(a + s, d, size) for s, d, size in runs_of(words[a:e], least, times)]
                    runs.append(mine)
                    texts.append(_collapsed(words, mine) if mine else b" ".join(words))
            columns = [b.column(0), pa.array(runs, pa.list_(item)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])
        A.release()

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,period:long,length:long>>, collapsed string")


def with_planted_runs(text: Column, key: Column) -> Column:
    """The text, for a tenth of the keys with its words from some place on made periodic; known runs to test against.

    With h the crc32 of the key as text and g = h // 10: if h is a multiple of 10, the words from
    a = g % n on repeat the first 1 + (n - a) // (3 + g % 8) of them.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = blank_words(text)
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when(h % 10 == 0, F.when(n > 0, changed).otherwise(text)).otherwise(text)
