"""Secret scans: fixed patterns, and a character convolutional network over every candidate with its context.

Candidates are the matches of the base patterns and every token of at least eight key
characters that has a letter and a digit, an inner capital, or 16 characters. A small network
(character embedding, one convolution, the largest response inside the candidate and the
largest around it, one logistic output) reads the whole candidate, in pieces if it is long,
and AROUND characters on either side.

It is trained on labelled findings: matches of the base patterns are positive, an ordinary
word of each text negative. A further candidate gets a label only from evidence of its own
(``evidence``: token formats, entropy, keywords before it; e-mail, URL or word shape) and else
none. All distinct findings are learned from: they are dealt by a hash to shards of some SHARD
rows, in each of ROUNDS rounds every shard trains the network of the last round once over its
rows, and what they come to is averaged by their rows. Positive values are also planted into the
contexts of negative ones, so that the network learns secrets that no keyword announces. A part
held out by value calibrates the output (Platt) and sets the threshold: the highest that keeps
RECALL of all held-out positives, whose outputs are counted in steps of 1 / STEPS, rounded down.
Base spans always stay; the network adds spans.

Defined results: null text is empty and has no spans; offsets are code points, ends
exclusive; equal spans of several kinds are all given; repeated rows are scanned each; an empty
table, or one with fewer than LEAST findings of either label, gives base spans only.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import release
from .common import forget, materialize, partitions, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of fewer is dropped either way
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
FORMAT = re.compile(r"(gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_](live|test|proj)|AIza|npm_|hf_|SG\.)[A-Za-z0-9_.=-]{10,}|eyJ[A-Za-z0-9_-]{8,}")
KEYWORD = re.compile(r"(secret|token|passw|pwd|credential|auth|bearer|private|access|key)[^\n]{0,12}\Z", re.I)
KEY = re.compile(r"(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9+/_=-]{20,}\Z", re.S)
INNER = re.compile("[a-z0-9][A-Z]")
WORD = re.compile(r"[^\W\d_]{5,}")
_LETTER = re.compile("[A-Za-z]")
_DIGIT = re.compile("[0-9]")
KINDS = ("assign", "access", "hex", "model")
AROUND = 24
INSIDE = 40
WIDTH = 5
FILTERS = 24
DEPTH = 10
ROUNDS = 6
SHARD = 4096
#: Of each label a shard has at least one row in so many, if need be the same row as others.
SHARE = 20
STEPS = 256
MOST = 64
LEAST = 20
RECALL = 0.98
PIECES = 512

_SPAN = "struct<kind:int,start:int,end:int,before:string,value:string,after:string,label:int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class _Taken:
    """Merged spans, to ask whether another one overlaps them."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, e in spans:
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(a)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def candidates(text: str, with_word: bool = False) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base spans (0-2), further candidates (3) and, for training, an ordinary word (4)."""
    base = base_spans(text)
    taken = _Taken(base)
    out = list(base)
    for m in TOKEN.finditer(text):
        s = m.group()
        if _LETTER.search(s) and (len(s) >= 16 or _DIGIT.search(s) or INNER.search(s)) and not taken.meets(m.start(), m.end()):
            out.append((m.start(), 3, m.end()))
    out.sort()
    if with_word:
        middle = WORD.search(text, len(text) // 2)
        if middle and not _Taken(out).meets(middle.start(), middle.end()):
            out.append((middle.start(), 4, middle.end()))
            out.sort()
    return out


def entropy(s: str) -> float:
    """Bits a character."""
    return sum(n / len(s) * math.log2(len(s) / n) for n in Counter(s).values())


def evidence(text: str, start: int, end: int) -> int:
    """The label of a further candidate: 1 secret, 0 none, -1 unknown."""
    s, before = text[start:end], text[max(0, start - AROUND) : start]
    if FORMAT.match(s):
        return 1
    if text[end : end + 1] == "@" or before.endswith("@") or s.startswith(("//", "www.")):
        return 0
    if s.isalpha() and not INNER.search(s) and 0.25 <= sum(c in "aeiouAEIOU" for c in s) / len(s) <= 0.65:
        return 0
    bits = entropy(s)
    if KEY.match(s) and bits >= 3.8 and not re.search("[a-z]{7,}|[A-Z]{9,}", s):
        return 1
    return 1 if len(s) >= 12 and bits >= 3 and KEYWORD.search(before) else -1


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, spans (kind, start, end, before, value, after, label)."""
    names = ("kind", "start", "end", "before", "value", "after", "label")

    def label(text: str, a: int, k: int, e: int) -> int:
        return evidence(text, a, e) if k == 3 else int(k < 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                text = text or ""
                found = candidates(text, True)
                rows = [(k, a, e, text[max(0, a - AROUND) : a], text[a:e], text[e : e + AROUND], label(text, a, k, e)) for a, k, e in found]
                out.append([dict(zip(names, r, strict=True)) for r in rows])
            kind = pa.list_(pa.struct([(n, pa.string() if n in names[3:6] else pa.int32()) for n in names]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, spans array<{_SPAN}>")


_CLASS = np.full(128, 1, np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 +/_.=-\"':\n,;@!?()[]{}<>|&%$#*", 2):
    _CLASS[ord(_c)] = _k
_CLASSES = int(_CLASS.max()) + 2


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], _CLASSES - 1)


class Pieces:
    """Candidates as rows of character classes, INSIDE of the value and AROUND on either side; 0 pads.

    A longer value has several rows; the ends of a row's inside see the characters beyond it.
    first and last tell which rows of a candidate have what is around it; at is each candidate's first row.
    """

    def __init__(self, before: list[str], value: list[str], after: list[str]):
        rows: list[np.ndarray] = []
        first, last, at = [], [], [0]
        for b, v, z in zip(before, value, after, strict=True):
            whole = np.concatenate([np.zeros(AROUND - len(b[-AROUND:]), np.int64), _codes(b[-AROUND:]), _codes(v)])
            n = max(1, -(-len(v) // INSIDE))
            for k in range(n):
                row = np.zeros(2 * AROUND + INSIDE, np.int64)
                body = whole[k * INSIDE : (k + 1) * INSIDE + AROUND]
                row[: len(body)] = body
                tail = _codes(z[:AROUND]) if k == n - 1 else whole[(k + 1) * INSIDE + AROUND :][:AROUND]
                row[AROUND + INSIDE : AROUND + INSIDE + len(tail)] = tail
                rows.append(row)
                first.append(k == 0)
                last.append(k == n - 1)
            at.append(len(rows))
        self.rows = np.array(rows).reshape(-1, 2 * AROUND + INSIDE)
        self.first, self.last, self.at = np.array(first, bool), np.array(last, bool), np.array(at)

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, which: np.ndarray) -> Pieces:
        """The given candidates, in that order."""
        n = np.diff(self.at)[which]
        rows = np.repeat(self.at[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = Pieces([], [], [])
        out.rows, out.first, out.last, out.at = self.rows[rows], self.first[rows], self.last[rows], np.r_[0, np.cumsum(n)]
        return out


class Network:
    """The convolutional network with its calibration; a few thousand numbers."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.3, (_CLASSES, DEPTH))
        self.conv = r.normal(0, 0.2, (WIDTH * DEPTH, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = r.normal(0, 0.2, 2 * FILTERS)
        self.out_bias = np.zeros(1)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 1.1
        self.first, self.second = ([np.zeros_like(p) for p in self._params()] for _ in range(2))
        self.steps = 0.0

    def _params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.out_bias]

    def state(self) -> np.ndarray:
        """All that training changes, such that means of it are of use: weights, moments of their gradients, steps."""
        parts = [*self._params(), *self.first, *map(np.sqrt, self.second), np.array([self.steps])]
        return np.concatenate([p.ravel() for p in parts])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for p in (*self._params(), *self.first, *self.second):
            p[...] = state[at : at + p.size].reshape(p.shape)
            at += p.size
        for p in self.second:
            p *= p
        self.steps = float(state[at])

    def _respond(self, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Convolved windows of each row, where each filter responds most (inside, then around), and how much."""
        e = self.embed[rows] * (rows > 0)[..., None]
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(rows), -1, WIDTH * DEPTH)
        h = np.maximum(w @ self.conv + self.bias, 0)
        inner = h[:, AROUND - 2 : AROUND + INSIDE]
        place = np.arange(h.shape[1])[None]
        around = ((place < AROUND - 2) & first[:, None]) | ((place >= AROUND + INSIDE) & last[:, None])
        outer = np.where(around[..., None], h, -1.0)
        where = np.concatenate([inner.argmax(1) + AROUND - 2, outer.argmax(1)], 1)
        most = np.concatenate([inner.max(1), outer.max(1)], 1)
        return w, where, most

    def logits(self, x: Pieces) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        cuts = range(0, len(x.rows), PIECES)
        most = np.concatenate([self._respond(x.rows[a : a + PIECES], x.first[a : a + PIECES], x.last[a : a + PIECES])[2] for a in cuts])
        return np.maximum.reduceat(most, x.at[:-1]) @ self.out + self.out_bias

    def probability(self, x: Pieces) -> np.ndarray:
        return self._scaled(self.logits(x))

    def _scaled(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def fit(self, x: Pieces, y: np.ndarray, epochs: int = ROUNDS, rate: float = 0.01, seed: int | list[int] = 7, weight: np.ndarray | None = None) -> None:
        """Training (Adam) goes on from where it stands."""
        params, weight = self._params(), np.ones(len(y)) if weight is None else weight
        r, t = np.random.default_rng(seed), self.steps
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), 128):
                some = order[a : a + 128]
                part = x.take(some)
                w, where, most = self._respond(part.rows, part.first, part.last)
                pooled = np.maximum.reduceat(most, part.at[:-1])
                # of a candidate's rows, the one where the filter responds most
                row = np.repeat(part.at[:-1, None], 2 * FILTERS, 1)
                for c in np.flatnonzero(np.diff(part.at) > 1):
                    row[c] += most[part.at[c] : part.at[c + 1]].argmax(0)
                place = np.take_along_axis(where, row, 0)
                z = pooled @ self.out + self.out_bias
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * weight[some] / len(some)
                back = d[:, None] * self.out * (pooled > 0)
                picked = w[row, place]  # candidates, filters twice, width * depth
                both = back[:, :FILTERS, None] * picked[:, :FILTERS], back[:, FILTERS:, None] * picked[:, FILTERS:]
                to_e = np.zeros_like(self.embed)
                for half in (slice(0, FILTERS), slice(FILTERS, 2 * FILTERS)):
                    g = (back[:, half, None] * self.conv.T[None]).reshape(len(some), FILTERS, WIDTH, DEPTH)
                    at = part.rows[row[:, half, None], place[:, half, None] + np.arange(WIDTH)]
                    np.add.at(to_e, at, g * (at > 0)[..., None])
                grads = [to_e, sum(b.sum(0) for b in both).T, back[:, :FILTERS].sum(0) + back[:, FILTERS:].sum(0), d @ pooled, d.sum(keepdims=True)]
                t += 1
                for p, g, m, v in zip(params, grads, self.first, self.second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.steps = t

    def calibrate(self, x: Pieces, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling and the recall-constrained threshold on held-out findings."""
        self.calibrate_counted(self.logits(x), y, np.ones(len(y)), recall)

    def calibrate_counted(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = RECALL) -> None:
        """The same of outputs z and labels y that n findings have."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, d = n * p * (1 - p), n * (p - y)
            h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(h, [(d * z).sum() + 1e-2 * (a - 1), d.sum() + 1e-2 * b])
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-6:
                break
        self.slope, self.shift = float(a), float(b)
        good, n = self._scaled(z[y == 1]), n[y == 1]
        order = np.argsort(good, kind="stable")
        below = np.cumsum(n[order])
        self.threshold = float(good[order][np.searchsorted(below, int((1 - recall) * below[-1]), "right")])


def _dealt(rows: DataFrame, counts: dict[int, int], size: int) -> tuple[DataFrame, dict[int, int]]:
    """Distinct findings in shards of about size rows: shard, rows (in order of a hash). Also how often a finding of each label is dealt.

    A label too rare for every shard to have some of it is dealt to several.
    """
    shards = -(-sum(counts.values()) // size)
    times = {y: min(shards, max(1, -(-shards * (size // SHARE) // n))) for y, n in counts.items()}
    turn = F.when(F.col("label") == 1, times[1]).otherwise(times[0])
    dealt = rows.withColumn("hash", F.xxhash64("before", "value", "after", "label")).withColumn("turns", turn)
    dealt = dealt.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    shard = (F.pmod("hash", F.lit(shards)) + F.col("turn") * F.floor(F.lit(shards) / F.col("turns"))) % shards
    dealt = dealt.select(shard.alias("shard"), F.struct("hash", "before", "value", "after", "label", "held", "turn").alias("row"))
    dealt = dealt.repartition(min(shards, partitions(rows.sparkSession)), "shard")
    return dealt.groupBy("shard").agg(F.sort_array(F.collect_list("row")).alias("rows")), times


def _lessons(rows: list[dict], held: bool) -> tuple[Pieces, np.ndarray]:
    """The held-out findings of a shard, or the others, with their labels; secrets also planted where ordinary text stands around."""
    plain, secret = ([r for r in rows if r["label"] == y] for y in (0, 1))
    place = np.random.default_rng(7).permutation(len(plain))
    some = [r for r in plain if r["held"] == held]
    every, ones = [(r["before"], r["value"], r["after"]) for r in some], 0
    for k, r in enumerate(secret):
        if r["held"] == held:
            around = [r, *([plain[place[k % len(plain)]]] if plain else [])]
            every += [(x["before"], r["value"], x["after"]) for x in around]
            ones += len(around)
    return Pieces(*map(list, zip(*every, strict=True))) if every else Pieces([], [], []), np.r_[np.zeros(len(some)), np.ones(ones)]


def _round(shards: DataFrame, net: Network, number: int, weight: dict[int, float], findings: int) -> np.ndarray:
    """The mean state that the shards bring net to, by their findings. Sums are of whole numbers, so the order of tasks changes nothing."""
    bits = 50 - findings.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, total = net.state(), np.zeros(len(net.state()) + 1, np.int64)
        for b in batches:
            for k, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x, y = _lessons(rows.as_py(), False)
                if len(x):
                    net.load(start)
                    net.fit(x, y, 1, seed=[7, number, k], weight=np.where(y == 1, weight[1], weight[0]))
                    total += np.r_[np.rint(np.clip(net.state(), -1000, 1000) * 2.0**bits).astype(np.int64) * len(x), len(x)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "sum"])
        release()

    with small_batches(shards.sparkSession, 8):
        got = shards.mapInArrow(run, "at long, sum long").groupBy("at").agg(F.sum("sum").alias("sum")).orderBy("at").collect()
    sums = [r["sum"] for r in got]
    return np.array([x / sums[-1] for x in sums[:-1]]) / 2.0**bits


def _outputs(shards: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outputs of the held-out findings, rounded down to steps, their labels, and how many have them: of a size that no input exceeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[int, int]] = Counter()
        for b in batches:
            for rows in b.column(1):
                x, y = _lessons([r for r in rows.as_py() if r["turn"] == 0], True)
                z = np.floor(np.clip(net.logits(x), -MOST, MOST) * STEPS).astype(int)
                n.update(zip(z.tolist(), y.astype(int).tolist(), strict=True))
        columns = [[z for z, _ in n], [y for _, y in n], list(n.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["z", "y", "n"])
        release()

    with small_batches(shards.sparkSession, 8):
        counted = shards.mapInArrow(run, "z long, y long, n long").groupBy("z", "y").agg(F.sum("n").alias("n")).orderBy("z", "y").collect()
    z, y, n = (np.array([r[k] for r in counted], float) for k in range(3))
    return z / STEPS, y, n


def train(found: DataFrame, size: int = SHARD, recall: float = RECALL) -> Network | None:
    """A network from all distinct labelled findings (label, before, value, after), in shards of about size; the driver gets sums only."""
    held = (F.pmod(F.xxhash64("value"), F.lit(4)) == 0).alias("held")
    rows = materialize(found.where(F.col("label").isin(0, 1)).select("label", "before", "value", "after", held).distinct())
    n = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", "held").count().collect()}
    counts = {y: n.get((y, False), 0) + n.get((y, True), 0) for y in (0, 1)}
    if min(counts.values()) < LEAST or not all(n.get(k) for k in ((1, True), (0, False), (1, False))):
        forget(rows)
        return None
    dealt, times = _dealt(rows, counts, size)
    shards = materialize(dealt)
    forget(rows)
    findings = sum(counts[y] * times[y] * (y + 1) for y in (0, 1))
    weight = {y: findings / (3 * counts[y] * times[y]) for y in (0, 1)}
    net = Network()
    for number in range(ROUNDS):
        net.load(_round(shards, net, number, weight, findings))
    net.calibrate_counted(*_outputs(shards, net), recall)
    forget(shards)
    return net


#: What stands before the value of an assignment.
_KEYWORD = r"^((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)"


def labelled(found: DataFrame) -> DataFrame:
    """The labelled findings; the keyword of an assignment counts as context."""
    s = found.select(F.explode("spans").alias("s")).select("s.*").where(F.col("label") >= 0)
    key = F.when(F.col("kind") == 0, F.regexp_extract("value", _KEYWORD, 1)).otherwise("")
    return s.select(
        "label", F.substring(F.concat("before", key), -AROUND, AROUND).alias("before"),
        F.substring(F.col("value"), F.length(key) + 1, F.length("value")).alias("value"), "after",
    )


def _chosen(texts: list[list[tuple[int, int, int, str, str, str]]], net: Network | None) -> list[list[tuple[int, int, int, float]]]:
    """Per text its spans (start, kind, end, score): base ones, and what the network adds."""
    flat = [(r, s) for r, spans in enumerate(texts) for s in spans if s[0] != 4]
    score = np.ones(len(flat))
    if net is not None and flat:
        score = net.probability(Pieces([s[3] for _, s in flat], [s[4] for _, s in flat], [s[5] for _, s in flat]))
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for (r, s), p in zip(flat, score, strict=True):
        if s[0] < 3 or (net is not None and p >= net.threshold):
            out[r].append((s[1], s[0], s[2], float(p)))
    return [sorted(x) for x in out]


def scan(found: DataFrame, net: Network | None) -> DataFrame:
    """found (doc_id, spans of candidates) -> doc_id, spans (kind, start, end, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            texts = [[tuple(s.values()) for s in spans] for spans in b.column(1).to_pylist()]
            out = [[{"kind": KINDS[k], "start": a, "end": e, "score": p} for a, k, e, p in x] for x in _chosen(texts, net)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and all its spans (kind, start, end, score)."""
    with small_batches(docs.sparkSession):
        found = materialize(find_candidates(docs, id_col, text_col))
    return scan(found, train(labelled(found)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span, overlapping ones as one, replaced by mask; all rows and columns stay."""
    with small_batches(docs.sparkSession):
        found = materialize(find_candidates(docs, id_col, text_col))
    net = train(labelled(found))
    forget(found)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            found = []
            for t in texts:
                t = t or ""
                found.append([(k, a, e, t[max(0, a - AROUND) : a], t[a:e], t[e : e + AROUND]) for a, k, e in candidates(t)])
            for r, spans in enumerate(_chosen(found, net)):
                if not spans:
                    continue
                text, out, end = texts[r], [], 0
                for a, _, e, _ in spans:
                    if a >= end:
                        out += [text[end:a], mask]
                    end = max(end, e)
                texts[r] = "".join([*out, text[end:]])
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)
        release()

    return docs.mapInArrow(run, docs.schema)
