"""URL filters by a sort-merge range join over reversed-host keys.

A rule (host, path) fits its host and all subdomains where the url's path starts with the
rule's path; the longest rule wins. Hosts are written label by label from the right
(``www.example.com`` is ``com.example.www.``), so a rule's host is a prefix of the key and a
prefix is an interval of keys. Urls and rules are dealt into shards, sorted by key with
rules first, and swept once: a stack holds the hosts whose interval is open, nested ones on
top, and is cut back when the key leaves an interval. The paths of an open host arrive in
order, each with the longest one that it extends, so a url's longest rule is found by one
bisection and a walk up these, however many rules a host has.

Shards: a url goes by its top two labels; two labels that hold more than a shard's share of all
urls are counted before and get as many neighbouring shards as they hold shares, so a host with
a third of all rows is spread evenly on any number of shards. There are at most as many such
labels as shards. A rule with two labels or more goes to all shards of its labels, a shorter one
to every shard. Memory per task is the stack; rows stream.

Defined results: null urls, or urls without ``://``, have an empty host and path and fit no
rule; repeated rows, and rows with a null id, are judged each; among rules of equal length the
longer host, then the smaller text, then the smaller verdict wins; rules with a null host, path or verdict are left out; empty rules leave
all urls with the default verdict.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, partitions, small_side

DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    """Labels from the right, each closed by a dot."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class _Paths:
    """The rules of one host: distinct paths in order, each with its verdict and the longest path that it extends."""

    def __init__(self):
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.shorter: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            return
        k = len(self.paths) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.shorter[k]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.shorter.append(k)

    def longest(self, path: str) -> int:
        """The place of the longest rule that path starts with, or -1."""
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.shorter[k]
        return k


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """urls (id, url) and rules (host, path, verdict) -> id, host, path, rule, verdict."""
    shards = partitions(urls.sparkSession)
    url = F.coalesce(F.col(url_col), F.lit(""))
    u = urls.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", host_key(F.col("host")))
    u = u.withColumn("top", F.array_join(F.slice(F.split("key", r"\."), 1, 2), "."))
    share = max(1, urls.count() // shards)
    heavy = u.groupBy("top").count().where(F.col("count") > share)
    heavy = small_side(heavy.select("top", F.least(F.ceil(F.col("count") / share), F.lit(shards)).cast("int").alias("spread")))
    shard = lambda top, k: F.pmod(F.xxhash64(top) + k, F.lit(shards)).cast("int")
    spread = F.coalesce("spread", F.lit(1))
    u = u.join(heavy, "top", "left").select(
        shard(F.col("top"), F.pmod(F.xxhash64("id", "host", "path"), spread)).alias("shard"), "key", F.lit(1).alias("kind"), "path", "id", "host",
        F.lit(None).cast("string").alias("verdict"),
    )
    r = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna().distinct().withColumn("key", host_key(F.col("host")))
    r = r.withColumn("top", F.array_join(F.slice(F.split("key", r"\."), 1, 2), ".")).join(heavy, "top", "left")
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.transform(F.sequence(F.lit(0), spread - 1), lambda k: shard(F.col("top"), k))
    r = r.withColumn("shard", F.explode(F.when(F.size(F.split("key", r"\.")) < 3, every).otherwise(own)))
    r = r.select("shard", "key", F.lit(0).alias("kind"), "path", F.lit(None).cast(u.schema["id"].dataType).alias("id"), "host", "verdict")
    kind = u.schema["id"].dataType.simpleString()
    dealt = u.unionByName(r).repartition(shards, "shard").sortWithinPartitions("shard", "key", "kind", "path", "verdict")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, stack = None, []  # (key of the host, host, its paths)
        for b in batches:
            at = {c: b.column(k).to_pylist() for k, c in enumerate(b.schema.names)}
            keep, rule, verdict = [], [], []
            for k in range(b.num_rows):
                if at["shard"][k] != shard:
                    shard, stack = at["shard"][k], []
                key = at["key"][k]
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                path = at["path"][k]
                if at["kind"][k] == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, at["host"][k], _Paths()))
                    stack[-1][2].add(path, at["verdict"][k])
                    continue
                best = None
                for _, host, paths in stack if key else []:
                    found = paths.longest(path)
                    if found >= 0:
                        text = host + paths.paths[found]
                        rank = (-len(text), -len(host), text)
                        if best is None or rank < best[0]:
                            best = (rank, text, paths.verdicts[found])
                keep.append(k)
                rule.append(best[1] if best else None)
                verdict.append(best[2] if best else default)
            rows = b.take(pa.array(keep, pa.int64()))
            cols = [rows.column(rows.schema.get_field_index(c)) for c in ("id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    out = dealt.mapInArrow(sweep, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
