"""Registered queries of the recognition operators, with the SQL that gives the same rows.

The tables hold no cards, so operators are bound to stand-ins. Names are part names, and for
parts of some sizes longer ones with the brand, which are near to each other. Printings are
(name, brand) pairs: short names have many, long ones none, one or two. A scan is a part with its
name corrupted as a reader would, and a hash that differs from the stored one in up to sixteen
digits. Hashes are digests, or signs of embeddings; the collection is what was ordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import merged, new_path, spread, table
from ..functions import hashing, text
from ..functions.geometry import LEFT, MIN_HEIGHT, MIN_WIDTH, REGIONS, crop_box, large_enough
from ..operators import fuzzy, grams, routing, types, validation, verify
from ..schemas import TABLES
from ..sources import keyed, readers
from .backfill import Ledger, backfill, run_backfill
from .backfill import cards_by_set as by_set
from .backfill import dictionary_slice as slice_of
from .recognition import recognise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CREATURES = ["Widget", "Bolt", "Gizmo", "Gear", "Angel", "Elf"]


def registered(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- bindings -----------------------------------------------------------------------------

NOISY_SQL = "replace(lower(replace(p_name, ' ', '')), 'o', '0') || CAST(p_partkey % 7 AS VARCHAR)"
LONG_SQL = "p_name || ' collected edition ' || p_brand"
NAMES_SQL = f"SELECT min(name) AS name FROM (SELECT p_name AS name FROM part UNION ALL SELECT {LONG_SQL} FROM part WHERE p_size IN (7, 8, 9)) GROUP BY lower(name)"


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


def _long():
    return F.concat("p_name", F.lit(" collected edition "), "p_brand")


def _digest(name, set_name):
    """The hash of a printing; brands that share their first seven characters share it."""
    return F.sha2(F.concat(name, F.substring(set_name, 1, 7)), 256)


def _noisy():
    noisy = F.replace(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit("o"), F.lit("0"))
    return F.concat(noisy, (F.col("p_partkey") % 7).cast("string"))


def _zeroed(hash_, k):
    """The hash with its first k digits set to 0."""
    return F.overlay(hash_, F.repeat(F.lit("0"), k), F.lit(1))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(size.isin(7, 8, 9), _long()).otherwise(F.col("p_name"))
    text_ = F.when(size.isin(7, 9), F.lower(_long())).when(size == 8, F.replace(F.lower(_long()), F.lit("e"), F.lit("3"))).otherwise(_noisy())
    return _part(spark, d).select(key.alias("scan_id"), text_.alias("text"), _zeroed(_digest(name, F.col("p_brand")), (key % 9 * 2).cast("int")).alias("hash"))


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d)
    return fuzzy.dictionary_of(p.select(F.col("p_name").alias("name")).unionByName(p.where(F.col("p_size").isin(7, 8, 9)).select(_long().alias("name"))))


def _printings(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d)
    row = lambda name, set_name: [name.alias("name"), set_name.alias("set_name"), "p_partkey", "p_retailprice"]
    every = p.select(*row(F.col("p_name"), F.col("p_brand"))).unionByName(p.where(F.col("p_size").isin(7, 9)).select(*row(_long(), F.col("p_brand"))))
    every = every.unionByName(p.where(F.col("p_size") == 9).select(*row(_long(), F.concat("p_brand", F.lit("x")))))
    return every.groupBy("name", "set_name").agg(
        F.min("p_partkey").alias("magic_id"), F.min("p_retailprice").cast("decimal(18,4)").cast("string").alias("usd")
    )


def _collection(spark: SparkSession, d: str) -> DataFrame:
    part = _part(spark, d).select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"))
    line = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    line = line.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return line.join(merged(part), line.l_partkey == part.p_partkey).groupBy("name", "set_name").agg(F.sum("q").cast("long").alias("quantity"))


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return _printings(spark, d).select("name", "set_name", "magic_id", _digest(F.col("name"), F.col("set_name")).alias("card_hash"))


GRAM_SQL = "'-' || regexp_replace(lower({x}), '[^a-zA-Z0-9À-ÿ, ]+', '', 'g') || '-'"


def _grams_sql(source: str, col: str, n: int) -> str:
    v = GRAM_SQL.format(x=col)
    return f"SELECT x, g AS gram, count(*) AS ct FROM (SELECT {col} AS x, unnest(list_transform(range(1, CAST(length({v}) AS BIGINT) - {n} + 2), lambda i: substr({v}, i, {n}))) AS g FROM {source}) GROUP BY x, g"


def _level_sql(n: int, source: str) -> str:
    """CTEs q{n}, d{n}, .., r{n}: the ranked results of one gram size for the texts of source."""
    return f"""
q{n} AS ({_grams_sql(source, 'text', n)}), qn{n} AS (SELECT x, sqrt(sum(ct * ct)) AS norm FROM q{n} GROUP BY x),
d{n} AS ({_grams_sql('dict', 'name', n)}), dn{n} AS (SELECT x, sqrt(sum(ct * ct)) AS norm FROM d{n} GROUP BY x),
dot{n} AS (SELECT q.x AS text, d.x AS name, sum(q.ct * d.ct) AS dot FROM q{n} q JOIN d{n} d ON q.gram = d.gram GROUP BY q.x, d.x),
cos{n} AS (SELECT text, name, round(CAST(dot AS DOUBLE) / (a.norm * b.norm), 12) AS cos FROM dot{n} JOIN qn{n} a ON text = a.x JOIN dn{n} b ON name = b.x),
s{n} AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY cos DESC, name) AS cos_rank FROM cos{n}),
l{n} AS (SELECT text, name, cos, cos_rank, 1 - levenshtein(lower(text), lower(name)) / CAST(greatest(length(text), length(name)) AS DOUBLE) AS score FROM s{n} WHERE cos_rank <= 50),
r{n} AS (SELECT text, name, score, row_number() OVER (PARTITION BY text ORDER BY score DESC, cos_rank) AS rank FROM l{n} QUALIFY score >= 0.33)"""


def _lookup_sql(texts: str = "SELECT DISTINCT text FROM scans", names: str = NAMES_SQL) -> str:
    return f"""texts AS ({texts}), dict AS ({names}), {_level_sql(3, 'texts')},
rest AS (SELECT text FROM texts WHERE text NOT IN (SELECT text FROM r3)), {_level_sql(2, 'rest')},
found AS (SELECT * FROM r3 UNION ALL SELECT * FROM r2)"""


_ZEROED_SQL = "repeat('0', CAST({k} AS BIGINT)) || substr({h}, CAST({k} AS BIGINT) + 1)"
_SCAN_HASH_SQL = f"sha256((CASE WHEN p_size IN (7, 8, 9) THEN {LONG_SQL} ELSE p_name END) || substr(p_brand, 1, 7))"
SCANS_SQL = f"""scans AS (SELECT p_partkey AS scan_id, CASE WHEN p_size IN (7, 9) THEN lower({LONG_SQL}) WHEN p_size = 8 THEN replace(lower({LONG_SQL}), 'e', '3') ELSE {NOISY_SQL} END AS text,
{_ZEROED_SQL.format(h=_SCAN_HASH_SQL, k='(p_partkey % 9 * 2)')} AS hash FROM part)"""
TOPK_SQL = f"{SCANS_SQL}, {_lookup_sql()}, topk AS (SELECT scan_id, text, name, score, rank FROM scans JOIN found USING (text))"
POLICY_SQL = f"""{TOPK_SQL}, high AS (SELECT *, sum(CASE WHEN score >= 0.95 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id) AS hi FROM topk),
policy AS (SELECT scan_id, text, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY rank) AS n FROM high
WHERE score >= CASE WHEN hi > 1 THEN 0.95 ELSE 0.70 END) WHERE n <= 6)"""
PRINTINGS_SQL = f"""printings AS (SELECT name, set_name, min(p_partkey) AS magic_id, CAST(min(p_retailprice) AS DECIMAL(18,4)) AS usd FROM (
SELECT p_name AS name, p_brand AS set_name, p_partkey, p_retailprice FROM part UNION ALL SELECT {LONG_SQL}, p_brand, p_partkey, p_retailprice FROM part WHERE p_size IN (7, 9)
UNION ALL SELECT {LONG_SQL}, p_brand || 'x', p_partkey, p_retailprice FROM part WHERE p_size = 9) GROUP BY 1, 2)"""
COLLECTION_SQL = "collection AS (SELECT p_name AS name, p_brand AS set_name, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


# --- fuzzy lookup -------------------------------------------------------------------------


@registered(f"WITH {TOPK_SQL} SELECT scan_id, name, round(score, 6) AS score, rank FROM topk")
def fuzzy_topk(spark: SparkSession, d: str) -> DataFrame:
    out = fuzzy.fuzzy_topk(_scans(spark, d).select("scan_id", "text"), _dictionary(spark, d))
    return out.select("scan_id", "name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@registered(f"WITH {POLICY_SQL} SELECT scan_id, name, round(score, 6) AS percentage FROM policy")
def fuzzy_policy(spark: SparkSession, d: str) -> DataFrame:
    out = fuzzy.confidence_policy(fuzzy.fuzzy_topk(_scans(spark, d).select("scan_id", "text"), _dictionary(spark, d)))
    return out.select("scan_id", "name", F.round("score", 6).alias("percentage"))


@registered(f"WITH {SCANS_SQL}, {_lookup_sql()} SELECT text, name, round(cos, 9) AS cos, cos_rank FROM s3 WHERE cos_rank <= 50")
def fuzzy_shortlist(spark: SparkSession, d: str) -> DataFrame:
    out = fuzzy.shortlist(_scans(spark, d).select("text").distinct(), _dictionary(spark, d), 3)
    return out.select("text", "name", F.round("cos", 9).alias("cos"), F.col("cos_rank").cast("long").alias("cos_rank"))


INDEXED_SQL = NAMES_SQL.replace("FROM part UNION", "FROM part WHERE p_size <> 5 UNION").replace("(7, 8, 9)", "(7, 9)")


@registered(f"WITH {SCANS_SQL}, {_lookup_sql(names=INDEXED_SQL)} SELECT text, name, round(cos, 9) AS cos, cos_rank FROM s3 WHERE cos_rank <= 50")
def gram_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The shortlist by a persisted index that was built, then given names, then relieved of others."""
    p = _part(spark, d)
    first = p.select(F.col("p_name").alias("name")).unionByName(p.where(F.col("p_size").isin(7, 8)).select(_long().alias("name")))
    more = p.where(F.col("p_size") == 9).select(_long().alias("name"))
    goes = p.where(F.col("p_size") == 8).select(_long().alias("name")).join(p.where(F.col("p_size").isin(7, 9)).select(_long().alias("name")), "name", "left_anti")
    goes = goes.unionByName(p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").alias("s"), F.max("p_size").alias("t")).where((F.col("s") == 5) & (F.col("t") == 5)).select("name"))
    path = new_path(spark)
    index = grams.GramTable(spark, "grams_" + path.rsplit("/", 1)[1], 3, 8, path)
    index.build(fuzzy.dictionary_of(first))
    index.update(added=more, dropped=goes)
    index.update(added=more, dropped=goes)
    out = grams.nearest(_scans(spark, d).select("text").distinct(), index.index())
    return out.select("text", "name", F.round("cos", 9).alias("cos"), F.col("cos_rank").cast("long").alias("cos_rank"))


@registered(f"SELECT x AS name, gram, ct FROM ({_grams_sql('(SELECT DISTINCT p_name FROM part)', 'p_name', 3)})")
def gram_counts(spark: SparkSession, d: str) -> DataFrame:
    names = _part(spark, d).select("p_name").distinct()
    g = names.select(F.col("p_name").alias("name"), F.explode(text.gram_counts(F.col("p_name"), 3)).alias("g"))
    return g.select("name", F.col("g.gram").alias("gram"), F.col("g.ct").cast("long").alias("ct"))


@registered(f"SELECT x AS name, round(sqrt(sum(ct * ct)), 9) AS norm FROM ({_grams_sql('(SELECT DISTINCT p_name FROM part)', 'p_name', 2)}) GROUP BY x")
def gram_norms(spark: SparkSession, d: str) -> DataFrame:
    names = _part(spark, d).select("p_name").distinct()
    return names.select(F.col("p_name").alias("name"), F.round(text.norm(text.gram_counts(F.col("p_name"), 2)), 9).alias("norm"))


@registered(f"SELECT p_partkey, round(1 - levenshtein({NOISY_SQL}, lower(p_name)) / CAST(greatest(length({NOISY_SQL}), length(p_name)) AS DOUBLE), 9) AS score FROM part")
def lev_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", F.round(text.edit_similarity(_noisy(), F.col("p_name")), 9).alias("score"))


# --- hashes -------------------------------------------------------------------------------

_BIT = "(CASE WHEN embedding[i * 4 + {k}] > 0 THEN {v} ELSE 0 END)"
_DIGIT = " + ".join(_BIT.format(k=k, v=v) for k, v in ((1, 8), (2, 4), (3, 2), (4, 1)))
HASHES_SQL = f"hashes AS (SELECT vec_id, label, array_to_string(list_transform(range(0, 16), lambda i: lower(to_hex({_DIGIT}))), '') AS short, repeat(short, 4) AS hash FROM embeddings)"
STORED_SQL = f"""stored AS (SELECT label, set_name, {_ZEROED_SQL.format(h='whole', k='(CAST(set_name AS INT) % 7 * 2)')} AS card_hash
FROM (SELECT label, CAST(vec_id % 16 AS VARCHAR) AS set_name, arg_min(hash, vec_id) AS whole FROM hashes GROUP BY 1, 2))"""


def _slot_sql(n: int) -> str:
    hit = f"CASE WHEN i = 0 OR substr(hash, i - {n} + 1, {n}) = substr(card_hash, i - {n} + 1, {n}) THEN 1 ELSE 0 END"
    return f"round(list_sum(list_transform(range(0, CAST(length(hash) AS BIGINT), {n}), lambda i: {hit})) / (length(hash) / CAST({n} AS DOUBLE)), 2)"


_PAIRS = "list_transform(range(1, CAST(length({h}) AS BIGINT)), lambda i: substr({h}, i, 2))"
_DICE_SQL = (
    "round(CASE WHEN hash = card_hash THEN 1.0 ELSE 2.0 * list_sum(list_transform(list_distinct(pa), lambda g: least(len(list_filter(pa, lambda x: x = g)), "
    "len(list_filter(pb, lambda x: x = g))))) / (length(hash) + length(card_hash) - 2) END, 2)"
)
_SCORES_SQL = f"""pairs AS (SELECT *, {_PAIRS.format(h='hash')} AS pa, {_PAIRS.format(h='card_hash')} AS pb FROM joined),
scored AS (SELECT *, {_slot_sql(2)} AS two, {_slot_sql(4)} AS four, CAST({_DICE_SQL} AS DOUBLE) AS string FROM pairs)"""
COMPARED_SQL = f"{HASHES_SQL}, {STORED_SQL}, joined AS (SELECT vec_id, h.label, hash, set_name, card_hash FROM hashes h JOIN stored s ON h.label = s.label), {_SCORES_SQL}"


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.repeat(hashing.sign_hash(F.col("embedding")), 4).alias("hash"))


def _stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d).groupBy("label", (F.col("vec_id") % 16).cast("string").alias("set_name")).agg(F.min_by("hash", "vec_id").alias("whole"))
    return h.select("label", "set_name", _zeroed(F.col("whole"), F.col("set_name").cast("int") % 7 * 2).alias("card_hash"))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    asked = spread(_hashes(spark, d), "vec_id").select("vec_id", "label", hashing.parts(F.col("hash")).alias("a"))
    j = asked.join(_stored_hashes(spark, d).select("label", "set_name", hashing.parts(F.col("card_hash")).alias("b")), "label")
    return j.select("vec_id", "set_name", *hashing.compare_parts(F.col("a"), F.col("b")))


@registered(f"WITH {HASHES_SQL} SELECT vec_id, label, hash FROM hashes")
def hash_from_vector(spark: SparkSession, d: str) -> DataFrame:
    return _hashes(spark, d)


@registered(f"WITH {COMPARED_SQL} SELECT vec_id, set_name, two FROM scored")
def hash_slot2(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("vec_id", "set_name", "two")


@registered(f"WITH {COMPARED_SQL} SELECT vec_id, set_name, four FROM scored")
def hash_slot4(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("vec_id", "set_name", "four")


@registered(f"WITH {COMPARED_SQL} SELECT vec_id, set_name, string FROM scored")
def hash_dice(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("vec_id", "set_name", "string")


@registered(f"WITH {COMPARED_SQL} SELECT vec_id, set_name, two, four, string FROM scored")
def hash_compare(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)


def _profile_sql(p: hashing.Profile) -> str:
    return f"two >= {p.two} AND four >= {p.four} AND string >= {p.string}"


@registered(f"WITH {COMPARED_SQL} SELECT vec_id, set_name FROM scored WHERE {_profile_sql(hashing.STORED)}")
def hash_match_db(spark: SparkSession, d: str) -> DataFrame:
    return verify.hash_matches(_hashes(spark, d), _stored_hashes(spark, d), hashing.STORED, ["label"]).select("vec_id", "set_name")


@registered(f"WITH {COMPARED_SQL} SELECT vec_id, set_name FROM scored WHERE {_profile_sql(hashing.REMOTE)}")
def hash_match_remote(spark: SparkSession, d: str) -> DataFrame:
    return verify.hash_matches(_hashes(spark, d), _stored_hashes(spark, d), hashing.REMOTE, ["label"]).select("vec_id", "set_name")


@registered(
    f"""WITH {COMPARED_SQL}, hits AS (SELECT vec_id, set_name, 0 AS src FROM scored WHERE CAST(set_name AS INT) < 8 AND {_profile_sql(hashing.STORED)}
UNION SELECT vec_id, set_name, 1 FROM scored WHERE {_profile_sql(hashing.REMOTE)}),
firsts AS (SELECT vec_id, set_name, min(src) AS src FROM hits GROUP BY 1, 2)
SELECT vec_id, string_agg(set_name, ',' ORDER BY src, set_name) AS sets FROM firsts GROUP BY vec_id"""
)
def matched_sets_union(spark: SparkSession, d: str) -> DataFrame:
    every = _stored_hashes(spark, d)
    out = verify.matched_sets(_hashes(spark, d), every.where(F.col("set_name").cast("int") < 8), every, ["label"], ["vec_id"])
    return out.select("vec_id", F.array_join("sets", ",").alias("sets"))


# --- candidates, routing, collection ------------------------------------------------------


def _matches(spark: SparkSession, d: str) -> DataFrame:
    found = fuzzy.confidence_policy(fuzzy.fuzzy_topk(_scans(spark, d).select("scan_id", "text"), _dictionary(spark, d)))
    return found.select("scan_id", "name")


@registered(f"WITH {POLICY_SQL}, {PRINTINGS_SQL} SELECT scan_id, name, set_name, magic_id FROM policy LEFT JOIN printings USING (name)")
def candidate_printings(spark: SparkSession, d: str) -> DataFrame:
    return verify.candidate_printings(_matches(spark, d), _printings(spark, d)).select("scan_id", "name", "set_name", "magic_id")


@registered(
    f"""WITH queries AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS query FROM part), {PRINTINGS_SQL}
SELECT query, name, set_name FROM queries JOIN printings ON contains(lower(name), lower(query))"""
)
def names_containing(spark: SparkSession, d: str) -> DataFrame:
    queries = _part(spark, d).select(F.get(F.split("p_name", " "), F.lit(1)).alias("query")).distinct()
    return verify.names_containing(queries, _printings(spark, d)).select("query", "name", "set_name")


DISPATCH_SQL = """counted AS (SELECT name, count(*) AS n, min(set_name) AS s FROM printings GROUP BY name),
dispatched AS (SELECT scan_id, name, coalesce(n, 0) AS n_printings, CASE WHEN n = 1 THEN s END AS only_set,
CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS action FROM policy LEFT JOIN counted USING (name))"""


@registered(f"WITH {POLICY_SQL}, {PRINTINGS_SQL}, {DISPATCH_SQL} SELECT * FROM dispatched")
def dispatch_by_count(spark: SparkSession, d: str) -> DataFrame:
    return verify.dispatch(_matches(spark, d), _printings(spark, d))


ROUTED_SQL = f"""{POLICY_SQL}, {PRINTINGS_SQL}, {COLLECTION_SQL}, {DISPATCH_SQL},
joined AS (SELECT d.scan_id, d.name, s.hash, p.set_name, p.magic_id, sha256(p.name || substr(p.set_name, 1, 7)) AS card_hash FROM dispatched d JOIN scans s ON d.scan_id = s.scan_id JOIN printings p ON p.name = d.name WHERE action = 'many'),
{_SCORES_SQL},
hits AS (SELECT scan_id, name, set_name, 0 AS src FROM scored WHERE magic_id % 2 = 0 AND {_profile_sql(hashing.STORED)} UNION SELECT scan_id, name, set_name, 1 FROM scored WHERE {_profile_sql(hashing.REMOTE)}),
firsts AS (SELECT scan_id, name, set_name, min(src) AS src FROM hits GROUP BY 1, 2, 3),
verified AS (SELECT scan_id, name, string_agg(set_name, ',' ORDER BY src, set_name) AS sets FROM firsts GROUP BY 1, 2),
resolved AS (SELECT d.scan_id, d.name, CASE WHEN action = 'one' THEN only_set ELSE coalesce(sets, '') END AS sets FROM dispatched d LEFT JOIN verified v ON d.scan_id = v.scan_id AND d.name = v.name),
routed AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY scan_id) = 1 THEN 'collection' ELSE 'attention' END AS target FROM resolved)"""


def _outcome(spark: SparkSession, d: str):
    remote = _hashed(spark, d)
    stored = remote.where(F.col("magic_id") % 2 == 0)
    return recognise(_scans(spark, d), _dictionary(spark, d), _printings(spark, d), stored, remote, _collection(spark, d))


@registered(f"WITH {ROUTED_SQL} SELECT scan_id, name, sets, target FROM routed")
def route_scans(spark: SparkSession, d: str) -> DataFrame:
    return _outcome(spark, d).routed.select("scan_id", "name", F.array_join("sets", ",").alias("sets"), "target")


@registered(f"WITH {ROUTED_SQL} SELECT r.scan_id, r.name, r.sets AS possible_sets, s.text FROM routed r JOIN scans s ON r.scan_id = s.scan_id WHERE target = 'attention'")
def attention_rows(spark: SparkSession, d: str) -> DataFrame:
    return _outcome(spark, d).attention.select("scan_id", "name", "possible_sets", "text")


@registered(
    f"""WITH {ROUTED_SQL}, one AS (SELECT scan_id, name, nullif(split_part(sets, ',', 1), '') AS set_name FROM routed WHERE target = 'collection'),
detail AS (SELECT name, min(magic_id) AS magic_id, arg_min(usd, magic_id) AS usd FROM printings GROUP BY name)
SELECT scan_id, o.name, o.set_name, coalesce(quantity, 0) AS quantity, d.magic_id, CAST(round(usd * coalesce(quantity, 0), 4) AS DECIMAL(18,4)) AS est_value
FROM one o LEFT JOIN collection c ON o.name = c.name AND o.set_name = c.set_name LEFT JOIN detail d ON o.name = d.name"""
)
def collection_rows(spark: SparkSession, d: str) -> DataFrame:
    return _outcome(spark, d).collection.select("scan_id", "name", "set_name", "quantity", "magic_id", "est_value")


@registered(f"WITH {POLICY_SQL} SELECT s.scan_id, s.text, 'No matches found' AS error FROM scans s WHERE s.scan_id NOT IN (SELECT scan_id FROM policy)")
def unmatched_scans(spark: SparkSession, d: str) -> DataFrame:
    return routing.unmatched(_scans(spark, d).select("scan_id", "text"), _matches(spark, d))


@registered(f"WITH {PRINTINGS_SQL}, {COLLECTION_SQL} SELECT p.name, p.set_name, coalesce(quantity, 0) AS quantity FROM printings p LEFT JOIN collection c ON p.name = c.name AND p.set_name = c.set_name")
def quantity_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    return routing.quantity_of(_printings(spark, d).select("name", "set_name"), _collection(spark, d))


@registered("SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18,4)) * p_size, 4) AS DECIMAL(18,4)) AS est_value FROM part")
def est_value(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", routing.est_value(F.col("p_retailprice").cast("string"), F.col("p_size")).alias("est_value"))


@registered(
    f"""WITH {COLLECTION_SQL}, new AS (SELECT p_name AS name, p_brand AS set_name, count(*) AS n FROM part WHERE p_type = 'PROMO' GROUP BY 1, 2)
SELECT coalesce(c.name, n.name) AS name, coalesce(c.set_name, n.set_name) AS set_name, coalesce(quantity, 0) + coalesce(n, 0) AS quantity
FROM collection c FULL JOIN new n ON c.name = n.name AND c.set_name = n.set_name"""
)
def collection_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = _part(spark, d).where(F.col("p_type") == "PROMO").select(F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"))
    return routing.collection_upsert(_collection(spark, d), new)


@registered(
    """WITH target AS (SELECT DISTINCT p_name AS name, p_brand AS set_name FROM part WHERE p_type <> 'PROMO')
SELECT DISTINCT p_name AS name, p_brand AS set_name FROM part WHERE p_type = 'PROMO' AND (p_name, p_brand) NOT IN (SELECT (name, set_name) FROM target)"""
)
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d).select(F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"), "p_type")
    new = p.where(F.col("p_type") == "PROMO").select("name", "set_name")
    return routing.insert_if_absent(p.where(F.col("p_type") != "PROMO"), new, ["name", "set_name"])


def _keyed(spark: SparkSession, columns: str) -> str:
    """A keyed table of its own in the shared folder."""
    path = new_path(spark)
    name = "keyed_" + path.rsplit("/", 1)[1]
    keyed.create_keyed(spark, name, columns, 8, path)
    return name


@registered(SQL["collection_upsert"])
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The collection as a keyed table, and a batch of new cards that is given twice."""
    name = _keyed(spark, "name string, set_name string, quantity bigint, batches array<string>")
    new = _part(spark, d).where(F.col("p_type") == "PROMO").select(F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"), F.lit(1).alias("quantity"))
    for batch, rows in (("have", _collection(spark, d)), ("new", new), ("new", new)):
        keyed.upsert(spark, name, rows, ["name", "set_name"], batch)
    return spark.table(name).select("name", "set_name", "quantity")


@registered("SELECT DISTINCT p_name AS name, p_brand AS set_name, CASE WHEN count(CASE WHEN p_type <> 'PROMO' THEN 1 END) > 0 THEN 0 ELSE 1 END AS batch FROM part GROUP BY 1, 2")
def keyed_insert(spark: SparkSession, d: str) -> DataFrame:
    """Two inserts into a keyed table, the second with keys that are there and keys that are not."""
    name = _keyed(spark, "name string, set_name string, batch int")
    p = _part(spark, d).select(F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"), F.when(F.col("p_type") == "PROMO", 1).otherwise(0).alias("batch"))
    for batch in (0, 1):
        keyed.insert_absent(spark, name, p.where(F.col("batch") == batch), ["name", "set_name"])
    return spark.table(name).select("name", "set_name", "batch")


@registered("SELECT p_brand AS set_name, count(1) AS cards_in_set, row_number() OVER (ORDER BY count(1) DESC, p_brand DESC) AS place FROM part GROUP BY p_brand")
def cards_by_set(spark: SparkSession, d: str) -> DataFrame:
    """The report with the places in which it lists its sets, a row for each set."""
    listed = by_set(_part(spark, d).select(F.col("p_brand").alias("set_name")))
    place = F.row_number().over(Window.orderBy(F.desc("cards_in_set"), F.desc("set_name")))  # a row per set
    return listed.withColumn("place", place.cast("long"))


@registered(f"SELECT name, n AS place FROM (SELECT name, row_number() OVER (ORDER BY name) - 1 AS n FROM ({NAMES_SQL})) WHERE n >= 10 AND n < 40")
def dictionary_slice(spark: SparkSession, d: str) -> DataFrame:
    return slice_of(_dictionary(spark, d), 10, 40).select("name", F.col("place").cast("long").alias("place"))


@registered(
    """WITH names AS (SELECT name FROM (SELECT min(p_name) AS name, row_number() OVER (ORDER BY min(p_name)) - 1 AS n FROM part GROUP BY lower(p_name)) WHERE n >= 10 AND n < 40),
hashed AS (SELECT DISTINCT p_name AS name, p_brand AS set_name, sha256(p_name || p_brand) AS card_hash, p_type = 'PROMO' AS is_promo FROM part WHERE p_size % 3 <> 0 AND p_name IN (SELECT name FROM names)),
stored AS (SELECT DISTINCT p_name AS name, p_brand AS set_name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 50)
SELECT name, set_name, card_hash, is_promo FROM hashed h WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.name = h.name AND s.set_name = h.set_name)"""
)
def backfill_hashes(spark: SparkSession, d: str) -> DataFrame:
    """A slice of the names through the whole back-fill; a third of the printings has no .jpg image."""
    p = _part(spark, d)
    ending = F.when(F.col("p_size") % 3 != 0, ".jpg?1").otherwise(".png?1")
    printings = p.select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"), F.lit(False).alias("is_foil"), (F.col("p_type") == "PROMO").alias("is_promo"),
        F.concat(F.lit("http://images/"), F.col("p_partkey").cast("string"), ending).alias("image_url"), F.col("p_partkey").alias("key"),
        F.sha2(F.concat("p_name", "p_brand"), 256).alias("hash"),
    )
    sold = table(spark, d, "lineitem").where(F.col("l_quantity") >= 50).select(F.col("l_partkey").alias("key")).distinct()
    pairs = printings.join(sold, "key", "left_semi").select("name", "set_name").distinct()
    stored = printings.join(pairs, ["name", "set_name"], "left_semi").select("name", "set_name", F.col("hash").alias("card_hash"), "is_foil", "is_promo")
    names = slice_of(fuzzy.dictionary_of(p, "p_name"), 10, 40)
    new = backfill(names, printings.drop("hash", "key"), printings.select("image_url", "hash"), stored)
    return new.select("name", "set_name", "card_hash", "is_promo")


@registered("SELECT DISTINCT p_name AS name, p_brand AS set_name, sha256('http://images/' || p_brand || '/' || p_name || '.jpg') AS card_hash FROM part WHERE p_size <> 3")
def backfill_run(spark: SparkSession, d: str) -> DataFrame:
    """A back-fill in slices that stops after one, is run again and goes on, over images that a third run finds stored."""
    p = _part(spark, d).where(F.col("p_size") != 3)
    url = F.concat(F.lit("http://images/"), "p_brand", F.lit("/"), "p_name", F.lit(".jpg"))
    printings = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"), F.lit(False).alias("is_foil"), F.lit(False).alias("is_promo"), url.alias("image_url")).distinct()
    table_ = _keyed(spark, TABLES["card_hashes"])
    names, ledger = fuzzy.dictionary_of(p, "p_name"), Ledger(spark, new_path(spark))
    digest = lambda urls: urls.select("image_url", F.sha2("image_url", 256).alias("hash"))
    none = lambda urls: digest(urls).withColumn("hash", F.when(F.lit(True), F.raise_error(F.lit("hashed twice"))).otherwise(F.col("hash")))
    run_backfill(names, printings, digest, table_, ledger, 40, 1)
    run_backfill(names, printings, digest, table_, ledger, 40)
    run_backfill(names, printings, none, table_, Ledger(spark, new_path(spark)), 40)
    return spark.table(table_).select("name", "set_name", "card_hash")


@registered("SELECT p_partkey, p_size % 5 = 0 OR p_size % 7 = 0 AS rejected, CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN p_brand END AS set_name FROM part")
def checked_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards as JSON text, some cut short, some no JSON at all: what parses and what is rejected."""
    card = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("set_name"), F.struct(F.lit("1").alias("usd")).alias("prices")))
    broken = F.when(F.col("p_size") % 5 == 0, F.expr("substring(j, 1, length(j) - 4)")).when(F.col("p_size") % 7 == 0, F.lit("<html>")).otherwise(F.col("j"))
    rows = _part(spark, d).select("p_partkey", "p_size", card.alias("j")).withColumn("j", broken)
    good, bad = readers.parse_checked(rows, "j")
    good = good.select(F.col("name").cast("long").alias("p_partkey"), F.lit(False).alias("rejected"), "set_name")
    return good.unionByName(bad.select("p_partkey", F.lit(True).alias("rejected"), F.lit(None).cast("string").alias("set_name")))


# --- types --------------------------------------------------------------------------------


def _values(words: list[str]) -> str:
    return "SELECT name FROM (VALUES " + ", ".join(f"('{w}')" for w in words) + ") v(name)"


TYPE_TEXT_SQL = "type_texts AS (SELECT p_partkey AS id, p_type || ' ' || p_name AS text FROM part)"
TOKENS_SQL = f"{TYPE_TEXT_SQL}, tokens AS (SELECT id, unnest(string_split(text, ' ')) AS token, unnest(range(0, CAST(len(string_split(text, ' ')) AS BIGINT))) AS pos FROM type_texts)"


def _hits_sql(words: list[str], out: str) -> str:
    found = _lookup_sql("SELECT DISTINCT token AS text FROM tokens", _values(words)) + f", named AS (SELECT id, pos, name, score, rank FROM tokens JOIN found ON token = text)"
    return f"{out} AS (WITH {found} SELECT * FROM named)"


BASE_SQL = f"{TOKENS_SQL}, {_hits_sql(types.BASE_TYPES, 'base_hits')}, base AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos, rank) AS n, name, score FROM base_hits)"
CREATURE_SQL = f"{_hits_sql(CREATURES, 'creature_hits')}, creature AS (SELECT id, arg_min(score, pos) AS score FROM creature_hits WHERE rank = 1 GROUP BY id)"


def _type_texts(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("text"))


def _vocabulary(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "name string")


@registered(f"WITH {BASE_SQL} SELECT id, n, name, round(score, 6) AS score FROM base")
def type_base_match(spark: SparkSession, d: str) -> DataFrame:
    out = types.base_types(_type_texts(spark, d), _vocabulary(spark, types.BASE_TYPES))
    return out.select("id", F.col("n").cast("long").alias("n"), "name", F.round("score", 6).alias("score"))


@registered(f"WITH {TOKENS_SQL}, {CREATURE_SQL} SELECT id, round(score, 6) AS score FROM creature")
def type_creature_first_hit(spark: SparkSession, d: str) -> DataFrame:
    return types.creature_first_hit(_type_texts(spark, d), _vocabulary(spark, CREATURES)).select("id", F.round("score", 6).alias("score"))


@registered(
    f"""WITH {BASE_SQL}, {CREATURE_SQL},
b AS (SELECT id, arg_min(CASE WHEN name = 'Creature' AND score >= 0.5 THEN score END, CASE WHEN name = 'Creature' AND score >= 0.5 THEN n END) AS sure, arg_min(name, n) AS first, arg_min(score, n) AS first_score FROM base GROUP BY id),
c AS (SELECT id, score FROM creature WHERE score >= 0.5),
j AS (SELECT coalesce(b.id, c.id) AS id, coalesce(sure, c.score) AS cs, CASE WHEN first_score >= 0.15 THEN first END AS first, CASE WHEN first_score >= 0.15 THEN first_score END AS first_score FROM b FULL JOIN c ON b.id = c.id)
SELECT id, CASE WHEN cs IS NOT NULL THEN 'Creature' ELSE first END AS type, round(coalesce(cs, first_score), 6) AS score FROM j WHERE cs IS NOT NULL OR first IS NOT NULL"""
)
def type_match(spark: SparkSession, d: str) -> DataFrame:
    out = types.match_type(_type_texts(spark, d), _vocabulary(spark, types.BASE_TYPES), _vocabulary(spark, CREATURES))
    return out.select("id", "type", F.round("score", 6).alias("score"))


# --- scalars ------------------------------------------------------------------------------


@registered("SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') AS clean, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS spaced FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.clean_text(t).alias("clean"), text.clean_text(t, True).alias("spaced"))


@registered(r"SELECT doc_id, regexp_matches(text, '\s') AS spaced, len(string_split(text, ' ')) AS n_tokens, string_split(text, ' ')[1] AS first FROM documents")
def token_split(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.space_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.has_space(F.col("text")).alias("spaced"), F.size(tokens).cast("long").alias("n_tokens"), F.get(tokens, F.lit(0)).alias("first"))


_EXT_SQL = "string_split(split_part(url, '?', 1), '.')[-1]"


@registered(f"SELECT page_id, split_part(url, '?', 1) AS bare, {_EXT_SQL} AS ext, {_EXT_SQL} = 'html' AS is_html FROM pages")
def url_strip_ext(spark: SparkSession, d: str) -> DataFrame:
    ext = text.extension(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.without_query(F.col("url")).alias("bare"), ext.alias("ext"), (ext == "html").alias("is_html"))


@registered(
    """SELECT p_partkey, replace(p_name, ' ', '%20') AS escaped,
replace(replace(replace('http://x/' || p_name || '?a=' || p_brand || '&b=(é"~)', ' ', '%20'), 'é', '%C3%A9'), '"', '%22') AS uri FROM part"""
)
def url_space_escape(spark: SparkSession, d: str) -> DataFrame:
    uri = F.concat(F.lit("http://x/"), "p_name", F.lit("?a="), "p_brand", F.lit('&b=(é"~)'))
    return _part(spark, d).select("p_partkey", text.escape_spaces(F.col("p_name")).alias("escaped"), text.encode_uri(uri).alias("uri"))


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props = '{}' AS is_empty FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), text.is_empty_json(F.col("props")).alias("is_empty"))


@registered("SELECT item_id, base64(encode(text)) AS image FROM benchmark")
def base64_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.base64_text(F.encode("text", "UTF-8")).alias("image"))


def _box_sql(region: str) -> str:
    w, h, top = REGIONS[region]
    at = lambda size, share: f"CAST(round({size} * CAST({share} AS DOUBLE)) AS INTEGER)"
    return f"SELECT p_partkey, '{region}' AS region, {at('w', w)} AS width, {at('h', h)} AS height, {at('w', LEFT)} AS \"left\", {at('h', top)} AS top FROM sized WHERE w >= {MIN_WIDTH} AND h >= {MIN_HEIGHT}"


@registered("WITH sized AS (SELECT p_partkey, 350 + p_size * 7 AS w, 490 + p_size * 11 AS h FROM part) " + " UNION ALL ".join(_box_sql(r) for r in REGIONS))
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    sized = _part(spark, d).select("p_partkey", (350 + F.col("p_size") * 7).alias("w"), (490 + F.col("p_size") * 11).alias("h"))
    each = sized.where(large_enough(F.col("w"), F.col("h"))).withColumn("region", F.explode(F.array(*[F.lit(r) for r in REGIONS])))
    return each.select("p_partkey", "region", crop_box(F.col("w"), F.col("h"), F.col("region")).alias("b")).select("p_partkey", "region", "b.*")


# --- validation ---------------------------------------------------------------------------


def _rules() -> list[validation.Rule]:
    return [validation.text_rule("name", 3, 10), validation.number_rule("size", 5), validation.number_rule("price", 905)]


_CHECKS = {"name must have 3..10 characters": "length(p_name) BETWEEN 3 AND 10", "size must be at least 5": "p_size >= 5", "price must be at least 905": "p_retailprice >= 905"}


def _checked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _part(spark, d).select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return validation.split_valid(p, _rules())


@registered(f"SELECT p_partkey FROM part WHERE {' AND '.join(_CHECKS.values())}")
def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d)[0].select("p_partkey")


@registered(
    "SELECT p_partkey, violations FROM (SELECT p_partkey, concat_ws('; ', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{m}' END" for m, c in _CHECKS.items()) + ") AS violations FROM part) WHERE violations <> ''"
)
def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d)[1].select("p_partkey", F.array_join("violations", "; ").alias("violations"))


# --- images: pixels derived from embeddings ------------------------------------------------


def _pixel(x):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(128 + x * 400))).cast("int")


def _images(spark: SparkSession, d: str, across: int = 1, down: int = 1) -> DataFrame:
    """Grey images of 8 x 8 cells, one per embedding value, of across x down pixels each."""
    e = table(spark, d, "embeddings")
    digit = lambda x: F.repeat(F.lpad(F.hex(_pixel(x).cast("long")), 2, "0"), across)
    rows = lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.repeat(F.array_join(F.slice(v, y * 8 + 1, F.lit(8)), ""), down))
    data = F.unhex(F.array_join(text.let(F.transform("embedding", digit), rows), ""))
    return e.select(F.col("vec_id").alias("id"), F.lit(8 * across).alias("width"), F.lit(8 * down).alias("height"), F.lit(1).alias("channels"), data.alias("data"))


@registered(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: 3 * greatest(0, least(255, round(128 + CAST(x AS DOUBLE) * 400)))) AS p FROM embeddings),
bands AS (SELECT vec_id, unnest(range(0, 4)) AS band, p FROM v),
cells AS (SELECT vec_id, band, p[band * 16 + 1 : band * 16 + 16] AS c FROM bands),
bits AS (SELECT vec_id, band, list_transform(c, lambda x: CASE WHEN x > list_median(c) OR (abs(x - list_median(c)) < 1 AND list_median(c) > 384) THEN 1 ELSE 0 END) AS b FROM cells),
digits AS (SELECT vec_id, band, array_to_string(list_transform(range(0, 4), lambda i: lower(to_hex(8 * b[i * 4 + 1] + 4 * b[i * 4 + 2] + 2 * b[i * 4 + 3] + b[i * 4 + 4]))), '') AS h FROM bits)
SELECT vec_id AS id, string_agg(h, '' ORDER BY band) AS hash FROM digits GROUP BY vec_id""".replace("list_median(", "list_aggregate(").replace("list_aggregate(c)", "list_aggregate(c, 'median')")
)
def image_hash(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.imaging import hash_images

    return hash_images(_images(spark, d), 8)


def _snippet_sql() -> str:
    """Regions of the images above, without pixels: columns and rows with equal surroundings form stretches.

    A pixel of the result depends on the cells of its neighbours' neighbours, edges repeated: three times three on either axis.
    """
    boxes = {r: [int(size * share + 0.5) for size, share in ((360, LEFT), (504, top), (360, w), (504, h))] for r, (w, h, top) in REGIONS.items()}
    near = lambda at, size, cell, start: "[" + ", ".join(
        f"({start} + greatest(0, least({size} - 1, greatest(0, least({size} - 1, {at} + {a})) + {b}))) // {cell}" for a in (-1, 0, 1) for b in (-1, 0, 1)
    ) + "]"
    stretches = lambda size, start, cell: f"SELECT region, s, min(k) AS k, count(*) AS n FROM (SELECT region, k, {near('k', size, cell, start)} AS s FROM (SELECT *, unnest(range({size})) AS k FROM boxes)) GROUP BY region, s"
    mean = lambda terms: f"((({' + '.join(terms)}) * 57) >> 9)"
    blurred = mean([
        mean([f"p[y.s[{3 * ay + by + 1}] * 8 + x.s[{3 * ax + bx + 1}] + 1]" for by in range(3) for bx in range(3)])
        for ay in range(3) for ax in range(3)
    ])
    return f"""WITH boxes(region, l, t, w, h) AS (VALUES {", ".join(f"('{r}', {', '.join(map(str, b))})" for r, b in boxes.items())}),
xs AS ({stretches("w", "l", 45)}), ys AS ({stretches("h", "t", 63)}),
pixels AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, round(128 + CAST(x AS DOUBLE) * 400)))) AS v FROM embeddings),
contrast AS (SELECT vec_id, list_transform(v, lambda x: greatest(0, least(255, floor((CAST(1.73 AS DOUBLE) / (1 - CAST(0.73 AS DOUBLE))) * (x - 127) + 127)))) AS c FROM pixels),
bright AS (SELECT vec_id, list_transform(c, lambda x: CAST(trunc(x + (255 - x) * CAST(0.235 AS DOUBLE)) AS INTEGER)) AS p FROM contrast),
runs AS (SELECT vec_id, region, y.k AS y, y.n AS tall, x.k AS x, repeat(lower(printf('%02x', {blurred})), x.n) AS hex FROM bright, xs AS x JOIN ys AS y USING (region)),
lines AS (SELECT vec_id, region, y, repeat(string_agg(hex, '' ORDER BY x), any_value(tall)) AS hex FROM runs GROUP BY vec_id, region, y)
SELECT vec_id AS id, region, CAST(any_value(w) AS INTEGER) AS width, CAST(any_value(h) AS INTEGER) AS height, sha256(unhex(string_agg(hex, '' ORDER BY y))) AS sha256
FROM lines JOIN boxes USING (region) GROUP BY vec_id, region"""


@registered(_snippet_sql())
def image_snippets(spark: SparkSession, d: str) -> DataFrame:
    """All four regions of images of 360 x 504 pixels, with a digest of their bytes."""
    from ..operators.imaging import snippets

    return snippets(_images(spark, d, 45, 63)).select("id", "region", "width", "height", F.sha2(F.col("data"), 256).alias("sha256"))
