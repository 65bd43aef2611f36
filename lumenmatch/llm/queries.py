"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, jaccard, language, licenses, packing, quality_classifier, quality_rules, repeats, runs, secrets, simhash, url_filter
from .common import LOWER, NOT_WORD_RUN, UPPER, table

Query = Callable[[SparkSession, str], DataFrame]


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_vocabulary())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"))
    found = language.identify(docs, language.profiles(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in secrets.KINDS])
    order = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("kind"), s["end"].alias("end"))))
    shown = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"].cast("int")), s["start"], s["end"])
    base = F.filter(order, lambda s: s["kind"] <= 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(order, shown), ",").alias("spans"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    lengths = F.zip_with("starts", "ends", lambda a, b: b - a)
    return out.select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), "kept_sha256",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good")
    labels = table(spark, sf_dir, "labels").select("doc_id", good)
    return quality_classifier.classify(docs, quality_classifier.train(docs, labels))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.component_ids(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = runs.find_runs(docs.select("doc_id", runs.with_planted_runs(F.col("text"), F.col("doc_id")).alias("text")))
    ahead = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    order = lambda x, y: F.when(ahead(x, y) > 0, -1).when(ahead(x, y) < 0, 1).when((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"])), -1).otherwise(1)
    best = F.get(F.array_sort("runs", order), F.lit(0))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_license_scan, op3_url_filter, op4_language_id, op5_jaccard_join, op6_secret_scan, op7_decontaminate, op8_suffix_dedup, op9_quality_rules, op10_quality_classifier, op11_simhash_near_dedup, op12_periodic_runs, op13_centroid_clustering)}


_LOWERED = f"translate({{}}, '{UPPER}', '{LOWER}')"
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}', '{h}{p}')" for h, p, v in URL_RULES)

OP3_SQL = f"""
WITH rules(h, p, v, rule) AS (VALUES {_RULES_SQL}),
rest AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS k FROM pages),
parts AS (SELECT page_id,
  CASE WHEN k > 0 THEN {_LOWERED.format("regexp_extract(substr(url, k + 3), '^([^/?#]*)', 1)")} ELSE '' END AS host,
  CASE WHEN k > 0 THEN regexp_extract(substr(url, k + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM rest),
fits AS (SELECT page_id, host, path, rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, length(h) DESC, rule) AS n
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE n = 1
"""

_WORDS_SQL = "list_filter(regexp_split_to_array({}, '{}'), lambda x: x <> '')".format(_LOWERED.format("coalesce(text, '')"), NOT_WORD_RUN)

OP7_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT item, w, least(len(w), {decontaminate.WIDTH}) AS n FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k + 1 : k + n], ' ') AS x FROM (SELECT item, w, n, unnest(range(0, CAST(len(w) - n + 1 AS BIGINT))) AS k FROM iw)),
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
starts AS (SELECT doc_id, w, n, unnest(range(0, CAST(len(w) - n + 1 AS BIGINT))) AS k FROM d JOIN (SELECT DISTINCT n FROM windows) ON len(w) >= n),
hits AS (SELECT doc_id, k, s.n, item FROM starts s JOIN windows v ON s.n = v.n AND array_to_string(w[k + 1 : k + s.n], ' ') = x),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express whole."""
    return {"op2_license_scan": licenses.scan_sql(), "op3_url_filter": OP3_SQL, "op7_decontaminate": OP7_SQL, "op9_quality_rules": quality_rules.judge_sql(), "op13_centroid_clustering": centroids.cluster_sql()}
