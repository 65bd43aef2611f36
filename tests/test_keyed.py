from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenmatch import schemas
from lumenmatch.sources import audit, keyed

COLUMNS = "id bigint, name string, part int, quantity bigint, note string, batches array<string>"


@pytest.fixture
def table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lumen_keyed")
    keyed.create_keyed(spark, "lumen_keyed.t", COLUMNS, 8)
    yield "lumen_keyed.t"
    spark.sql("DROP DATABASE lumen_keyed CASCADE")


def files(spark, table):
    return {f: Path(f.removeprefix("file:")).stat().st_mtime_ns for f in spark.table(table).inputFiles()} if spark.table(table).count() else {}


def rows(spark, values):
    return spark.createDataFrame(values, "name string, part int, quantity bigint, note string")


def test_inserts_read_only_buckets_that_may_hold_a_key(spark, table):
    many = spark.range(500).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") % 3).cast("int").alias("part"), F.lit(1).alias("quantity"))
    assert keyed.insert_absent(spark, table, many, ["name", "part"]).count() == 500
    assert keyed.insert_absent(spark, table, many, ["name", "part"]).count() == 0
    assert spark.table(table).count() == 500 and spark.table(table).select("bucket").distinct().count() == 8
    before = files(spark, table)
    odd = rows(spark, [(None, 1, 5, "a"), (None, 1, 5, "a"), ("n1", None, 1, "b"), ("n1", 1, 1, "c"), ("new", 2, 1, "d")])
    assert sorted(r.note for r in keyed.insert_absent(spark, table, odd, ["name", "part"]).collect()) == ["a", "b", "d"]
    assert keyed.insert_absent(spark, table, odd, ["name", "part"]).count() == 0
    assert spark.table(table).count() == 503
    after = files(spark, table)
    assert all(after[f] == t for f, t in before.items()) and 1 <= len(set(after) - set(before)) <= 3
    # keys that no filter knows need no read of the table at all
    fresh = rows(spark, [(f"other{k}", k, 1, "x") for k in range(3)])
    plan = keyed.absent_rows(spark, table, fresh, ["name", "part"])
    assert plan.count() == 3


def test_filters_know_all_keys_and_grow(spark, table):
    for k in range(4):
        part = spark.range(k * 400, k * 400 + 400).select(F.col("id").cast("string").alias("name"), F.lit(k).alias("part"), F.lit(1).alias("quantity"))
        keyed.insert_absent(spark, table, part, ["name", "part"])
    found = {r.bucket: r for r in spark.table(f"{table}_keys").collect()}
    counts = {r.bucket: r["n"] for r in spark.table(table).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert {b: r.n for b, r in found.items()} == counts and all(8 * len(r.bits) >= 12 * r.n for r in found.values())
    again = spark.table(table).select("name", "part", "quantity")
    assert keyed.absent_rows(spark, table, again, ["name", "part"]).count() == 0
    unknown = spark.range(5000, 15000).select(F.col("id").cast("string").alias("name"), F.lit(1).alias("part"), keyed.bucket(["name", "part"], 8).alias("bucket"))
    asked = unknown.select("bucket", keyed._key_hash(["name", "part"]).alias("h"))
    maybe = asked.groupBy("bucket").cogroup(keyed._filters(spark, table).groupBy("bucket")).applyInArrow(keyed._known, "bucket int, h long")
    assert maybe.count() < 500


def test_a_batch_twice_has_one_effect_and_other_buckets_keep_their_files(spark, table):
    first = rows(spark, [(f"n{k}", k, 2, f"x{k}") for k in range(40)] + [("n1", 1, 3, None), (None, None, 1, "null")])
    assert keyed.upsert(spark, table, first, ["name", "part"], "b1").count() == 41
    one = lambda name: spark.table(table).where(F.col("name") == name).select("quantity", "note", "batches").first()
    assert tuple(one("n1")) == (5, "x1", ["b1"])
    before = files(spark, table)
    assert keyed.upsert(spark, table, first, ["name", "part"], "b1").count() == 0
    assert files(spark, table) == before
    second = rows(spark, [("n1", 1, 10, "y"), ("n1", 2, 1, "z"), (None, None, 4, None)])
    assert keyed.upsert(spark, table, second, ["name", "part"], "b2").count() == 3
    assert keyed.upsert(spark, table, second, ["name", "part"], "b2").count() == 0
    assert tuple(spark.table(table).where("name = 'n1' and part = 1").select("quantity", "note", "batches").first()) == (15, "y", ["b1", "b2"])
    assert tuple(spark.table(table).where("name is null").select("quantity", "note").first()) == (5, "null")
    assert spark.table(table).count() == 42
    touched = {r.bucket for r in second.select(keyed.bucket(["name", "part"], 8).alias("bucket")).distinct().collect()}
    after = files(spark, table)
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and all(after.get(f) == before[f] for f in kept)


def test_a_batch_broken_off_between_buckets_goes_on(spark, table):
    first = rows(spark, [(f"n{k}", k, 2, "x") for k in range(40)])
    half = keyed.upserted_rows(spark, table, first, ["name", "part"], "b1")
    keyed._replace(spark, half.where("bucket < 4"), table)
    assert 0 < spark.table(table).count() < 40
    keyed.upsert(spark, table, first, ["name", "part"], "b1")
    assert sorted((r.name, r.quantity) for r in spark.table(table).collect()) == sorted((f"n{k}", 2) for k in range(40))


def test_failing_and_successful_writes_are_logged(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lumen_audit")
    schemas.create_tables(spark, "lumen_audit", 4)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    good = audit.logged(spark, "lumen_audit", df, lambda d: d.write.format("noop").mode("overwrite").save(), "card_hashes", "insert", ["name"])
    assert (good.done, good.rows, good.error) == (True, 2, None)

    def fails(d):
        d.select(F.raise_error(F.lit("no space left"))).write.format("noop").mode("overwrite").save()

    bad = audit.logged(spark, "lumen_audit", df, fails, "card_hashes", "insert", ["name"])
    assert (bad.done, bad.rows) == (False, 0) and bad.error
    log = spark.table("lumen_audit.transactions").groupBy("is_successful", "table_name", "transaction_type").count().collect()
    assert sorted(map(tuple, log)) == [(False, "card_hashes", "insert", 2), (True, "card_hashes", "insert", 2)]
    spark.sql("DROP DATABASE lumen_audit CASCADE")


def test_command_line_writes_each_row_once(spark, tmp_path):
    from lumenmatch.__main__ import main

    digest = "ab" * 32
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
    hashes = "name string, set_name string, card_hash string, is_foil boolean, is_promo boolean"
    save("scans", [(1, "Darkness", digest), (2, "Darkness", digest), (3, "qqqq", digest), (4, "AdantoVanguard", digest)], "scan_id long, text string, hash string")
    save("dictionary", [("Darkness",), ("Adanto Vanguard",), ("Adanto Vanguards",)], "name string")
    save("printings", [("Darkness", "A", 1, "0.05"), ("Darkness", "B", 2, "1"), ("Adanto Vanguard", "C", 3, "2")], "name string, set_name string, magic_id int, usd string")
    save("hashes", [("Darkness", "A", digest, False, False)], hashes)
    save("remote", [("Darkness", "A", digest, False, False), ("Darkness", "B", digest[::-1], True, False), ("Else", "A", digest, False, False)], hashes)
    save("collection", [("Darkness", "A", 2)], "name string, set_name string, quantity int")
    args = [str(tmp_path / x) for x in ("scans", "dictionary", "printings", "hashes", "collection", "out")]
    args += ["--write", "--remote", str(tmp_path / "remote"), "--database", "lumen_cli"]
    for _ in range(2):
        assert main(args) == 0
    t = lambda name: spark.table(f"lumen_cli.{name}")
    assert [(r.card_name, r.card_set, r.quantity, r.automated) for r in t("card_catalog").collect()] == [("Darkness", "A", 2, True)]
    assert sorted((r.card_name, r.possible_sets) for r in t("card_need_attn").collect()) == [("Adanto Vanguard", "C"), ("Adanto Vanguards", "")]
    assert [(r.set_name, r.is_foil) for r in t("card_hashes").collect()] == [("B", True)]
    log = sorted(map(tuple, t("transactions").groupBy("table_name", "transaction_type", "is_successful").count().collect()))
    assert log == [("card_catalog", "upsert", True, 1), ("card_hashes", "insert", True, 1), ("card_need_attn", "insert", True, 2)]
    assert main([*args, "--batch", "again"]) == 0
    assert t("card_catalog").first().quantity == 4 and t("card_need_attn").count() == 2
    spark.sql("DROP DATABASE lumen_cli CASCADE")


def test_a_stream_run_again_adds_its_cards_once(spark, tmp_path):
    from lumenmatch.streaming import stream_into

    digest, schema = "ab" * 32, "scan_id long, text string, hash string"
    spark.sql("CREATE DATABASE IF NOT EXISTS lumen_stream")
    schemas.create_tables(spark, "lumen_stream", 4)
    names = spark.createDataFrame([("Darkness",)], "name string")
    printings = spark.createDataFrame([("Darkness", "A", 1, "0.05")], "name string, set_name string, magic_id int, usd string")
    hashes = spark.createDataFrame([("Darkness", "A", digest)], "name string, set_name string, card_hash string")
    have = spark.createDataFrame([("Darkness", "A", 2)], "name string, set_name string, quantity int")
    spark.createDataFrame([(1, "Darkness", digest), (2, "qqqq", digest), (3, "darkness", digest)], schema).coalesce(1).write.parquet(str(tmp_path / "scans"))
    for k in range(2):  # a lost checkpoint gives all batches again
        q = stream_into(spark, str(tmp_path / "scans"), schema, str(tmp_path / f"cp{k}"), "lumen_stream", "s", names, printings, hashes, hashes, have)
        q.awaitTermination(120)
        assert q.exception() is None
    assert [(r.card_name, r.quantity, r.batches) for r in spark.table("lumen_stream.card_catalog").collect()] == [("Darkness", 2, ["s-0"])]
    spark.sql("DROP DATABASE lumen_stream CASCADE")
