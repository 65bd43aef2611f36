import pytest

from lumenmatch import schemas
from lumenmatch.operators import types
from lumenmatch.sources import readers, writers
from lumenmatch.streaming import stream_scans


def test_tables_insert_once_and_truncate(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS lumen_test")
    schemas.create_tables(spark, "lumen_test")
    rows = spark.createDataFrame([("a", "s", "h1", False, False), ("a", "s", "h1", False, False)], "name string, set_name string, card_hash string, is_foil boolean, is_promo boolean")
    writers.insert_rows(spark, "card_hashes", rows, "lumen_test")
    writers.insert_rows(spark, "card_hashes", rows, "lumen_test")
    assert spark.table("lumen_test.card_hashes").count() == 1
    odd = spark.createDataFrame([("b", None, "h1", None, False)], rows.schema)
    writers.insert_rows(spark, "card_hashes", odd, "lumen_test")
    writers.insert_rows(spark, "card_hashes", odd, "lumen_test")
    assert spark.table("lumen_test.card_hashes").count() == 2  # a null key is a key
    seen = spark.createDataFrame([("a", "read", "img"), ("a", "read", "img"), ("a", "read", "other"), (None, "read", "img")], "card_name string, extracted_text string, name_image string")
    for _ in range(2):
        writers.insert_rows(spark, "card_need_attn", seen, "lumen_test")
    found = spark.table("lumen_test.card_need_attn").collect()
    assert sorted((r.card_name or "", r.name_image) for r in found) == [("", "img"), ("a", "img"), ("a", "other")]
    assert all(r.created_at and r.created_by and r.item_id is not None for r in found)
    other = {"card_catalog": "card_name string, card_set string", "image_results": "name string, set_name string", "transactions": "transaction_type string, pk long"}
    for table, schema in other.items():
        writers.insert_rows(spark, table, spark.createDataFrame([("x", 5 if table == "transactions" else "y")], schema), "lumen_test")
        assert spark.table(f"lumen_test.{table}").count() == 1
    schemas.truncate_tables(spark, "lumen_test")
    assert spark.table("lumen_test.card_hashes").count() == 2
    assert [spark.table(f"lumen_test.{t}").count() for t in schemas.TABLES if t != "card_hashes"] == [0] * 4
    spark.sql("DROP DATABASE lumen_test CASCADE")


def test_stored_rows_by_name_and_set(spark):
    hashes = spark.createDataFrame([("a", "h1", "s", False, True, 1), ("b", "h2", "s", False, False, 2), (None, "h3", "s", False, False, 3)], "name string, card_hash string, set_name string, is_foil boolean, is_promo boolean, id int")
    got = readers.hashes_by_name(hashes, spark.createDataFrame([("a",), ("a",), (None,)], "name string"))
    assert [tuple(r) for r in got.collect()] == [("a", "h1", "s", False, True)]
    results = spark.createDataFrame([("a", "s", "x", "y", "1", "2", 0.5, 0.7), ("a", "t", "x", "y", "1", "2", 0.5, 0.7)], "name string, set_name string, art_image string, flavor_image string, art_image_hash string, flavor_image_hash string, art_match_percent double, flavor_match_percent double")
    assert [tuple(r) for r in readers.image_results(results, "a", "s").collect()] == [("x", "y", "1", "2", 0.5, 0.7)]
    assert readers.image_results(results, "b", "s").count() == 0


def test_vocabularies_from_a_file(spark, tmp_path):
    (tmp_path / "types.json").write_text('{"kind": "creature", "names": ["Elf", "Angel", "Elf"]}\n{"kind": "land", "names": ["Forest"]}\n')
    words = readers.read_vocabularies(spark, str(tmp_path / "types.json"))
    assert sorted(r.name for r in readers.vocabulary(words, "creature").collect()) == ["Angel", "Elf"]
    texts = spark.createDataFrame([(1, "Legendary Elf"), (2, "Forest")], "id int, text string")
    base = spark.createDataFrame([("Land",)], "name string")
    got = {r.id: r.type for r in types.match_type(texts, base, readers.vocabulary(words, "creature")).collect()}
    assert got[1] == "Creature"


def test_command_line(spark, tmp_path):
    from lumenmatch.__main__ import main

    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    save("scans", [(1, "Darkness", "ab" * 32), (2, "qqqq", "ab" * 32)], "scan_id long, text string, hash string")
    save("dictionary", [("Darkness",), ("Light",)], "name string")
    save("printings", [("Darkness", "A", 1, "0.05")], "name string, set_name string, magic_id int, usd string")
    save("hashes", [("Darkness", "A", "ab" * 32)], "name string, set_name string, card_hash string")
    save("collection", [("Darkness", "A", 2)], "name string, set_name string, quantity int")
    args = [str(tmp_path / x) for x in ("scans", "dictionary", "printings", "hashes", "collection", "out")]
    assert main(args) == 0
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "matches")).collect()] == [(1, "Darkness", "A")]
    assert not (tmp_path / "out" / "collection").exists()
    main([*args, "--write"])
    assert spark.read.parquet(str(tmp_path / "out" / "collection")).first().quantity == 2
    assert [r.scan_id for r in spark.read.parquet(str(tmp_path / "out" / "errors")).collect()] == [2]
    spark.createDataFrame([], "scan_id long, text string, hash string").write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="scans is empty"):
        main([str(tmp_path / "none"), *args[1:]])


def test_intermediate_files_are_removed(spark, tmp_path):
    from pathlib import Path

    from lumenmatch import common

    kept = common.materialize(spark.range(3))
    path = Path(common._written[id(kept)][1])
    assert kept.count() == 3 and path.exists()
    common.forget(kept)
    common.forget(kept)
    assert not path.exists()


def test_seeding_reading_json_and_streaming(spark, tmp_path):
    (tmp_path / "names.json").write_text('{"data": ["b", "a", "a"]}')
    (tmp_path / "none.json").write_text("{}")
    names = readers.read_names(spark, str(tmp_path / "names.json"))
    writers.seed_dictionary(names, str(tmp_path / "dict"))
    assert sorted(r.name for r in readers.read_dictionary(spark, str(tmp_path / "dict")).collect()) == ["a", "b"]
    assert readers.read_names(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "cards.json").write_text('{"data": [{"name": "a", "set_name": "s", "prices": {"usd": "0.05"}}], "has_more": false}')
    assert readers.read_cards(spark, str(tmp_path / "cards.json")).first().usd == "0.05"
    writers.write_json(names, str(tmp_path / "out.json"))
    assert sorted(r.name for r in spark.read.json(str(tmp_path / "out.json")).collect()) == ["a", "a", "b"]
    seen = []
    q = stream_scans(spark, str(tmp_path / "dict"), "name string", lambda df, k: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) == 2
