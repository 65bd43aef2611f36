import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumenmatch.functions import hashing, text
from lumenmatch.functions.geometry import crop_box, large_enough
from lumenmatch.operators import fuzzy, imaging, routing, types, validation, verify
from lumenmatch.plans import backfill, recognition
from lumenmatch.sources import readers

HEX = "0123456789abcdef" * 4


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(HEX, HEX, (1.0, 1.0, 1.0)), (HEX, HEX[:-2] + "aa", (1.0, 1.0, 0.97)), ("a", "b", (2.0, 4.0, 0.0)), ("abcd", "abcd", (1.0, 1.0, 1.0))],
)
def test_hash_scores(spark, a, b, want):
    r = one(spark, *hashing.compare(F.lit(a), F.lit(b)))
    assert (r.two, r.four, r.string) == want


def test_empty_hash_has_no_score(spark):
    r = one(spark, *hashing.compare(F.lit(""), F.lit("ab")))
    assert r.two is None and r.four is None


def test_text_functions(spark):
    r = one(
        spark, text.clean_text(F.lit("g Platinum Angel")), text.clean_text(F.lit("a —- b"), True), text.extension(F.lit("http://x/a.jpg?1")),
        text.encode_uri(F.lit("a b&c/é")), text.escape_spaces(F.lit("a b")), text.space_tokens(F.lit("a  b")),
        F.round(text.edit_similarity(F.lit("AdantoVanguard"), F.lit("Adanto Vanguard")), 4),
    )
    assert list(r) == ["gPlatinumAngel", "a  b", "jpg", "a%20b&c/%C3%A9", "a%20b", ["a", "", "b"], 0.9333]


@pytest.mark.parametrize(
    ("w", "h", "region", "box"),
    [(500, 696, "name", (378, 41, 27, 37)), (500, 696, "art", (428, 310, 27, 78)), (360, 500, "flavor", (308, 146, 19, 306)), (488, 680, "type", (354, 51, 26, 377))],
)
def test_crop_boxes(spark, w, h, region, box):
    assert tuple(one(spark, crop_box(F.lit(w), F.lit(h), F.lit(region)).alias("b")).b) == box
    assert one(spark, crop_box(F.lit(w), F.lit(h), F.lit("other")).alias("b")).b is None
    assert not one(spark, large_enough(F.lit(359), F.lit(500)).alias("x")).x


def test_fuzzy_lookup_and_policy(spark):
    names = spark.createDataFrame([(n,) for n in ("Adanto Vanguard", "Coat of Arms", "Darkness", "Sarkhan Vol", None, "darkness")], "name string")
    scans = spark.createDataFrame([(1, "AdantoVanguard"), (2, "Darkness"), (3, "Dark"), (4, "zzzz"), (5, None), (6, "AdantoVanguard")], "scan_id long, text string")
    top = fuzzy.fuzzy_topk(scans, fuzzy.dictionary_of(names))
    best = {r.scan_id: (r.name, round(r.score, 4)) for r in top.where("rank = 1").collect()}
    assert best == {1: ("Adanto Vanguard", 0.9333), 2: ("Darkness", 1.0), 3: ("Darkness", 0.5), 6: ("Adanto Vanguard", 0.9333)}
    kept = {(r.scan_id, r.name) for r in fuzzy.confidence_policy(top).collect()}
    assert kept == {(1, "Adanto Vanguard"), (2, "Darkness"), (6, "Adanto Vanguard")}
    assert "CartesianProduct" not in top._jdf.queryExecution().toString() and "NestedLoop" not in top._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    ("scores", "n"), [([0.99, 0.96, 0.8], 2), ([0.99, 0.8, 0.7, 0.69], 3), ([0.8] * 8, 6), ([0.5], 0)]
)
def test_policy_edges(spark, scores, n):
    df = spark.createDataFrame([(1, f"n{k}", s, k + 1) for k, s in enumerate(scores)], "scan_id int, name string, score double, rank int")
    assert fuzzy.confidence_policy(df).count() == n


def test_types(spark):
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "name string")
    texts = spark.createDataFrame([(1, "Artifact Creature Angel"), (2, "Enchantment"), (3, "Angel"), (4, "zzzz"), (5, "")], "id int, text string")
    got = {r.id: (r.type, r.score) for r in types.match_type(texts, words(*types.BASE_TYPES), words("Angel", "Elf")).collect()}
    assert got == {1: ("Creature", 1.0), 2: ("Enchantment", 1.0), 3: ("Creature", 1.0)}


def test_routing_end_to_end(spark):
    names = spark.createDataFrame([("Darkness",), ("Adanto Vanguard",), ("Adanto Vanguards",)], "name string")
    printings = spark.createDataFrame([("Darkness", "A", 1, "0.05"), ("Darkness", "B", 2, "x"), ("Adanto Vanguard", "C", 3, "1.5")], "name string, set_name string, magic_id int, usd string")
    stored = spark.createDataFrame([("Darkness", "A", HEX), ("Darkness", "B", HEX[::-1])], "name string, set_name string, card_hash string")
    scans = spark.createDataFrame([(1, "Darkness", HEX), (2, "AdantoVanguard", HEX), (3, "qqqq", HEX)], "scan_id long, text string, hash string")
    have = spark.createDataFrame([("Darkness", "A", 2)], "name string, set_name string, quantity int")
    out = recognition.recognise(scans, names, printings, stored, stored.limit(0), have)
    routed = {(r.scan_id, r.name): (r.sets, r.target) for r in out.routed.collect()}
    assert routed == {(1, "Darkness"): (["A"], "collection"), (2, "Adanto Vanguard"): (["C"], "attention"), (2, "Adanto Vanguards"): ([], "attention")}
    row = out.collection.first()
    assert (row.set_name, row.quantity, float(row.est_value)) == ("A", 2, 0.1)
    assert sorted(r.possible_sets for r in out.attention.collect()) == ["", "C"]
    assert [r.scan_id for r in out.errors.collect()] == [3]
    assert recognition.log_only(out).count() == 3


def test_upserts_and_inserts(spark):
    have = spark.createDataFrame([("a", "x", 2)], "name string, set_name string, quantity int")
    new = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), ("c", "y")], "name string, set_name string")
    got = {(r.name, r.set_name): r.quantity for r in routing.collection_upsert(have, new).collect()}
    assert got == {("a", "x"): 4, ("c", "y"): 1}
    assert sorted(r.name for r in routing.insert_if_absent(have, new.dropna(), ["name", "set_name"]).collect()) == ["c"]
    log = routing.transaction_log(routing.audited(new), "t", "insert", "name", True)
    assert log.columns == ["transaction_type", "is_successful", "table_name", "pk"]


def test_validation_splits(spark):
    df = spark.createDataFrame([("abc", 1), ("ab", 1), (None, 0)], "name string, n int")
    good, bad = validation.split_valid(df, [validation.text_rule("name", 3, 50), validation.number_rule("n", 1)])
    assert good.count() == 1 and sorted(len(r.violations) for r in bad.collect()) == [1, 2]


def test_backfill_and_report(spark):
    cards = '[{"name":"a","set_name":"s","foil":false,"promo":true,"image_uris":{"normal":"","large":"http://x/1.jpg?2"},"prices":{"usd":"1"}},{"name":"a","set_name":"t"}]'
    rows = spark.createDataFrame([(cards,)], "j string").select(F.explode(F.from_json("j", "array<string>")).alias("c"))
    p = readers.parse_cards(rows, "c")
    hashed = spark.createDataFrame([("http://x/1.jpg?2", HEX)], "image_url string, hash string")
    names = spark.createDataFrame([("a",)], "name string")
    stored = spark.createDataFrame([], "name string, set_name string, card_hash string, is_foil boolean, is_promo boolean")
    new = backfill.backfill(names, p, hashed, stored)
    assert [(r.set_name, r.is_promo) for r in new.collect()] == [("s", True)]
    assert backfill.backfill(names, p, hashed, new).count() == 0
    assert [tuple(r) for r in backfill.cards_by_set(new.union(new)).collect()] == [("s", 2)]
    assert verify.names_containing(spark.createDataFrame([("A",)], "query string"), p).count() == 2


def png(path, width, height, value):
    raw = b"".join(b"\0" + bytes([value(x, y) for x in range(width) for _ in range(3)]) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_from_files(spark, tmp_path):
    png(tmp_path / "a.png", 360, 500, lambda x, y: (x * 7 + y * 3) % 256)
    png(tmp_path / "b.png", 100, 100, lambda x, y: 9)
    images = imaging.from_image_source(readers.read_images(spark, str(tmp_path)))
    good, bad = imaging.split_by_size(images)
    assert good.count() == 1 and bad.first().error
    snips = imaging.snippets(good)
    sizes = {r.region: (r.width, r.height, r.channels) for r in snips.collect()}
    assert sizes["name"] == (272, 29, 1) and len(sizes) == 4
    hashes = imaging.hash_images(good).collect()
    assert len(hashes[0].hash) == 64
    read = imaging.extract_text(snips, lambda: lambda w, h, c, data: f"{w} x {h}")
    assert {r.clean_text for r in read.where("region = 'name'").collect()} == {"272x29"}
    assert imaging.base64_images(snips).first().name_image


def test_blur_and_small_images(spark):
    """The filter chain against one written out by pixel; images that are too small give no snippet."""
    import numpy as np

    r = np.random.default_rng(1)
    p = r.integers(0, 256, (7, 5, 3)).astype(float)

    def mean(rows):
        at = lambda y, x: rows[min(max(y, 0), len(rows) - 1)][min(max(x, 0), len(rows[0]) - 1)]
        return [[sum(at(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) * 57 // 512 for x in range(len(rows[0]))] for y in range(len(rows))]

    want = []
    for row in p:
        line = []
        for blue, green, red in row:
            grey = 0.0722 * blue + 0.7152 * green + 0.2126 * red
            v = min(255, max(0, int(np.floor((1 + 0.73) / (1 - 0.73) * (grey - 127) + 127))))
            line.append(int(min(255, max(0, v + (255 - v) * 0.235))))
        want.append(line)
    assert imaging.preprocess(p)[..., 0].tolist() == mean(mean(want))
    assert imaging.preprocess(p, grey=False).shape == (7, 5, 3)
    small = spark.createDataFrame([(1, 8, 8, 1, bytes(64)), (2, None, None, None, None)], "id int, width int, height int, channels int, data binary")
    assert imaging.snippets(small).count() == 0 and imaging.split_by_size(small)[1].count() == 2


def test_golden_hash_and_regions_in_one_call(spark, tmp_path):
    """A left half darker than the right one, side 16: every row of blocks is 0 then 1."""
    import numpy as np

    half = np.where(np.arange(32) < 16, 10, 200)[None, :, None] * np.ones((32, 1, 1))
    assert imaging.block_hash(half) == "00ff" * 16
    assert imaging.block_hash(half[:, ::-1]) == "ff00" * 16
    assert imaging.block_hash(np.zeros((20, 20, 1))) == "0" * 64 and imaging.block_hash(np.full((20, 20, 1), 255.0)) == "f" * 64
    data = bytes(360 * 500)
    one_ = spark.createDataFrame([(1, 360, 500, 1, data)], "id int, width int, height int, channels int, data binary")
    got = {r.region: r.clean_text for r in imaging.read_regions(one_, lambda: lambda w, h, c, x: f"{w}-{h} {len(x)}").collect()}
    assert got == {"name": f"27229{272 * 29}", "type": f"26138{261 * 38}"}


def test_one_match_and_json_functions(spark):
    names = spark.createDataFrame([("Darkness",), ("Dark",)], "name string")
    texts = spark.createDataFrame([("darkness",), ("",), (None,), ("zzzz",)], "text string")
    assert [(r.text, r.name) for r in fuzzy.lookup_one(texts, names).collect()] == [("darkness", "Darkness")]
    r = one(spark, text.json_text(F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"))), text.is_empty_json(F.lit(" { } ")), text.is_empty_json(F.lit('{"a":1}')), text.is_empty_json(F.lit("x")))
    assert list(r) == ['{"a":1}', True, False, False]


@pytest.mark.parametrize("k", range(0, 17, 2))
def test_profiles_around_their_thresholds(spark, k):
    """Hashes that differ in their first k digits: what passes follows the three scores."""
    near = "x" * k + HEX[k:]
    s = one(spark, *hashing.compare(F.lit(near), F.lit(HEX)))
    for p in (hashing.STORED, hashing.REMOTE):
        got = one(spark, hashing.reaches(hashing.parts(F.lit(near)), hashing.parts(F.lit(HEX)), p).alias("x")).x
        assert got == (s.two >= p.two and s.four >= p.four and s.string >= p.string)


def test_strict_mode_and_fresh_hashes(spark):
    names = spark.createDataFrame([("Darkness",)], "name string")
    cols = "name string, set_name string, card_hash string, is_foil boolean, is_promo boolean"
    printings = spark.createDataFrame([("Darkness", x, k, "1") for k, x in enumerate("ABC")], "name string, set_name string, magic_id int, usd string")
    remote = spark.createDataFrame([("Darkness", "A", HEX, False, False), ("Darkness", "B", HEX, False, False), ("Darkness", "C", HEX[::-1], False, False), ("Other", "A", HEX, False, False)], cols)
    stored = spark.createDataFrame([("Darkness", "A", HEX, False, False)], cols)
    scans = spark.createDataFrame([(1, "Darkness", HEX), (2, "Darkness", HEX[::-1])], "scan_id long, text string, hash string")
    have = spark.createDataFrame([], "name string, set_name string, quantity int")
    loose = recognition.recognise(scans, names, printings, stored, remote, have)
    assert {r.scan_id: r.sets for r in loose.routed.collect()} == {1: ["A", "B"], 2: ["C"]}
    assert sorted(r.set_name for r in loose.fresh.collect()) == ["B", "C"]
    strict = recognition.recognise(scans, names, printings, stored, remote, have, strict_db=True)
    assert {r.scan_id: r.sets for r in strict.routed.collect()} == {1: ["A", "B"], 2: []}


def test_a_set_without_a_name_is_empty_text(spark):
    hashes = spark.createDataFrame([("n", HEX, None), ("n", HEX, "A"), (None, HEX, "B")], "name string, card_hash string, set_name string")
    scans = spark.createDataFrame([(1, "n", HEX), (2, None, HEX)], "scan_id long, name string, hash string")
    got = verify.matched_sets(scans, hashes, hashes.limit(0), ["name"], ["scan_id"])
    assert [tuple(r) for r in got.collect()] == [(1, ["", "A"])]


def test_rule_lists(spark):
    good = ("abc", "typ", "set", 1, 1, "http://x")
    df = spark.createDataFrame([good, ("ab", *good[1:]), (*good[:3], 0, 1, "u" * 151), (None,) * 6], "card_name string, card_type string, card_set string, quantity int, magic_id int, image_url string")
    ok, bad = validation.split_valid(df, validation.collection_rules())
    assert ok.count() == 1 and sorted(len(r.violations) for r in bad.collect()) == [1, 2, 6]
    seen = spark.createDataFrame([(None, "t", "t", "img", None, None, None, None), ("ab", "", "t", None, "ab", None, None, None)], "card_name string, extracted_text string, dirty_extracted_text string, name_image string, type_image string, art_image string, flavor_image string, possible_sets string")
    ok, bad = validation.split_valid(seen, validation.attention_rules())
    assert ok.count() == 1 and len(bad.first().violations) == 4
    sums = spark.createDataFrame([(None, 0.0, 0.5), ("a", -0.1, None)], "name string, flavor_match_percent double, art_match_percent double")
    ok, bad = validation.split_valid(sums, validation.transaction_rules())
    assert ok.count() == 1 and len(bad.first().violations) == 3


def test_slices_of_a_large_dictionary(spark):
    names = spark.range(0, 3000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")).repartition(7)
    want = sorted(f"n{k}" for k in range(3000))
    got = backfill.dictionary_slice(names, 990, 1800).orderBy("place").collect()
    assert [r.name for r in got] == want[990:1800] and [r.place for r in got] == list(range(990, 1800))
    assert backfill.dictionary_slice(names, 5000, 5010).count() == 0


def test_registered_rows_reach_every_branch(spark):
    """The smallest tables give scans of all kinds: one and several matches, all actions and both targets."""
    import __spark_entry__ as e

    q, d = e.queries(), "/root/testdata/sf0.001"
    assert {r.action for r in q["dispatch_by_count"](spark, d).select("action").distinct().collect()} == {"none", "one", "many"}
    routed = q["route_scans"](spark, d).collect()
    assert {r.target for r in routed} == {"collection", "attention"} and any("," in r.sets for r in routed)
    per = {}
    for r in q["fuzzy_policy"](spark, d).collect():
        per.setdefault(r.scan_id, []).append(r.percentage)
    assert max(map(len, per.values())) == 6 and any(len(x) > 1 and min(x) >= 0.95 for x in per.values())


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and "fuzzy_topk" in names


def test_names_containing_answers_more_queries_than_are_broadcast(spark):
    p = spark.createDataFrame([("Azur Éclat", "s1"), ("azurE", "s2"), ("Aaaa", "s3"), ("", "s4"), (None, "s5")], "name string, set_name string")
    asked = ["A", "az", "zur", "éclat", "azure", "aaa", "zz", "", None, "az"]
    q = spark.createDataFrame([(x,) for x in asked], "query string")
    want = sorted((n, x) for n in ("Azur Éclat", "azurE", "Aaaa", "") for x in asked if x is not None and x.lower() in n.lower())
    got = verify.names_containing(q, p)
    assert got.columns == ["name", "set_name", "query"]
    assert sorted((r.name, r.query) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_sides_that_grow_with_the_scans_are_not_broadcast(spark, tmp_path):
    """Their size is guessed from compressed files and shuffles; rows of hashes with their bands took hundreds of MB of the driver."""
    scans = spark.createDataFrame([(k, "a", f"{k % 3}" * 64) for k in range(30)], "scan_id long, name string, hash string")
    hashes = spark.createDataFrame([("a", s * 64, s) for s in "012"], "name string, card_hash string, set_name string")
    scans.write.parquet(f"{tmp_path}/scans")
    hashes.write.parquet(f"{tmp_path}/hashes")
    scans, hashes = spark.read.parquet(f"{tmp_path}/scans"), spark.read.parquet(f"{tmp_path}/hashes")
    joins = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x]
    for profile in (hashing.STORED, hashing.REMOTE):
        met = [x for x in joins(verify.banded_pairs(scans, hashes, profile, ["name"])) if "_band" in x]
        assert met and all("SortMergeJoin" in x for x in met)
    routed = scans.select("scan_id", "name", F.array("name").alias("sets"), F.lit("attention").alias("target"))
    for out in (routing.attention_rows(routed, scans.drop("name")), routing.unmatched(scans, routed)):
        assert len(joins(out)) == 1 and "SortMergeJoin" in joins(out)[0]
    twice = scans.unionByName(scans).unionByName(spark.createDataFrame([(0, "a", "1" * 64), (99, "a", None)], scans.schema))
    got = {r.scan_id: r.sets for r in verify.matched_sets(twice, hashes, hashes, ["name"], ["scan_id"]).collect()}
    assert got == {0: ["0", "1"]} | {k: [str(k % 3)] for k in range(1, 30)}


def test_clean_text_equals_the_plain_expression_and_is_not_run_by_spark(spark):
    odd = [None, "", " ", "a  b\tc\nd", "é1—2 ß", "\U0001f600x\U0001f600", "\x00z\x7f", "0_9-[]^", "ab" * 50_000 + " é" * 50_000]
    df = spark.createDataFrame(list(enumerate(odd * 3)), "k int, t string")
    out = df.select("k", "t", text.clean_text(F.col("t")).alias("clean"), text.clean_text(F.col("t"), True).alias("spaced"))
    for r in out.collect():
        want = [None if r.t is None else re.sub(p, "", r.t) for p in ("[^A-Za-z0-9]", "[^A-Za-z0-9 ]")]
        assert [r.clean, r.spaced] == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan
    assert df.limit(0).select(text.clean_text(F.col("t"))).count() == 0
