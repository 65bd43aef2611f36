import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lumenmatch.operators import imaging
from lumenmatch.plans import backfill
from lumenmatch.schemas import TABLES
from lumenmatch.sources import catalog, keyed, readers, writers

from .test_recognition import png

CARDS = [{"name": f"card {k}", "set_name": f"s{k % 3}", "foil": k % 2 == 0, "image_uris": {"normal": f"http://x/{k}.jpg"}, "prices": {"usd": str(k)}} for k in range(53)]


@pytest.fixture
def service():
    """Lists of 7 cards a page; the first answer for every third page is a passing fault."""
    seen = {}

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(parse_qs(urlparse(self.path).query)["page"][0])
            seen[page] = seen.get(page, 0) + 1
            kind = urlparse(self.path).path
            data = CARDS if kind == "/cards" else [c["name"] for c in CARDS] if kind == "/names" else []
            part = data[(page - 1) * 7 : page * 7]
            code = 503 if page % 3 == 0 and seen[page] == 1 else 404 if not part else 200 if kind != "/gone" else 400
            body = json.dumps({"object": "list", "total_cards": len(data), "has_more": page * 7 < len(data), "data": part}).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_all_pages_of_a_service_equal_the_file_reader(spark, service, tmp_path):
    url, seen = service
    (tmp_path / "cards.json").write_text(json.dumps({"data": CARDS}))
    want = sorted(map(tuple, readers.read_cards(spark, str(tmp_path / "cards.json")).collect()))
    cards, bad = catalog.read_catalog(spark, f"{url}/cards?page={{page}}", tasks=3, wait=0.01, per_second=500)
    assert sorted(map(tuple, cards.collect())) == want and len(want) == 53 and bad.count() == 0
    pages = catalog.read_pages(spark, f"{url}/cards?page={{page}}", tasks=3, wait=0.01, per_second=500)
    assert pages.rdd.getNumPartitions() == 3 and pages.select("page").distinct().count() == 8
    assert sorted(r.name for r in catalog.read_catalog_names(spark, f"{url}/names?page={{page}}", per_second=500).collect()) == sorted(c["name"] for c in CARDS)
    assert catalog.read_pages(spark, f"{url}/none?page={{page}}").count() == 0
    seen.clear()
    with pytest.raises(Exception, match="503"):
        catalog.read_pages(spark, f"{url}/cards?page={{page}}", retries=0, per_second=500).count()


def test_a_catalogue_that_grows_while_it_is_read():
    reader = catalog.CatalogReader({"url": "x{page}", "tasks": "2", "per_second": "1000"})
    size = [9]

    def ask(page):
        data = [str(k) for k in range(size[0])][(page - 1) * 3 : page * 3]
        return {"data": data, "has_more": page * 3 < size[0], "total_cards": size[0]}

    reader.ask = ask
    parts = reader.partitions()
    size[0] = 14
    assert [x for p in parts for _, x in reader.read(p)] == [str(k) for k in range(14)]


def test_corrupt_cards_are_counted(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"data": CARDS[:5]}))
    (folder / "b.json").write_text('{"data": [{"name": "x"')
    cards, bad = readers.read_cards_checked(spark, str(folder))
    assert cards.count() == 5 and [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["b.json"]


def test_a_bulk_file_is_read_by_several_tasks(spark, tmp_path):
    lines = [json.dumps(CARDS[k % 53] | {"name": f"n{k}"}) + "," for k in range(4000)]
    lines[17], lines[3000] = '{"name": "cut', "<html>,"
    (tmp_path / "bulk.json").write_text("[\n" + "\n".join(lines).rstrip(",") + "\n]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        cards, bad = readers.read_bulk_cards(spark, str(tmp_path / "bulk.json"))
        assert cards.rdd.getNumPartitions() > 3
        assert cards.count() == 3998 and cards.where("name is null or set_name is null").count() == 0
        assert sorted(r.text for r in bad.collect()) == ["<html>", '{"name": "cut']
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_hashes_by_path(spark, tmp_path):
    png(tmp_path / "a.png", 40, 30, lambda x, y: (x * 7 + y * 3) % 256)
    png(tmp_path / "b.png", 16, 16, lambda x, y: x * 16)
    (tmp_path / "c.png").write_bytes(b"no image")
    paths = [str(tmp_path / n) for n in ("a.png", "b.png", "c.png")]
    got, bad = imaging.hash_paths(spark, paths)
    want = imaging.hash_images(imaging.from_image_source(readers.read_images(spark, str(tmp_path)))).collect()
    assert sorted((r.path, r.hash) for r in got.collect()) == sorted((r.id, r.hash) for r in want) and len(want) == 2
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in bad.collect()] == [("c.png", "No image")]
    content = readers.read_image_bytes(spark, str(tmp_path), "png").collect()
    assert sorted((r.path.rsplit("/", 1)[1], bytes(r.content)) for r in content) == [(n, (tmp_path / n).read_bytes()) for n in ("a.png", "b.png", "c.png")]


def test_snippets_keep_colour_where_asked_and_are_written_by_region(spark, tmp_path):
    import numpy as np

    pixels = np.random.default_rng(1).integers(0, 256, (500, 360, 3)).astype(np.uint8)
    one = spark.createDataFrame([(1, 360, 500, 3, pixels.tobytes())], "id int, width int, height int, channels int, data binary")
    snips = imaging.snippets(one, preserve_colour=True)
    got = {r.region: r for r in snips.collect()}
    assert {k: r.channels for k, r in got.items()} == {"name": 1, "type": 1, "art": 3, "flavor": 3}
    art = got["art"]
    box = pixels[56 : 56 + art.height, 19 : 19 + art.width].astype(float)
    assert bytes(art.data) == imaging.preprocess(box, grey=False).tobytes()
    writers.write_snippets(snips, str(tmp_path / "snips"))
    back = spark.read.parquet(str(tmp_path / "snips"))
    assert sorted(p.name for p in (tmp_path / "snips").iterdir() if p.is_dir()) == ["region=art", "region=flavor", "region=name", "region=type"]
    assert {r.region: bytes(r.data) for r in back.collect()} == {k: bytes(r.data) for k, r in got.items()}


def test_a_stopped_backfill_goes_on_and_hashes_nothing_twice(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS lumen_fill")
    keyed.create_keyed(spark, "lumen_fill.hashes", TABLES["card_hashes"], 4)
    names = spark.createDataFrame([(f"n{k:02d}",) for k in range(25)], "name string")
    rows = [(f"n{k:02d}", s, False, False, f"http://x/{k}{s}.jpg?1" if k != 4 else "http://x/4.png") for k in range(25) for s in "ab"]
    printings = spark.createDataFrame(rows, "name string, set_name string, is_foil boolean, is_promo boolean, image_url string")
    seen = []

    def hasher(urls):
        seen.extend(r.image_url for r in urls.collect())
        return urls.select("image_url", F.sha2("image_url", 256).alias("hash"))

    def broken(urls):
        hasher(urls.limit(0))
        raise RuntimeError("stopped")

    ledger = backfill.Ledger(spark, str(tmp_path / "ledger"))
    run = lambda h, most=None: backfill.run_backfill(names, printings, h, "lumen_fill.hashes", ledger, 10, most)
    assert run(hasher, 1) == 1 and len(seen) == 18
    with pytest.raises(RuntimeError):
        run(broken)
    assert run(hasher) == 2 and len(seen) == len(set(seen)) == 48
    assert run(hasher) == 0
    assert spark.table("lumen_fill.hashes").count() == 48
    states = sorted((r.start, r.state) for r in ledger.rows().collect())
    assert states == [(0, "done"), (0, "started"), (10, "done"), (10, "started"), (10, "started"), (20, "done"), (20, "started")]
    # a changed dictionary is gone through again, and only its new images are hashed
    names = names.unionByName(spark.createDataFrame([("n05x",)], "name string"))
    printings = printings.unionByName(spark.createDataFrame([("n05x", "a", False, False, "http://x/new.jpg")], printings.schema))
    assert run(hasher) == 3 and seen[48:] == ["http://x/new.jpg"]
    spark.sql("DROP DATABASE lumen_fill CASCADE")


def test_snippets_equal_their_sql(spark, tmp_path):
    import duckdb
    import numpy as np

    from lumenmatch.plans import queries

    r = np.random.default_rng(5)
    vectors = [(k, [float(x) for x in r.normal(0, s, 64)]) for k, s in enumerate((0.01, 0.1, 0.3, 2.0))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(x.id, x.region): (x.width, x.height, x.sha256) for x in queries.image_snippets(spark, str(tmp_path)).collect()}
    sql = f"WITH embeddings AS (SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet') SELECT id, region, width, height, sha256 FROM ({queries.SQL['image_snippets']})"
    assert got == {x[:2]: x[2:] for x in duckdb.sql(sql).fetchall()} and len(got) == 16
