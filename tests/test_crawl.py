"""The crawl as a source: its rules over stored pages and a server, and as a stream."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from shelfrank.sources import crawl, listings as shop

from .test_sources import CARD, LAYOUT


@pytest.fixture
def listings(spark):
    spark.dataSource.register(crawl.Listings)
    return spark.read.format("listings")


def stored(spark, path, pages):
    """pages: listing -> pages from 1 on; None is one that failed."""
    rows = [(name, k + 1, page) for name, own in pages.items() for k, page in enumerate(own)]
    crawl.store_pages(spark.createDataFrame(rows, "listing string, page int, html string"), str(path))


def told(df):
    return sorted((r["listing"], r["attempt"], r["page"], r["status"]) for r in df.collect())


def test_rules_over_stored_pages(spark, tmp_path, listings):
    stored(spark, tmp_path, {"a": [CARD, "<p>", None, CARD, CARD], "b": [CARD, CARD], "c/é": ["<p>", None], "d": [None, CARD]})
    rows = listings.load(str(tmp_path))
    assert told(rows) == [
        ("a", 1, 1, "ok"), ("a", 1, 2, "empty"), ("a", 1, 3, "failed"), ("a", 1, 4, "ok"),  # no fifth page is wanted
        ("b", 1, 1, "ok"), ("b", 1, 2, "ok"),
        *(("c/é", k, n, s) for k in (1, 2, 3) for n, s in ((1, "empty"), (2, "failed"))),  # none had a card
        ("d", 1, 1, "failed"), ("d", 1, 2, "ok"),
    ]
    failed = rows.where("status = 'failed' AND listing = 'a'").first()
    assert "without a text" in failed["error"] and failed["html"] is None
    assert rows.rdd.getNumPartitions() == 4  # a listing each
    few = listings.option("listings", '["b", "none"]').option("most", "1").option("retries", "0").load(str(tmp_path))
    assert ("b", 1, 1, "ok") in told(few.where("listing = 'b'"))


def test_cards_of_a_crawl(spark, tmp_path, listings):
    other = lambda title: CARD.replace("A &amp; B", title)
    stored(spark, tmp_path, {"a": [CARD, other("A &amp; B (Blue)") + other("C"), "<p>"], "b": [other("c"), other("D")]})
    found = crawl.listed(listings.load(str(tmp_path)), LAYOUT).orderBy("_ordinal").collect()
    assert [r["title"] for r in found] == ["A & B", "C", "D"]
    assert shop.cards(CARD, LAYOUT)[0]["title"] == "A & B"


class Shop(BaseHTTPRequestHandler):
    asked = []

    def do_GET(self):
        Shop.asked.append(self.path)
        name, page = self.path.strip("/").split("/")
        code = 404 if int(page) > 3 else 500 if page == "2" else 200
        self.send_response(code)
        self.end_headers()
        if code == 200:
            self.wfile.write((CARD if name == "full" else "<p>none").encode())

    def log_message(self, *_):
        pass


def test_pages_behind_an_address(listings):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Shop)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Shop.asked.clear()
    try:
        made = listings.option("address", f"http://127.0.0.1:{server.server_port}/{{listing}}/{{page}}").option("listings", '["full", "bare"]').option("retries", "1").load()
        rows = told(made)
    finally:
        server.shutdown()
    assert rows == [*(("bare", k, n, s) for k in (1, 2) for n, s in ((1, "empty"), (2, "failed"), (3, "empty"))), ("full", 1, 1, "ok"), ("full", 1, 2, "failed"), ("full", 1, 3, "ok")]
    assert sorted(Shop.asked) == sorted([f"/full/{n}" for n in (1, 2, 3, 4)] + [f"/bare/{n}" for n in (1, 2, 3, 4)] * 2)


def test_stored_pages_as_a_stream(spark, tmp_path, listings):
    def run():
        rows = spark.readStream.format("listings").option("retries", "0").load(str(tmp_path / "pages"))
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        query.awaitTermination(90)
        return told(spark.read.parquet(str(tmp_path / "out")))

    stored(spark, tmp_path / "pages", {"a": [CARD, None]})
    assert run() == [("a", 1, 1, "ok"), ("a", 1, 2, "failed")]
    rows = [("a", 3, CARD), ("a", 4, "<p>"), ("a", 6, CARD), ("b", 1, CARD)]
    crawl.store_pages(spark.createDataFrame(rows, "listing string, page int, html string"), str(tmp_path / "pages"))
    assert run() == [("a", 1, 1, "ok"), ("a", 1, 2, "failed"), ("a", 1, 3, "ok"), ("a", 1, 4, "empty"), ("b", 1, 1, "ok")]  # nothing twice


def test_what_is_missing(spark, tmp_path, listings):
    with pytest.raises(Exception, match="a crawl needs"):
        listings.load().collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("listings").load(str(tmp_path / "none")).collect() == []


def test_a_reader_holds_few_pages(spark, tmp_path):
    """Pages are stored in small groups, in order, and leave the reader a few at a time."""
    import pyarrow.parquet as pq

    rows = spark.range(3000).selectExpr("'a' listing", "cast(3000 - id as int) page", "concat('<article>', id, repeat(cast(rand(1) as string), 200)) html")
    crawl.store_pages(rows, str(tmp_path / "kept"))
    (file,) = (tmp_path / "kept").glob("listing=a/*.parquet")
    assert pq.ParquetFile(file).num_row_groups >= 10
    reader = crawl.ListingsReader(crawl.Crawl({"path": str(tmp_path / "kept"), "most": "10000", "card": "article"}))
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert max(b.num_rows for b in batches) <= 64 and [p for b in batches for p in b["page"].to_pylist()] == list(range(1, 3001))
