"""A crawl of listings as a Spark source: which pages of a listing are read, and what became of each.

    spark.dataSource.register(Listings)
    spark.read.format("listings").option("address", "https://shop.test/{listing}?page={page}").option("listings", '["phones"]').load()
    spark.read.format("listings").load("folder of stored pages")
    spark.readStream.format("listings").load("folder of stored pages")

Each listing is a partition, so listings are crawled side by side, the pages of one after each other. A listing's pages from
1 on are read until one isn't there, or as many as are wanted. A page that fails, or has no card, is passed over, the first
one too; if none had a card, the listing is tried again. Every page that was tried is a row, with what it failed with.

Stored pages are Parquet tables of (page, html), a folder listing=<name> for each listing, as `store_pages` writes them. A
stream reads what has been stored since its last batch; its offsets are the pages stored of each listing.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.dedup import first_models
from .listings import ListingLayout, listing
from .selectors import Reader

#: Pages that are read, and how often a listing without cards is tried again.
MOST_PAGES, RETRIES = 4, 2
#: ok: the page has cards; empty: it has none; failed: it couldn't be read.
SCHEMA = "listing string, page int, attempt int, status string, error string, html string"

#: Pages of a group of stored ones, which is what a reader decodes at once, and the most compressed bytes of one.
GROUP_PAGES, GROUP_BYTES = 256, 4 << 20


class NoSuchPage(Exception):
    """The listing has no page of that number."""


class StoredPages:
    """Pages of a folder of tables, one for each listing. A page without HTML is one that failed when it was stored."""

    #: Pages that are read at once.
    BLOCK = 64

    def __init__(self, path: str):
        # Spark writes one slash after the scheme, other readers want three.
        uri = path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:")
        self.files, self.root = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
        self.held: tuple[str, int, dict[int, str | None]] = ("", 0, {})
        self.open: tuple[str, ds.Dataset] | None = None

    def folders(self) -> dict[str, str]:
        """Folders by listing, as names are escaped in them."""
        found = self.files.get_file_info(pafs.FileSelector(self.root))
        return {unquote(f.base_name.removeprefix("listing=")): f.path for f in found if f.base_name.startswith("listing=")}

    def names(self) -> list[str]:
        return sorted(self.folders())

    def _table(self, name: str) -> ds.Dataset:
        kind = pa.schema([("page", pa.int32()), ("html", pa.string())])
        return ds.dataset(self.folders().get(name, []), filesystem=self.files, format="parquet", schema=kind)

    def last(self, name: str, most: int) -> int:
        """The last page up to which all are stored."""
        there = set(self._table(name).to_table(["page"], filter=ds.field("page") <= most)["page"].to_pylist())
        return next(n for n in range(most + 1) if n + 1 not in there)

    def fetch(self, name: str, page: int) -> str:
        first = (page - 1) // self.BLOCK * self.BLOCK + 1
        if self.held[:2] != (name, first):
            if self.open is None or self.open[0] != name:
                self.open = name, self._table(name)
            at, found = ds.field("page"), {}
            # Only groups of rows that hold such pages are read, one after another, and given in short batches.
            for rows in self.open[1].to_batches(filter=(at >= first) & (at < first + self.BLOCK), batch_size=self.BLOCK, batch_readahead=1, fragment_readahead=1, use_threads=False):
                found.update(zip(rows["page"].to_pylist(), rows["html"].to_pylist(), strict=True))
            self.held = (name, first, found)
        if page not in self.held[2]:
            raise NoSuchPage
        if self.held[2][page] is None:
            raise OSError("stored without a text")
        return self.held[2][page]


class AddressedPages:
    """Pages behind an address with {listing} and {page} in it. "Not found" and "gone" mean that a listing has no such page."""

    def __init__(self, address: str, seconds: float):
        self.address, self.seconds = address, seconds

    def fetch(self, name: str, page: int) -> str:
        try:
            with urllib.request.urlopen(self.address.format(listing=quote(name, safe=""), page=page), timeout=self.seconds) as said:
                return said.read().decode(said.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                raise NoSuchPage from None
            raise


class Part(InputPartition):
    """Pages of a listing: those after `start`, up to `end`."""

    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class Crawl:
    """The options of a source, and the rules by which a listing is read."""

    def __init__(self, options: dict[str, str]):
        number = lambda name, kind, usual: kind(options.get(name, usual))
        self.most, self.retries, self.card = number("most", int, MOST_PAGES), number("retries", int, RETRIES), Reader(options.get("card", ListingLayout("").card), {})
        if "address" in options:
            self.pages = AddressedPages(options["address"], number("seconds", float, 30))
            self.names = json.loads(options["listings"])
        elif "path" in options:
            self.pages = StoredPages(options["path"])
            self.names = json.loads(options["listings"]) if "listings" in options else self.pages.names()
        else:
            raise ValueError("a crawl needs a folder of stored pages, or an address and its listings")

    def rows(self, part: Part) -> Iterator[tuple]:
        for attempt in range(1, self.retries + 2):
            some = False
            for page in range(part.start + 1, part.end + 1):
                try:
                    html = self.pages.fetch(part.name, page)
                except NoSuchPage:
                    break
                except Exception as e:  # noqa: BLE001  whatever a page fails with, the next may do
                    yield part.name, page, attempt, "failed", f"{type(e).__name__}: {e}", None
                    continue
                has_cards = bool(self.card.read(html))
                some |= has_cards
                yield part.name, page, attempt, "ok" if has_cards else "empty", None, html
            if some:
                return


def _batches(rows: Iterator[tuple], most: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows a few at a time, as a reader that gives rows has Spark hold thousands of pages before any is handed on."""
    kinds = pa.schema([("listing", pa.string()), ("page", pa.int32()), ("attempt", pa.int32()), ("status", pa.string()), ("error", pa.string()), ("html", pa.string())])
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)


class Listings(DataSource):
    """The source "listings". Options: path (stored pages) or address, listings (a JSON array of names; by default all
    that are stored), most (pages a listing), retries, card (a selector), seconds (until an address fails)."""

    @classmethod
    def name(cls) -> str:
        return "listings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ListingsReader(Crawl(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ListingsStream(Crawl(self.options))


class ListingsReader(DataSourceReader):
    def __init__(self, crawl: Crawl):
        self.crawl = crawl

    def partitions(self) -> list[Part]:
        return [Part(n, 0, self.crawl.most) for n in self.crawl.names] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _batches(self.crawl.rows(partition))


class ListingsStream(DataSourceStreamReader):
    """Stored pages as they come. Of each batch's pages the same rules hold as of a listing's."""

    def __init__(self, crawl: Crawl):
        if not isinstance(crawl.pages, StoredPages):
            raise ValueError("only stored pages are read as a stream")
        self.crawl = crawl

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {n: self.crawl.pages.last(n, self.crawl.most) for n in self.crawl.pages.names()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(n, start.get(n, 0), last) for n, last in end.items() if last > start.get(n, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _batches(self.crawl.rows(partition))


def store_pages(pages: DataFrame, path: str) -> None:
    """Adds (listing, page, html) rows to a folder of stored pages. A listing's pages go to one file, in their order and in
    groups of GROUP_PAGES, so that a reader takes some of them without the rest."""
    rows = pages.select("listing", F.col("page").cast("int").alias("page"), "html").repartition("listing").sortWithinPartitions("listing", "page")
    rows.write.mode("append").option("parquet.block.row.count.limit", GROUP_PAGES).option("parquet.block.size", GROUP_BYTES).partitionBy("listing").parquet(path)


def listed(crawled: DataFrame, layout: ListingLayout) -> DataFrame:
    """Cards of crawled listings, the first of each model, in the order of listings, pages and cards."""
    some = crawled.where("status = 'ok'").selectExpr("struct(listing, page) AS place", "html")
    found = listing(some, layout, id_col="place")
    return first_models(found.select("*", F.struct("page_id.listing", "page_id.page", "at").alias("_ordinal")))
