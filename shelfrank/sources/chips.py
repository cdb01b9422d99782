"""Chip ranking tables and detail pages, and the upsert of their documents."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .html import Element, first_attr, first_text, parse, records, select
from .selectors import Pick, Reader

#: Headings of the sections that are kept, and of recent results.
SECTIONS = ("Graphics", "AI Accelerator", "Memory", "Multimedia (ISP)", "Connectivity", "Info", "Specifications")
RECENT = "Recent AnTuTu v11 Results"
#: The cells of a ranking row. Field: selector of its text.
RANKING_CELLS = {
    "name": "td:eq(1) a",
    "brand": "td:eq(1) span.text-gray-small",
    "rating": "td:eq(2) .table-list-score-box",
    "antutu": "td:eq(3) > div > div:first-child",
    "geekbench": "td:eq(4) > div > div:first-child",
    "cores": "td:eq(5) .table-list-custom-circle",
    "clock": "td:eq(6)",
    "gpu": "td:eq(7)",
}
_RANKING = Reader("table.table-list.sortable tbody tr", {f: Pick(s) for f, s in RANKING_CELLS.items()} | {"href": Pick("td:eq(1) a", ("href",))})
#: Fixed value: detail pages read by default.
MOST_DETAILS = 20


def ranking_rows(html: str | None) -> list[dict]:
    """A record for each row of the ranking table; cells by place."""
    return _RANKING.read(html)


def _pairs(card: Element) -> dict[str, str]:
    """Keys and values of a card's tables; rows without a key are skipped, later ones win."""
    text = lambda row, s: "".join(e.text() for e in select(row, s)).strip()
    return {k: text(row, "td.cell-s") for row in select(card, "table.specs-table tbody tr") if (k := text(row, "td.cell-h"))}


@dataclass(frozen=True)
class Card:
    """A part of a detail page: where its card is found, by an element in it or by a heading's words, and how it is read."""

    field: str
    inside: str
    words: str
    read: Callable[[Element], object]

    def found(self, root: Element) -> Element | None:
        marks = select(root, self.inside)
        mark = next((m for m in marks if self.words in m.text()), None) if self.words else next(iter(marks), None)
        return mark.closest(".card") if mark else None


def _bars(card: Element) -> list[dict]:
    named = ((first_text(b, ".score-bar-name"), first_text(b, ".score-bar-result-square, .score-bar-result-square-dark")) for b in select(card, ".score-bar"))
    return [{"name": n, "value": v or ""} for n, v in named if n]


def _table(card: Element) -> list[list[Element]]:
    return [select(row, "td") for row in select(card, "table.table-list tbody tr")]


def _recent(row: list[Element]) -> dict:
    flat = [" ".join(re.split(r"\s+", td.text())) if k < 2 else td.text() for k, td in enumerate(row)]
    return dict(zip(("date", "score", "user", "phone"), [*flat, *[""] * 4], strict=False))


def _phone(row: list[Element]) -> dict:
    own = row[0].parent if row else Element("tr", {})
    return {"name": first_text(own, "td:eq(0) a") or first_text(own, "td:eq(0)") or "", "url": first_attr(own, "td:eq(0) a", "href"), "score": first_text(own, "td:eq(1)")}


#: A detail page's cards, and, above and below, the selectors of what stands in them.
CARDS = (
    Card("reviewScores", "#review", "", _bars),
    Card("antutu", "#antutu", "", lambda card: {"total": first_text(card, ".score-bar-result-number"), "breakdown": _pairs(card)}),
    Card("recentAntutu", "h3.title-h2", RECENT, lambda card: [_recent(row) for row in _table(card)]),
    Card("geekbench", "#geekbench", "", lambda card: {"breakdown": _pairs(card)}),
    Card("smartphones", "#phones", "", lambda card: [_phone(row) for row in _table(card)]),
)


def detail(html: str | None) -> list[dict]:
    """One chip document; parts whose card isn't on the page are null. A section with a heading but no card is empty."""
    root = parse(html)
    out: dict = {"title": first_text(root, "h1.title-h1"), "description": first_text(root, "div.card-block.pb.bt-light")}
    out |= {c.field: c.read(card) for c in CARDS if (card := c.found(root))}
    headed = {name: [h for h in select(root, "h3.title-h2, h2.title-h2") if name in h.text()] for name in SECTIONS}
    return [out | {"sections": {name: _pairs(card) if (card := hs[0].closest(".card")) else {} for name, hs in headed.items() if hs}}]


def read_pages(spark: SparkSession, path: str, fetch: Callable[[str], str] | None = None) -> DataFrame:
    """(page_id, html, base) of pages in a file or folder, or behind an address, which fetch reads on the driver.

    Paths may have backslashes, and addresses too few slashes. base: where a page's relative links start from.
    """
    place = re.sub(r"(?i)^(https?):/+", lambda m: m[1].lower() + "://", path.replace("\\", "/"))
    if re.match(r"https?://", place):
        if fetch is None:
            raise ValueError("an address needs something that fetches it")
        return spark.createDataFrame([(place, fetch(place) or "", place)], "page_id string, html string, base string")
    found = spark.read.text(place, wholetext=True).select(F.col("_metadata.file_path").alias("page_id"), F.col("value").alias("html"))
    return found.withColumn("base", F.regexp_replace("page_id", "[^/]*$", ""))


def rankings(pages: DataFrame, **columns: str) -> DataFrame:
    return records(pages, ranking_rows, schemas.RANKING, **columns)


def details(pages: DataFrame, **columns: str) -> DataFrame:
    return records(pages, detail, schemas.CHIP, **columns)


def wanted_details(rows: DataFrame, most: int = MOST_DETAILS, at: str = "at") -> DataFrame:
    """The first rows that have a link, as many as are to be visited; all for 0."""
    linked = rows.where(F.col("href").isNotNull())
    return linked.orderBy(at).limit(most) if most > 0 else linked


def with_details(rows: DataFrame, found: DataFrame, at: str = "at") -> DataFrame:
    """Every row with the detail found for its place: detailTitle, detailTextSnippet (never filled) and detail."""
    fields = [c for c in found.columns if c != at]
    right = found.select(F.col(at).alias("__at"), F.col("title").alias("detailTitle"), F.struct(*fields).alias("detail"))
    joined = rows.join(right, rows[at] == F.col("__at"), "left")
    return joined.select(*rows.columns, "detailTitle", F.lit(None).cast("string").alias("detailTextSnippet"), "detail")


def upserted(stored: DataFrame, new: DataFrame, key: str = "title", supplied: dict[str, Column] | None = None) -> DataFrame:
    """stored with new documents set over it by key: only supplied fields change, and a supplied null overwrites.

    supplied: for each field of new, whether a row supplies it; by default every field of new is supplied. Fields that
    new lacks keep their values. new has at most one row a key, and a row without a key is an error when it is read.
    """
    fields = [c for c in stored.columns if c != key]
    given = [c for c in new.columns if c != key and c in fields]
    supplied = supplied or {}
    checked = F.when(F.col(key).isNull() | (F.col(key) == ""), F.raise_error(F.lit("a document needs a key to be stored"))).otherwise(F.col(key))
    incoming = new.select(checked.alias("__key"), *(F.col(c).alias(f"__new_{c}") for c in given), *(supplied.get(c, F.lit(True)).alias(f"__has_{c}") for c in given))
    joined = stored.join(incoming, stored[key] == F.col("__key"), "full_outer")
    value = lambda c: F.when(F.coalesce(F.col(f"__has_{c}"), F.lit(False)), F.col(f"__new_{c}")).otherwise(F.col(c)) if c in given else F.col(c)
    return joined.select(*(F.coalesce(F.col(key), F.col("__key")).alias(key) if c == key else value(c).alias(c) for c in stored.columns))
