"""Listing cards and page outlines, read in one pass."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.dedup import first_n_each
from . import schemas
from .html import records
from .selectors import Pick, Reader

#: Readers that this process has made already, by layout.
_READERS: dict[object, Reader] = {}


@dataclass(frozen=True)
class ListingLayout:
    """A shop's host, which relative links go to, and selectors of a listing's cards. The defaults."""

    host: str
    card: str = "div[data-id]"
    title: str = "div.RG5Slk"
    link: str = "a.k7wcnx"
    image: str = "img.UCc1lI"
    price: str = "div.hZ3P6w.DeU9vF"
    rating: str = "div.MKiFS6"
    bullets: str = "ul.HwRTzP li.DTBslk"


def _reader(layout: ListingLayout) -> Reader:
    if layout not in _READERS:
        first = {"title": Pick(layout.title), "link": Pick(layout.link, ("href",)), "image": Pick(layout.image, ("src", "data-src")), "price": Pick(layout.price), "rating": Pick(layout.rating)}
        _READERS[layout] = Reader(layout.card, first | {"bullets": Pick(layout.bullets, every=True)})
    return _READERS[layout]


def cards(html: str | None, layout: ListingLayout) -> list[dict]:
    """A record for each card that has a title or a link."""
    out = []
    for card in _reader(layout).read(html):
        href, rating = card["link"], re.match(r"\d+\.?\d*", card["rating"] or "")
        own = {"title": card["title"], "price": card["price"], "description": " | ".join(filter(None, card["bullets"])) or None, "link": None if not href else href if href.startswith("http") else layout.host + href, "image": card["image"], "rating": rating[0] if rating else None}
        if own["title"] or own["link"]:
            out.append(own)
    return out


_OUTLINE = {"title": Pick("title"), "heading": Pick("h1"), "hrefs": Pick("a[href]", ("href",), every=True), "texts": Pick("a[href]", every=True)}


def outline(html: str | None) -> list[dict]:
    """A page's title, first heading and links."""
    if "outline" not in _READERS:
        _READERS["outline"] = Reader(None, _OUTLINE)
    (page,) = _READERS["outline"].read(html)
    links = [{"href": h, "text": t} for h, t in zip(page["hrefs"], page["texts"], strict=True)]
    return [{"title": page["title"], "heading": page["heading"], "links": links}]


def listing(pages: DataFrame, layout: ListingLayout, cap: int | None = None, **columns: str) -> DataFrame:
    """Cards of listing pages; cap keeps the first so many cards of each page."""
    found = records(pages, lambda html: cards(html, layout), schemas.LISTING, **columns)
    return found if cap is None else first_n_each(found, "page_id", "at", cap)
