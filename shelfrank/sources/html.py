"""Records from HTML: a small tree, a small selector language, and extraction by batches.

Selectors are steps separated by blanks (any depth) or ">" (children); a step is a tag, then any of .class, #id,
[attribute], :eq(n) and :first-child. Layouts name the selectors, so one engine reads any page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that end an open one of the same group.
_SIBLINGS = ({"li"}, {"td", "th"}, {"tr"}, {"p"}, {"option"}, {"dt", "dd"})
#: Where a search for an open sibling stops.
_SCOPE = {"li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead"}, "p": {"div", "td", "li", "body"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}}
_BLANKS = "\t\n\v\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))

#: Pages whose records a worker holds at once.
RUN = 64


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str]
    parent: Element | None = None
    content: list[Element | str] = field(default_factory=list)

    @property
    def children(self) -> list[Element]:
        return [c for c in self.content if isinstance(c, Element)]

    def within(self) -> Iterator[Element]:
        stack = self.children[::-1]
        while stack:
            at = stack.pop()
            yield at
            stack += at.children[::-1]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                out.append(at)
            else:
                stack += at.content[::-1]
        return "".join(out).strip(_BLANKS)

    def closest(self, step: str) -> Element | None:
        at, test = self, _step(step)
        while at is not None and not test(at):
            at = at.parent
        return at


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        group = next((g for g in _SIBLINGS if tag in g), None)
        if group:
            open_one = self.at
            while open_one.parent is not None and open_one.tag not in group and open_one.tag not in _SCOPE[tag]:
                open_one = open_one.parent
            if open_one.tag in group:
                self.at = open_one.parent
        own = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.content.append(own)
        if tag not in _VOID:
            self.at = own

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = self.at
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:  # an end without a start changes nothing
            self.at = at.parent

    def handle_data(self, data: str) -> None:
        self.at.content.append(data)


def parse(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_STEP = re.compile(r"([.#])([\w-]+)|\[([\w-]+)\]|:eq\((\d+)\)|(:first-child)|^([\w*-]+)")


#: Selectors that this process has read already.
_READ: dict[str, object] = {}


def _step(step: str):
    found = _READ.get(step)
    if found is None:
        found = _READ[step] = _compiled(step)
    return found


def _compiled(step: str):
    tests = []
    for mark, name, attr, at, first, tag in _STEP.findall(step):
        if mark == ".":
            tests.append(lambda e, n=name: n in e.attrs.get("class", "").split())
        elif mark == "#":
            tests.append(lambda e, n=name: e.attrs.get("id") == n)
        elif attr:
            tests.append(lambda e, n=attr: n in e.attrs)
        elif at:
            own_tag = re.match(r"[\w*-]+", step)[0]
            tests.append(lambda e, n=int(at), t=own_tag: e.parent is not None and [c for c in e.parent.children if c.tag == t][n : n + 1] == [e])
        elif first:
            tests.append(lambda e: e.parent is not None and e.parent.children[0] is e)
        elif tag != "*":
            tests.append(lambda e, n=tag: e.tag == n)
    return lambda e: bool(e.tag) and all(t(e) for t in tests)


def _words(selector: str) -> list[str]:
    found = _READ.get(" " + selector)
    if found is None:
        found = _READ[" " + selector] = selector.split()
    return found


def select(root: Element, selector: str) -> list[Element]:
    """Elements below root that the selector names, in document order. Alternatives are separated by commas."""
    if "," in selector:
        found = {id(e) for part in selector.split(",") for e in select(root, part)}
        return [e for e in root.within() if id(e) in found]
    now, direct = [root], False
    for word in _words(selector):
        if word == ">":
            direct = True
            continue
        test, seen, out = _step(word), set(), []
        for e in now:
            for x in e.children if direct else e.within():
                if id(x) not in seen and test(x):
                    seen.add(id(x))
                    out.append(x)
        now, direct = out, False
    return now


def first_text(root: Element, selector: str) -> str | None:
    found = select(root, selector)
    return (found[0].text() or None) if found else None


def first_attr(root: Element, selector: str, *names: str) -> str | None:
    found = select(root, selector)
    return next((v for n in names if (v := found[0].attrs.get(n))), None) if found else None


def records(pages: DataFrame, read, fields: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, at, fields...): what read() makes of each page's HTML, numbered within the page.

    Pages are read in batches where they lie; nothing is shuffled. Records are handed on after RUN pages, so that a worker
    holds no more of them than those pages have.
    """
    names = [f.strip().split(" ", 1)[0] for f in _top_level(fields)]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), RUN):
                run = batch.iloc[at : at + RUN]
                rows = [(i, k, *(r.get(n) for n in names)) for i, html in zip(run["id"], run["html"], strict=True) for k, r in enumerate(read(html))]
                yield pd.DataFrame(rows, columns=["page_id", "at", *names])

    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return source.mapInPandas(over, f"page_id {source.schema['id'].dataType.simpleString()}, at int, {fields}")


def _top_level(ddl: str) -> list[str]:
    """A column list's parts; commas inside types don't count."""
    parts, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts
