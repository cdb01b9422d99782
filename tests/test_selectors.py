"""One-pass readers against the tree and its selectors."""

import random

import pytest

from shelfrank.sources import chips, html, listings
from shelfrank.sources.selectors import Pick, Reader

TAGS = ["div", "div", "div", "p", "ul", "li", "li", "table", "tbody", "tr", "tr", "td", "td", "a", "b", "img", "br", "span", "h1", "title"]
SELECTORS = ["div", "p", ".x", "div.x.y", "#k", "[href]", "a[href]", "div p", "div > p", "div .x", "ul li", "ul > li.x", "tr td:eq(1) a", "td:eq(0)", "td:eq(1)", "div > div:first-child", "td:eq(1) > div > div:first-child", "li, .y", "div b, p > b", "* > b", "div div div", "table tbody tr td"]


def page(rng, n=60):
    out, opened = [], []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5:
            tag = rng.choice(TAGS)
            attrs = "".join(rng.choice(["", "", f' class="{rng.choice(["x", "y", "x y", "z x"])}"', ' id="k"', ' href="/p"', ' href=""', " src=i"]) for _ in range(2))
            out.append(f"<{tag}{attrs}{rng.choice(['', '', '', '/'])}>")
            opened.append(tag)
        elif kind < 0.75 and opened:
            out.append(f"</{rng.choice([opened[-1], opened[-1], rng.choice(TAGS)])}>")
        else:
            out.append(rng.choice([" text ", "&amp;", "\u00a0", "a", "<!-- c -->", "<script>if (a < b) {}</script>"]))
    return "".join(out)


def expected(markup, scope, picks):
    """By the tree, with elements in document order."""
    root = html.parse(markup)
    place = {id(e): k for k, e in enumerate(root.within())}
    ordered = lambda at, selector: sorted(html.select(at, selector), key=lambda e: place[id(e)])
    out = []
    for at in [root] if scope is None else ordered(root, scope):
        own = {}
        for name, p in picks.items():
            values = [next((v for a in p.attrs if (v := e.attrs.get(a))), None) if p.attrs else e.text() for e in ordered(at, p.selector)]
            own[name] = [v or "" for v in values] if p.every else (values[0] or None) if values else None
        out.append(own)
    return out


@pytest.mark.parametrize("scope", [None, "div", "div.x", "tr", "ul > li"])
def test_readers_equal_the_tree(scope):
    rng = random.Random(scope)
    picks = {f"t{k}": Pick(s) for k, s in enumerate(SELECTORS)} | {f"a{k}": Pick(s, ("href", "src")) for k, s in enumerate(SELECTORS)} | {f"e{k}": Pick(s, every=True) for k, s in enumerate(SELECTORS)}
    reader = Reader(scope, picks)
    some = 0
    for _ in range(300):
        markup = page(rng)
        found, wanted = reader.read(markup), expected(markup, scope, picks)
        for f, w in zip(found, wanted, strict=True):
            assert f == w, markup
            some += any(f.values())
    assert some > 10


def test_odd_pages():
    assert Reader("p", {}).read(None) == Reader("p", {}).read("") == []
    assert Reader("p", {"t": Pick("b")}).read("<p><b>one") == [{"t": "one"}]
    assert Reader(None, {"t": Pick("p", every=True)}).read("<p>one<p>two</div></p>x") == [{"t": ["one", "two"]}]
    nested = "<div data-id=1><b>a</b><div data-id=2><b>c</b></div></div>"
    assert Reader("div[data-id]", {"t": Pick("b", every=True)}).read(nested) == [{"t": ["a", "c"]}, {"t": ["c"]}]
    assert listings.outline(None) == [{"title": None, "heading": None, "links": []}]
    assert chips.ranking_rows(None) == []


def test_moves_are_remembered():
    reader = Reader("tr", {"a": Pick("td:eq(1)"), "b": Pick("td b")})
    reader.read("<table>" + "<tr><td>1<td><b>2</b></tr>" * 500 + "</table>")
    assert len(reader.inner.moves) < 20


def test_ids_that_no_selector_asks_for_are_not_remembered():
    """A page's own ids and classes don't fill the memory of a reader that asks for tags alone."""
    from shelfrank.sources import listings

    listings.outline("<title>t</title>")
    machine = listings._READERS["outline"].inner
    before = len(machine.moves)
    listings.outline("".join(f'<div id="i{k}" class="c{k}"><a href="/{k}">x</a></div>' for k in range(500)))
    assert len(machine.moves) <= before + 8
