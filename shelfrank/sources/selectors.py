"""Records from HTML in one pass: all selectors of a layout as one state machine over the parser's events.

A record's selectors are compiled to steps. What of them may come next below an element is its state; an element moves its
parent's state on by what it is (tag, classes, id, attributes, place among its siblings where a selector asks for it).
Such moves are remembered, so a page costs one look-up an element and keeps no tree, only the elements that are open and
the texts that are wanted of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

from .html import _BLANKS, _SCOPE, _SIBLINGS, _VOID

_STEP = re.compile(r"([.#])([\w-]+)|\[([\w-]+)\]|:eq\((\d+)\)|(:first-child)|^([\w*-]+)")
_GROUP = {tag: group for group in _SIBLINGS for tag in group}

#: Moves that a machine remembers.
MOST_MOVES = 20_000


@dataclass(frozen=True)
class Pick:
    """What is taken of the first element that a selector names, or of every one: its text, or the first of some attributes
    that isn't empty. An empty text or attribute of a first element is None."""

    selector: str
    attrs: tuple[str, ...] = ()
    every: bool = False


@dataclass
class _Step:
    tag: str | None
    classes: frozenset[str]
    id: str | None
    attrs: tuple[str, ...]
    place: int | None
    first: bool
    direct: bool
    last: int | None  # the pick that it completes
    following: int  # the bit of the step after it

    def fits(self, tag: str, classes: frozenset[str], own_id: str | None, attrs: dict, place: int, first: bool) -> bool:
        return (self.tag is None or self.tag == tag) and self.classes <= classes and (self.id is None or self.id == own_id) and all(a in attrs for a in self.attrs) and self.place in (None, place) and (first or not self.first)


class Machine:
    """The selectors of some picks. States are sets of awaited steps, as bits."""

    def __init__(self, picks: list[Pick]):
        self.steps: list[_Step] = []
        self.start = 0
        for k, pick in enumerate(picks):
            for alternative in pick.selector.split(","):
                self._add(alternative.split(), k)
        self.lasting = sum(1 << i for i, s in enumerate(self.steps) if not s.direct)
        self.asked = sorted({a for s in self.steps for a in s.attrs})
        self.places = max((s.place for s in self.steps if s.place is not None), default=-1) + 1
        self.firsts = any(s.first for s in self.steps)
        # What no step asks for tells no moves apart, so that pages full of classes and ids of their own don't fill the memory.
        self.classed, self.named = any(s.classes for s in self.steps), any(s.id for s in self.steps)
        self.moves: dict[tuple, tuple[int, tuple[int, ...]]] = {}

    def _add(self, words: list[str], pick: int) -> None:
        direct, at = False, len(self.steps)
        self.start |= 1 << at
        names = [w for w in words if w != ">"]
        for word in words:
            if word == ">":
                direct = True
                continue
            found = _STEP.findall(word)
            one = lambda k: next((f[k] for f in found if f[k]), None)
            marked = lambda mark: [f[1] for f in found if f[0] == mark]
            tag, place, done = one(5), one(3), len(self.steps) - at + 1 == len(names)
            self.steps.append(_Step(None if tag == "*" else tag, frozenset(marked(".")), next(iter(marked("#")), None), tuple(f[2] for f in found if f[2]), None if place is None else int(place), bool(one(4)), direct, pick if done else None, 0 if done else 1 << len(self.steps) + 1))
            direct = False

    def move(self, state: int, tag: str, attrs: dict, place: int, first: bool) -> tuple[int, tuple[int, ...]]:
        """(the state below an element, the picks that name it), from its parent's state."""
        seen = (state, tag, attrs.get("class") if self.classed else None, attrs.get("id") if self.named else None, tuple(a in attrs for a in self.asked), min(place, self.places) if self.places else 0, self.firsts and first)
        found = self.moves.get(seen)
        if found is None:
            classes, below, named = frozenset((attrs.get("class") or "").split()), state & self.lasting, []
            for i, step in enumerate(self.steps):
                if state >> i & 1 and step.fits(tag, classes, attrs.get("id"), attrs, place, first):
                    below |= step.following
                    named += [step.last] if step.last is not None else []
            found = below, tuple(dict.fromkeys(named))
            if len(self.moves) < MOST_MOVES:
                self.moves[seen] = found
        return found


class Reader:
    """Records of the elements that a scope names, in document order, each of what picks take below it; one record of the
    page without a scope."""

    def __init__(self, scope: str | None, picks: dict[str, Pick]):
        self.names, self.picks = list(picks), list(picks.values())
        self.outer, self.inner = Machine([Pick(scope)] if scope else []), Machine(self.picks)
        self.whole = scope is None

    def read(self, html: str | None) -> list[dict]:
        page = _Page(self)
        page.feed(html or "")
        page.close()
        page.pop(0)
        return page.records


class _Open:
    """An element that is open: its state for the scope's selector and for each record around it, and the texts wanted of it."""

    __slots__ = ("counts", "inner", "outer", "tag", "texts", "children")

    def __init__(self, tag: str, outer: int, inner: list[tuple[dict, set, int]]):
        self.tag, self.outer, self.inner, self.texts, self.children, self.counts = tag, outer, inner, (), 0, {}


class _Page(HTMLParser):
    def __init__(self, reader: Reader):
        super().__init__(convert_charrefs=True)
        self.reader, self.records, self.listening = reader, [], []
        around = [self._record()] if reader.whole else []
        self.stack = [_Open("", reader.outer.start, around)]

    def _record(self) -> tuple[dict, set, int]:
        """(record, picks that are done, the state at its top)."""
        picks = zip(self.reader.names, self.reader.picks, strict=True)
        self.records.append({n: [] if p.every else None for n, p in picks})
        return self.records[-1], set(), self.reader.inner.start

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _GROUP:
            group, scope = _GROUP[tag], _SCOPE[tag]
            at = len(self.stack) - 1
            while at and self.stack[at].tag not in group and self.stack[at].tag not in scope:
                at -= 1
            if self.stack[at].tag in group:
                self.pop(at)
        parent, reader, own = self.stack[-1], self.reader, {k: v or "" for k, v in attrs}
        place, first = parent.counts.get(tag, 0), parent.children == 0
        parent.counts[tag], parent.children = place + 1, parent.children + 1
        outer, scoped = reader.outer.move(parent.outer, tag, own, place, first) if parent.outer else (0, ())
        inner, texts = [], []
        for record, done, state in parent.inner:
            below, named = reader.inner.move(state, tag, own, place, first)
            inner.append((record, done, below))
            for k in named:
                pick, name = reader.picks[k], reader.names[k]
                taken = next((v for a in pick.attrs if (v := own.get(a))), None)
                if pick.every:
                    record[name].append(taken or "")
                elif k not in done:
                    done.add(k)
                    record[name] = taken
                else:
                    continue
                if not pick.attrs:
                    texts.append((record, name, len(record[name]) - 1 if pick.every else None, []))
        if scoped:
            inner.append(self._record())
        if tag in _VOID:
            return
        opened = _Open(tag, outer, inner)
        opened.texts = texts
        self.listening += [t[3] for t in texts]
        self.stack.append(opened)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = len(self.stack) - 1
        while at and self.stack[at].tag != tag:
            at -= 1
        if at:  # an end without a start changes nothing
            self.pop(at)

    def pop(self, at: int) -> None:
        """Ends the elements from a place of the stack on."""
        for element in self.stack[max(at, 1) :]:
            for record, name, k, text in element.texts:
                said = "".join(text).strip(_BLANKS)
                if k is None:
                    record[name] = said or None
                else:
                    record[name][k] = said
                self.listening = [x for x in self.listening if x is not text]
        del self.stack[max(at, 1) :]

    def handle_data(self, data: str) -> None:
        for text in self.listening:
            text.append(data)
