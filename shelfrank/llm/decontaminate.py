"""Benchmark decontamination by Wu-Manber search over words.

Every benchmark item gives windows of WINDOW consecutive words (a shorter item is one window). A matcher looks at the
block of words that ends at its position: the shift table says how far no window can end, and where it says zero, the
bucket of that block's hash lists the windows to compare word by word. Windows of full length and shorter ones have a
matcher each, so that a short item doesn't shorten every jump.

A matcher is a few arrays over one buffer of benchmark text: a byte of shift for each slot, and for each window its
hash, its place in the buffer and its item, about thirty bytes a word in all. Matchers of BLOCK_BYTES of text go to the
workers at a time. A larger benchmark is cut into several such blocks, searched one after another over staged rows that
carry the hits so far, so memory stays bounded and nothing is left out; long items are cut into overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shared, alnum_words, carried, discard, pieces, staged, texts_of

WINDOW = 13
#: Benchmark text whose matchers are broadcast together, and the words of an item's piece.
BLOCK_BYTES, PIECE_WORDS = 16 << 20, 100_000


class Matcher:
    """Wu-Manber tables over windows of texts: pieces of (item, words joined by blanks). With a window, all windows of
    that many words of every piece; without, each piece is one window."""

    def __init__(self, texts: Iterable[tuple[str | None, bytes]], window: int | None):
        texts = [(item, body) for item, body in texts if body]
        self.least = window or min((body.count(b" ") + 1 for _, body in texts), default=1)
        self.block = min(2, self.least)
        self.far = self.least - self.block + 1
        names: dict[str | None, int] = {}
        keys, at, size, words, items, blocks, jumps = ([] for _ in range(7))
        base = 0
        for item, body in texts:
            own = body.split(b" ")
            ends = np.cumsum([len(w) + 1 for w in own]) - 1
            starts = np.r_[0, ends[:-1] + 1]
            one = list(map(crc32, own))
            block = one if self.block == 1 else list(map(crc32, own[1:], one))  # of words j and j + 1
            n = len(own) - self.least + 1 if window else 1
            last = np.array(block[self.least - self.block : self.least - self.block + n], np.uint64)
            prefix = [crc32(body[a:b]) for a, b in zip(starts[:n].tolist(), ends[self.least - 1 :].tolist(), strict=False)]
            stop = ends[self.least - 1 : self.least - 1 + n] if window else ends[-1:]
            keys.append(last << np.uint64(32) | np.array(prefix, np.uint64))
            at.append(base + starts[:n])
            size.append(stop - starts[:n])
            words.append(np.full(n, window or len(own)))
            items.append(np.full(n, names.setdefault(item, len(names))))
            seen = len(block) if window else self.far  # blocks that some window holds within its first `least` words
            blocks.append(np.array(block[:seen], np.uint64))
            jumps.append(np.maximum(0, self.far - 1 - np.arange(seen)))
            base += len(body) + 1
        join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        self.body, self.items = b" ".join(body for _, body in texts), [*names]
        keys, at, size, words, items = join(keys, np.uint64), join(at, np.uint32), join(size, np.uint32), join(words, np.uint8), join(items, np.int32)
        order = np.lexsort((at, items, keys))
        again = np.r_[False, (np.diff(keys[order]) == 0) & (np.diff(items[order]) == 0)] if len(order) else np.empty(0, bool)
        for i in np.flatnonzero(again).tolist():  # a window that an item repeats counts once
            a, b = order[i - 1], order[i]
            again[i] = self.body[at[a] : at[a] + size[a]] == self.body[at[b] : at[b] + size[b]]
        order = order[~again]
        self.keys, self.at, self.size, self.words, self.owner = keys[order], at[order], size[order], words[order], items[order]
        blocks, jumps = join(blocks, np.uint64), join(jumps, np.uint8)
        self.mask = (1 << max(10, int(4 * len(np.unique(blocks)) + 1).bit_length())) - 1
        shift = np.full(self.mask + 1, self.far, np.uint8)
        np.minimum.at(shift, (blocks & np.uint64(self.mask)).astype(np.int64), jumps)
        self.shift = shift.tobytes()

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, str | None]]:
        """(start, end, item) of every occurrence of a window, by start."""
        n, least, pair, shift, mask, keys, total = len(words), self.least, self.block == 2, self.shift, self.mask, self.keys, len(self.keys)
        at = least
        while at <= n:
            block = crc32(words[at - 1], crc32(words[at - 2])) if pair else crc32(words[at - 1])
            jump = shift[block & mask]
            if jump:
                at += jump
                continue
            start = at - least
            key = block << 32 | crc32(b" ".join(words[start:at]))
            i = int(keys.searchsorted(np.uint64(key)))
            while i < total and keys[i] == key:
                end, a = start + int(self.words[i]), int(self.at[i])
                if b" ".join(words[start:end]) == self.body[a : a + int(self.size[i])]:
                    yield start, end, self.items[self.owner[i]]
                i += 1
            at += 1


def matchers(texts: Iterable[tuple[str | None, bytes]], window: int = WINDOW) -> list[Matcher]:
    """Matchers of pieces of items: one for full windows, one for shorter items."""
    full, short = [], []
    for item, body in texts:
        if body:
            (full if body.count(b" ") + 1 >= window else short).append((item, body))
    return [m for m in (full and Matcher(full, window), short and Matcher(short, None)) if m]


def item_pieces(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, body): the words of every item joined by blanks, long items in pieces that overlap by a window less a word."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in pieces(batch, 64):
                items, bodies = [], []
                for item, text in zip(run.column("item").to_pylist(), texts_of(run, "text"), strict=True):
                    words = alnum_words(text)
                    for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                        items.append(item)
                        bodies.append(b" ".join(words[at : at + PIECE_WORDS + window - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(bodies, pa.binary())], ["item", "body"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(over, "item string, body binary")


def search(words: list[bytes], tables: list[Matcher]) -> tuple[list[int], set[str]]:
    """Positions of words inside any occurrence, and the items with occurrences."""
    hit: set[int] = set()
    items: set[str] = set()
    for m in tables:
        done = 0
        for start, end, item in m.find(words):
            hit.update(range(max(start, done), end))
            done = max(done, end)
            if item is not None:
                items.add(item)
    return sorted(hit), items


def _scan(docs: DataFrame, tables, last: bool) -> DataFrame:
    """Adds one block's hits to those that docs carry."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [t.value for t in tables]
        for batch in batches:
            for run in pieces(batch):
                kept = [c for c in run.schema.names if not last or c != "text"]
                words, hits, ids = [], [], []
                for text, hit, items in zip(texts_of(run, "text"), run.column("hits").to_pylist(), run.column("items").to_pylist(), strict=True):
                    own = alnum_words(text)
                    more, found = search(own, held)
                    words.append(len(own))
                    hits.append(sorted({*(hit or ()), *more}))
                    ids.append(sorted({*(items or ()), *found}))
                new = {"n_words": pa.array(words, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(ids, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else run.column(c) for c in kept], kept)

    schema = docs.drop("text").schema if last else docs.schema
    return docs.mapInArrow(over, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """(id, n_words, hits, items, keep...): a row for each row of docs, with the positions of hit words and the sorted
    ids, as strings, of items that occur. keep: columns to carry along; one named like those or "text" is an error.

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A text that is null or holds no
    word has no hits; an item without words has no window; an item whose id is null marks words but isn't listed;
    repeated items count once, repeated rows of docs are rows. Texts of any length are searched whole, one at a time; items
    of any length are cut into pieces. Empty tables give no rows or no hits. Beyond block_bytes of benchmark text the rows are
    staged once for each block, which costs their size in the shared folder.
    """
    spark = docs.sparkSession
    items = item_pieces(benchmark, item_col, item_text, window)
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    keep = carried(keep, "id", "text", "n_words", "hits", "items")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items"), *keep)
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("body"), F.lit(blocks)) == k)
        tables = [Shared(spark, m) for m in matchers(((r["item"], bytes(r["body"])) for r in own.toLocalIterator()), window)]  # a block
        before, rows = rows, _scan(rows, tables, k + 1 == blocks)
        if k + 1 < blocks:
            rows = staged(rows, "decontaminate")
            if k:
                discard(before)
    return rows


def summary(found: DataFrame) -> DataFrame:
    """Counts and the verdict: contaminated if words are hit and they are a twentieth of all or more."""
    return found.select(
        "id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join("items", ",").alias("listed"),
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
