"""Mixing sources to target weights by the cube method.

A source whose target is r times its words takes each of its documents floor(r) times, and once more with a probability
that is r's fraction. Which ones is drawn by balanced sampling: the vector of probabilities moves through the null space
of the constraints, here the number of documents and the number of their words, in random steps that keep every
probability's expectation and end at the cube's faces, where a document's is 0 or 1. Any three documents have a
direction that changes neither total, so a block of documents is dealt into triples, all triples step at once, and what
is open is dealt anew until a few documents are left.

Blocks are a source's documents of about one size (between powers of two), so that none lingers because others are too
small to balance it. What blocks leave meets in further blocks, level by level, until each source has a few open documents
of each size: the landing problem, solved by the subset whose words come nearest to what is left to take. Where one
document is a large part of its source's target, no choice of the others is made to pay for it.

Everything is drawn from hashes of ids and sizes, so that runs agree, however the rows are split.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

WEIGHTS, MOST = (5, 2, 1), 3
#: About so many documents are balanced by one task at once.
BLOCK = 1024
#: Equal documents go together in runs of so many, so that none is a block of its own size.
RUN = 64
#: Open documents that a block leaves: two need not be able to step, and two more give the landing a choice.
LEFT = 4
#: Open documents that a landing problem may hold; beyond it they step on.
LANDING = 30
#: A probability so near to 0 or 1 is there.
NEAR = 1e-9


def sizes(text: Column) -> Column:
    """Words of a text; a null one has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def stepped(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int = LEFT) -> np.ndarray:
    """p after a flight: moved in the null space of document and word totals until at most `leave` are open."""
    p = np.where(p < NEAR, 0.0, np.where(p > 1 - NEAR, 1.0, p))
    open_ = np.flatnonzero((p > 0) & (p < 1))
    while len(open_) > max(leave, 1):
        if len(open_) == 2:
            # Two documents of one size can step, others can't without changing a total.
            if size[open_[0]] != size[open_[1]]:
                break
            groups = open_.reshape(1, 2)
            way = np.array([[1.0, -1.0]])
        else:
            # Neighbours by size balance each other best; the few after the last triple wait for the next deal.
            order = open_[np.lexsort((rng.random(len(open_)), size[open_]))]
            groups = order[: len(order) // 3 * 3].reshape(-1, 3)
            s = size[groups].astype(float)
            way = np.stack([s[:, 1] - s[:, 2], s[:, 2] - s[:, 0], s[:, 0] - s[:, 1]], axis=1)  # orthogonal to (1, 1, 1) and s
            even = ~way.any(axis=1)
            way[even] = (1.0, -1.0, 0.0)
            way /= np.abs(way).max(axis=1, keepdims=True)
        at = p[groups]
        with np.errstate(divide="ignore", invalid="ignore"):
            room = lambda w: np.where(w > 0, (1 - at) / w, np.where(w < 0, -at / w, np.inf)).min(axis=1)
            ahead, back = room(way), room(-way)
        step = np.where(rng.random(len(groups)) * (ahead + back) < back, ahead, -back)
        moved = at + step[:, None] * way
        p[groups] = np.where(moved < NEAR, 0.0, np.where(moved > 1 - NEAR, 1.0, moved))
        open_ = np.flatnonzero((p > 0) & (p < 1))
    return p


def landed(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for each p: of the open ones the subset whose words are nearest to what p asks of them, then the one whose
    number is. Halves of them are enumerated and joined by their sums."""
    p = stepped(p, size, rng, LANDING)
    out = np.round(p)
    some = np.flatnonzero((p > 0) & (p < 1))
    if not len(some):
        return out
    wanted, many = float((p[some] * size[some]).sum()), float(p[some].sum())

    def subsets(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, count = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for r in rows:
            words, count = np.concatenate([words, words + size[r]]), np.concatenate([count, count + 1])
        return words, count

    left, right = some[: len(some) // 2], some[len(some) // 2 :]
    (lw, lc), (rw, rc) = subsets(left), subsets(right)
    order = np.lexsort((rc, rw))
    at = np.searchsorted(rw[order], wanted - lw)
    ends = [np.clip(at + k, 0, len(order) - 1) for k in (-1, 0)]
    miss = [np.abs(lw + rw[order[e]] - wanted) for e in ends]
    off = [np.abs(lc + rc[order[e]] - many) for e in ends]
    side, row = min(((k, i) for k in (0, 1) for i in [np.lexsort((off[k], miss[k]))[0]]), key=lambda x: (miss[x[0]][x[1]], off[x[0]][x[1]]))
    mask = int(row) | int(order[ends[side][row]]) << len(left)
    out[some] = [mask >> k & 1 for k in range(len(some))]
    return out


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources in the order of their code points, null last, take
    the weights in turn and share all words by them; no target exceeds `most` times its source's words, and what is over
    is shared again by weight. Sources are numbered in blocks, so there may be any number of them."""
    last = F.col("source").isNull()
    rows = staged(totals.repartitionByRange(last, "source").select("source", "source_size", F.spark_partition_id().alias("part")), "sources")
    before = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(last, "source")) - 1
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("before") + F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    weighed = staged(rows.withColumn("at", at).join(F.broadcast(before), "part").select("source", "source_size", turn.cast("double").alias("weight")), "weights")  # a row a partition
    whole = weighed.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0
    cap = F.col("source_size") * most
    level, full = 0.0, None
    # A source whose cap lies below its share is full; what is left is shared by the others, until no more are full.
    while True:
        held = weighed.agg(F.count(F.when(cap <= F.col("weight") * level, 1)).alias("n"), F.sum(F.when(cap <= F.col("weight") * level, cap.cast("decimal(38,0)"))).alias("words"), F.sum(F.when(cap > F.col("weight") * level, F.col("weight"))).alias("weight")).first()
        if held["n"] == full or not held["weight"]:
            break
        full, level = held["n"], float(whole - (held["words"] or 0)) / held["weight"]
    return weighed.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * level).alias("target"))


def _flown(block: pa.Table, level: int, land: bool) -> pa.Table:
    """A row for each document of a block, its probability moved. Documents are put in an order of their own first, in
    which only equal ones may change places."""
    column = lambda c: block.column(c).to_numpy()
    order = np.lexsort((column("n"), column("p"), column("size"), column("h")))
    rows = block.take(pa.array(np.repeat(order, column("n")[order])))
    first = {c: block.column(c)[0].as_py() for c in ("source", "class", "block")}
    rng = np.random.default_rng(zlib.crc32(repr((level, first["source"], *(() if land else (first["class"], first["block"])))).encode()))
    p = (landed if land else stepped)(rows.column("p").to_numpy(), rows.column("size").to_numpy(), rng)
    new = {"n": pa.array(np.ones(len(p), np.int32)), "p": pa.array(p)}
    return pa.table({c: new.get(c, rows.column(c)) for c in rows.column_names if c != "block"})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id, size, source_size, target, taken, copies): a row for each row of docs.

    size: words of the text, none for a null or empty one; texts of any length are counted whole. source_size: of all rows
    of its source; target: the words that the mix takes of it. copies: how often it takes the document, and taken: its
    words times that. A null source is one of its own. Equal rows are told apart by number alone, and missing ids are ids
    like any other, so runs agree. A source without words has target 0 and no copies. An empty table gives an empty
    result; further columns are never read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), sizes(F.col(text_col)).alias("size"))
    # Texts are read once. Equal rows are counted, so that their order doesn't matter, and dealt in runs.
    units = staged(rows.groupBy("source", "id", "size").agg(F.count("*").alias("many")), "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of_source = targets(totals, weights, most).select(F.col("source").alias("of"), "source_size", "target", F.floor(share).cast("int").alias("base"), (share - F.floor(share)).alias("p"))
    shares = staged(of_source, "targets")
    # A source's documents between two powers of two; those without words are a class too.
    size_class = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(F.lit(-1)).cast("int")
    counts = units.groupBy("source", size_class.alias("class")).agg(F.sum("many").alias("n"))
    dealt = counts.join(shares.select("of", "p"), F.col("source").eqNullSafe(F.col("of"))).select("of", F.col("class").alias("of_class"), "p", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    classes = staged(dealt, "classes")
    most_blocks = classes.agg(F.max("blocks")).first()[0] or 1

    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("many") - 1) / RUN))).alias("k")
    each = units.select("source", "id", "size", "many", size_class.alias("class"), runs)
    each = each.select("source", "id", "size", "class", F.least(F.lit(RUN), F.col("many") - F.col("k") * RUN).cast("int").alias("n"), F.xxhash64("id", "size", "k").alias("h"))
    now = each.join(classes, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class"))).drop("of", "of_class")

    shape = f"source string, id {kind}, size bigint, class int, n int, h bigint, p double, blocks int"
    names = [c.split(" ")[0] for c in shape.split(", ")]
    open_ = (F.col("p") > 0) & (F.col("p") < 1)

    def flight(rows: DataFrame, level: int, land: bool) -> DataFrame:
        block = F.lit(0) if land else F.pmod(F.shiftright("h", 8 * level), F.col("blocks")).cast("int")
        groups = rows.select(*names, block.alias("block")).groupBy("source", *([] if land else ["class", "block"]))
        return staged(groups.applyInArrow(lambda block: _flown(block, level, land), shape), "flight")

    done, level = [], 0
    while True:
        moved = flight(now, level, False)
        done.append(moved.where(~open_))
        now = moved.where(open_)
        if most_blocks == 1:
            break
        most_blocks, level = -(-most_blocks * LEFT // BLOCK), level + 1
        now = now.withColumn("blocks", F.ceil(F.col("blocks") * LEFT / BLOCK).cast("int"))
    done.append(flight(now, level + 1, True))
    decided = reduce(DataFrame.union, (d.select("source", "id", "size", F.col("p").alias("more")) for d in done))
    copies = F.col("base") + F.round("more").cast("int")
    joined = decided.join(shares, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"))
