"""Connected components of an edge table by alternating stars, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _stars(edges: DataFrame, label: str) -> DataFrame:
    """One large and one small star operation, staged.

    Least neighbours are staged before they are joined back. Both sides of a join are then dealt out for it, so that
    adaptive execution can split a hub's many edges among tasks.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
    # Each node hands its least neighbour to its larger neighbours.
    large = staged(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label)
    # Each node and its smaller neighbours hang on the least of them.
    below = staged(large.groupBy("a").agg(F.min("b").alias("m")), label)
    inner = large.join(below, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    small = staged(inner.union(below.select("a", F.col("m").alias("b"))).distinct(), label)
    for done in (least, large, below):
        discard(done)
    return small


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node that it reaches.

    edges: columns a, b of one ordered type; direction, loops and repeats don't matter. A row with a null
    end is no link. Neighbours are never collected: minima are aggregated before the shuffle and joined back.
    """
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(flat, label)
    state = _state(now)
    while state[0]:
        after = _stars(now, label)
        new = _state(after)
        discard(now)
        now = after
        if new == state:
            break
        state = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
