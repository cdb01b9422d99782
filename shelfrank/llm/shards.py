"""Shards by a hierarchical weighted hash tree.

A key descends from the root: at each node every child draws ln(u) / weight, u a hash of key and child in (0, 1), and
the largest draw wins, so children win in proportion to their weights. A draw depends on nothing but key, child and
the child's weight; where one weight grows, keys move into that child only. A tree grows by appending a region
that holds just the new shard, so whatever moves goes into the new shard and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

BASE_SHARDS, RACKS, RACK_SHARDS = 24, 2, 4
#: A shard's rows are numbered in blocks of about so many, each sorted by one task, and in so many blocks at least.
BLOCK_ROWS, LEAST_BLOCKS = 500_000, 16


@dataclass
class Node:
    name: str
    weight: float = 1.0
    children: list[Node] = field(default_factory=list)
    shard: int | None = None

    def total(self) -> float:
        return sum(c.total() for c in self.children) if self.children else self.weight


def topology(shards: int, base: int = BASE_SHARDS, racks: int = RACKS, rack_shards: int = RACK_SHARDS) -> Node:
    """Regions of racks of shards for the first base shards; each shard after those is a region of its own."""
    root = Node("root")
    for s in range(shards):
        region, rack = (s // (racks * rack_shards), s // rack_shards % racks) if s < base else (-s, 0)
        own = next((r for r in root.children if r.name == f"region{region}"), None)
        if own is None:
            root.children.append(own := Node(f"region{region}"))
        within = next((r for r in own.children if r.name == f"{own.name}/rack{rack}"), None)
        if within is None:
            own.children.append(within := Node(f"{own.name}/rack{rack}"))
        within.children.append(Node(f"{within.name}/shard{s}", 1.0, [], s))
    return root


def draw(key: Column, name: Column, weight: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, name), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.log(unit) / weight


def place(key: Column, root: Node) -> Column:
    """The shard of a key, by descending the tree. A null key has a place like any other."""
    nodes, at = [root], 0
    while at < len(nodes):
        nodes += nodes[at].children
        at += 1
    number = {id(n): i for i, n in enumerate(nodes)}
    child = lambda n: F.struct(F.lit(number[id(n)]).alias("node"), F.lit(n.name).alias("name"), F.lit(float(n.total())).alias("weight"))
    rows = F.array(*(F.array(*map(child, n.children)) if n.children else F.array(F.struct(F.lit(i).alias("node"), F.lit("").alias("name"), F.lit(1.0).alias("weight"))) for i, n in enumerate(nodes)))

    def depth(n: Node) -> int:
        return 1 + max(map(depth, n.children)) if n.children else 0

    def descend(node: Column, _: Column) -> Column:
        drawn = F.transform(F.element_at(rows, node + 1), lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["node"].alias("node")))
        return F.array_max(drawn)["node"]

    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth(root))), F.lit(0), descend)
    return F.element_at(F.array(*(F.lit(-1 if n.shard is None else n.shard) for n in nodes)), leaf + 1)


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tree: Node | None = None, grown: Node | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard): a row for each row of docs.

    size: UTF-8 bytes of the text (null: none) plus 8. slot numbers each shard's rows from 0 without gaps: rows fall
    into blocks by hash, are ordered within a block and start where the blocks before end, so no task sorts a whole
    shard; there are as many blocks as the table needs. Equal ids share a shard; rows without an id share one as well.
    Repeated rows have slots of their own. An empty table gives an empty result; other columns are never read.
    """
    tree, grown = tree or topology(shards), grown or topology(shards + 1)
    body = F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    # Staged: the texts are read once, and the row numbers, which break ties, are fixed from here on.
    placed = staged(slim.withColumns({"shard": place(F.col("id"), tree), "grown_shard": place(F.col("id"), grown)}), "shards")
    blocks = max(LEAST_BLOCKS, -(-placed.count() // (shards * block_rows)))
    rows = placed.withColumn("block", F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).cast("int"))
    sizes = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.select("shard", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "row"))
    numbered = rows.withColumn("rank", within)
    return numbered.join(sums, ["shard", "block"]).select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
