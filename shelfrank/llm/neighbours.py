"""Nearest neighbours by inner product: inverted lists scanned by adaptive dimension sampling.

Vectors get one more coordinate so that all have the same length; then the largest inner product is the smallest
distance. They are rotated at random, so that any first t coordinates are a fair sample of the distance. A query
starts with a limit: the distance of its 2 (K + 1)-th nearest among a bounded sample, which its K + 1 nearest of all
can't exceed. The nearest lists are scanned first; what they give tightens the limit for the rest of the probed lists,
so that limits follow the whole table and not the sample. Within each probed list the columns are read in blocks; after
each, a candidate whose partial distance, scaled up, exceeds the limit by more than chance allows is abandoned. What
survives is ranked by its inner product in double precision on the original vectors.

How many lists are probed is measured on the sample: as many as hold TARGET of its own vectors' true neighbours.
Neighbours among all vectors are nearer than among a sample, so they are found at least as often. A query that finds
fewer than it should is asked again in every list; there a candidate is abandoned only once its partial distance alone
exceeds the sample's limit, within which there are enough, so that the second answer is exact. A target of 1 asks all
queries like that.

Equal vectors are stored once, with the K + 1 smallest of their ids: no result can need more of them. Lists that
outgrow CELL_ROWS are dealt into cells, and so are a list's queries, so that no task depends on one list's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Shared, staged

K = 20
#: What a vector holds of its rows.
IDS = "array<struct<id:bigint,copies:int>>"
#: The bounded sample that centres, limits and the number of probes come from, in rows and in bytes, and the queries that
#: probes are set by.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS, TRIALS = 20_000, 64 << 20, 8, 400
#: Lists for each root of the number of vectors, with so many sample rows for each at the least.
LISTS_A_ROOT, SAMPLE_A_LIST = 2, 4
#: The share of true neighbours in the probed lists, and the share of those lists that is scanned first.
TARGET, FIRST = 0.94, 0.125
CELL_ROWS, CELL_QUERIES = 8192, 8192
#: Columns read at once, and how many deviations of the scaled partial distance a candidate is granted.
BLOCK_COLUMNS, DOUBT = 16, 1.5
#: Below this share of live candidates single pairs are followed instead of whole blocks.
SPARSE = 0.15


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: no null, no zero vector, no null or non-finite component."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(F.coalesce(sound, F.lit(False)) & F.exists("vec", lambda x: x != 0))


class Index:
    """The rotation, the centres and the common length; of fixed size whatever the number of vectors."""

    def __init__(self, sample: np.ndarray, n: int, longest: float, seed: int = 5, target: float | None = None):
        rng = np.random.default_rng(seed)
        self.longest, dim = longest, sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        x = self.lift(sample)
        lists = int(max(1, min(LISTS_A_ROOT * round(np.sqrt(n)), len(x) // SAMPLE_A_LIST)))
        self.centres = x[rng.permutation(len(x))[:lists]]
        for _ in range(ROUNDS if lists > 1 else 0):
            own = self.nearest(x, 1)[:, 0]
            total = np.zeros_like(self.centres)
            np.add.at(total, own, x)
            n_own = np.bincount(own, minlength=lists)
            full = n_own > 0
            self.centres[full] = total[full] / n_own[full, None]
        self.sample = x
        self.exact = (target or TARGET) >= 1
        self.probes = len(self.centres) if self.exact else self.measured_probes(sample, target or TARGET)

    def measured_probes(self, sample: np.ndarray, target: float) -> int:
        """How many lists hold the target of the true K nearest, for queries from the sample among the sample."""
        if len(self.centres) == 1 or len(sample) < 2:
            return 1
        lists = self.nearest(self.sample, 1)[:, 0]
        asked = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
        near = sample[asked] @ sample.T
        near[np.arange(len(asked)), asked] = -np.inf
        top = np.argpartition(-near, min(K, len(sample) - 1) - 1, 1)[:, :K]
        order = self.nearest(self.lift(sample[asked], query=True), len(self.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        ranks = np.sort(np.take_along_axis(place, lists[top], 1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1

    def limits(self, lifted: np.ndarray, k: int) -> np.ndarray:
        """For each query a squared distance within which at least k vectors lie; infinite if the sample is smaller."""
        if len(self.sample) < k:
            return np.full(len(lifted), np.inf, np.float32)
        out = []
        size = (self.sample**2).sum(1)
        for at in range(0, len(lifted), 256):
            own = lifted[at : at + 256]
            near = (own**2).sum(1)[:, None] + size[None, :] - 2 * own @ self.sample.T
            out.append(np.partition(near, k - 1, 1)[:, k - 1])
        return np.concatenate(out) * np.float32(1 + 1e-4) + np.float32(1e-5) if out else np.empty(0, np.float32)

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors with the coordinate that makes all lengths equal (0 for a query)."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.c_[x, rest].astype(np.float32) @ self.rotation

    def nearest(self, lifted: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the n nearest centres, nearest first."""
        out = []
        half = (self.centres**2).sum(1) / 2
        for at in range(0, len(lifted), 1024):
            near = half[None, :] - lifted[at : at + 1024] @ self.centres.T
            own = np.argpartition(near, n - 1, 1)[:, :n] if n < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
            out.append(np.take_along_axis(own, np.argsort(np.take_along_axis(near, own, 1), 1, kind="stable"), 1))
        return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def scan(x: np.ndarray, q: np.ndarray, limits: np.ndarray, sure: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(queries, rows) of the pairs that may be within the queries' limits. x, q: rotated vectors. sure: pairs are
    abandoned only for what is certain."""
    dim = x.shape[1]
    part, dead, pairs = np.zeros((len(q), len(x)), np.float32), np.zeros((len(q), len(x)), bool), None
    for at in range(0, dim, BLOCK_COLUMNS):
        t = min(at + BLOCK_COLUMNS, dim)
        xb, qb = x[:, at:t], q[:, at:t]
        allowed = limits * (1 if sure or t == dim else (1 + DOUBT / np.sqrt(t)) ** 2 * t / dim)
        if pairs is None:
            part += (qb**2).sum(1)[:, None] + (xb**2).sum(1)[None, :] - 2 * qb @ xb.T
            dead |= part > allowed[:, None]  # the hypothesis that the whole distance is within the limit is rejected
            if t == dim or dead.mean() > 1 - SPARSE:
                pairs = np.nonzero(~dead)
                part = part[pairs]
        else:
            i, j = pairs
            part = part + ((qb[i] - xb[j]) ** 2).sum(1)
            fair = part <= allowed[i]
            pairs, part = (i[fair], j[fair]), part[fair]
    return pairs


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.compute.list_flatten(column).to_numpy()
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_every: int = 20, k: int = K, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row whose id is divisible by query_every.

    A row is no candidate for itself. Ties go to the smaller id. Vectors whose dimension isn't the commonest (of equally
    common ones the smallest), null ids, and vectors that `usable` drops take no part. Every row counts by itself, so
    a repeated id is a candidate as often as it stands, but never for its own id. Other columns, whatever their names,
    are never read. No usable vector gives no row. target: the share of true neighbours to look for; 1 is exact.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vec") == common["dim"])
    # The k + 1 smallest distinct ids of a vector, each with its number of copies, of which k are enough.
    copies = rows.groupBy("vec", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    numbered = copies.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = staged(numbered.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("id", "copies"))).alias("ids")).withColumn("rep", F.col("ids")[0]["id"]), "nn-vectors")
    asked = rows.where(F.col("id") % query_every == 0)
    queries = staged(asked.join(distinct.select("vec", "rep"), "vec").select(F.col("id").alias("query_id"), "rep"), "nn-queries")
    n, longest = distinct.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()
    rows_held = max(SAMPLE_A_LIST, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * common["dim"])))
    sample = distinct.select("vec").orderBy(F.xxhash64("rep")).limit(rows_held).toPandas()["vec"]
    index = Index(np.array(sample.tolist(), np.float64), n, longest, target=target)
    held = Shared(spark, index)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(b["vec"].tolist(), np.float64)
                yield b.assign(list=held.value.nearest(held.value.lift(x), 1)[:, 0].astype(np.int32))

    stored = staged(distinct.mapInPandas(listed, f"vec array<double>, ids {IDS}, rep long, list int"), "nn-lists")
    sizes = np.zeros(len(index.centres), np.int64)
    for r in stored.groupBy("list").count().collect():  # one number a list
        sizes[r["list"]] = r["count"]
    sizes_held = spark.sparkContext.broadcast(sizes)

    def compare(cell: pa.Table, sure: bool) -> pa.Table:
        is_row = pa.compute.is_valid(cell.column("ids"))
        own, ask = cell.filter(is_row), cell.filter(pa.compute.invert(is_row))
        found: list[list] = [[], [], []]
        if len(own) and len(ask):
            raw, raw_q = _stack(own.column("vec")), _stack(ask.column("vec"))
            x, q, limits = held.value.lift(raw), held.value.lift(raw_q, query=True), ask.column("within").to_numpy()
            reps, asking, ids = own.column("rep").to_numpy(), ask.column("rep").to_numpy(), own.column("ids").to_pylist()
            step = max(1, (1 << 21) // len(x))
            for at in range(0, len(q), step):
                i, j = scan(x, q[at : at + step], limits[at : at + step], sure)
                scores = (raw[j] * raw_q[at + i]).sum(1)
                order = np.lexsort((reps[j], -scores, i))
                i, j, scores = i[order], j[order], scores[order]
                start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, int)
                top = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) <= k
                found[0] += asking[at + i[top]].tolist()
                found[1] += scores[top].tolist()
                found[2] += [ids[r] for r in j[top]]
        return pa.table({"rep": pa.array(found[0], pa.int64()), "score": pa.array(found[1], pa.float64()), "ids": pa.array(found[2], pa.list_(pa.struct([("id", pa.int64()), ("copies", pa.int32())])))})

    def hits(wanted: DataFrame, part: str) -> DataFrame:
        """(rep, score, vec_id, copies) of what lists give for wanted vectors (rep, least), least: a score that k + 1 of
        a vector's neighbours are known to reach. part: "first", the nearest of the probed lists; "rest" of them; "all"
        lists, for certain."""

        def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sizes, index = sizes_held.value, held.value
            first = max(1, int(index.probes * FIRST))
            for batch in batches:
                for at in range(0, len(batch), 512):
                    b = batch.iloc[at : at + 512]
                    raw = np.array(b["vec"].tolist(), np.float64)
                    x = index.lift(raw, query=True)
                    near = index.nearest(x, len(sizes))
                    place, before = np.arange(near.shape[1])[None, :], np.cumsum(sizes[near], 1) - sizes[near]
                    soon = (place < first) | (before < k + 1)
                    used = {"first": soon, "rest": ~soon & (place < index.probes), "all": np.ones_like(soon)}[part] & (sizes[near] > 0)
                    known = index.longest**2 + (raw**2).sum(1) - 2 * b["least"].to_numpy(np.float64)
                    within = np.fmin(index.limits(x, 2 * (k + 1)), (known * (1 + 1e-4) + 1e-5).astype(np.float32))
                    yield b.drop(columns="least").assign(list=[list(map(int, o[u])) for o, u in zip(near, used, strict=True)], within=within)

        sure = part == "all" or index.exact
        chosen = distinct.select("rep", "vec").join(wanted, "rep").mapInPandas(probing, "rep long, vec array<double>, list array<int>, within float")
        probed = staged(chosen.select("rep", "vec", "within", F.explode("list").alias("list")), "nn-probes")
        asking = {r["list"]: r["count"] for r in probed.groupBy("list").count().collect()}  # one number a list
        parts = lambda n, most: max(1, -(-int(n) // most))
        cut = [(i, parts(s, CELL_ROWS), parts(asking.get(i, 0), CELL_QUERIES)) for i, s in enumerate(sizes) if i in asking]
        cuts = F.broadcast(spark.createDataFrame(cut, "list int, rows int, blocks int"))  # a row a list
        to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        left = stored.join(cuts, "list").withColumn("row_cell", mine("rows")).withColumn("query_cell", to("blocks"))
        right = probed.join(cuts, "list").withColumn("query_cell", mine("blocks")).withColumn("row_cell", to("rows"))
        cells = ["list", "row_cell", "query_cell"]
        both = left.select(*cells, "rep", "vec", "ids", F.lit(None).cast("float").alias("within")).unionByName(right.select(*cells, "rep", "vec", F.lit(None).cast(IDS).alias("ids"), "within"))
        met = both.groupBy(*cells).applyInArrow(lambda cell: compare(cell, sure), f"rep long, score double, ids {IDS}")
        return met.select("rep", "score", F.explode("ids").alias("hit")).select("rep", "score", F.col("hit.id").alias("vec_id"), F.col("hit.copies").alias("copies"))

    def best(found: DataFrame) -> DataFrame:
        """(rep, near): the k + 1 nearest ids found, nearest first."""
        top = found.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
        return top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "copies"))).alias("near"))

    wanted = queries.select("rep").distinct()
    none = F.lit(None).cast("double")
    first = staged(best(hits(wanted.withColumn("least", none), "first")), "nn-first")
    again = wanted.join(first.select("rep", F.get("near", F.lit(k))["score"].alias("least")), "rep", "left")
    flat = first.select("rep", F.explode("near").alias("hit")).select("rep", "hit.score", "hit.vec_id", "hit.copies")
    lists = staged(best(flat.union(hits(again, "rest"))), "nn-found")
    enough = min(k + 1, distinct.agg(F.sum(F.size("ids"))).first()[0])
    full = lists.where(F.size("near") >= enough)
    short = staged(wanted.join(full, "rep", "left_anti"), "nn-short")
    if short.head(1):  # those for whom the probed lists hold too few within the limit
        full = full.union(best(hits(short.withColumn("least", none), "all")))
    others = F.slice(F.flatten(F.transform(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), lambda x: F.array_repeat(x, x["copies"]))), 1, k)
    out = queries.join(full, "rep").select("query_id", F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
