"""Exact centroid clustering of vectors, screened in single precision.

Vectors become integers, so that every distance, sum and centroid is exact. A task multiplies its vectors with all
centroids in float32, and turns each product into an interval that holds the true value, by the rounding-error bound of a
dot product in any order of summation. Centroids whose interval lies above another one's upper end can't be the nearest.
Where more than one is left, the distances are computed again in 64-bit integers and the lowest number wins ties.

A round moves one row a cluster and task: counts and sums are made where the vectors lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components are integers of at most this size: the squared distance of 64 of them then fits a long.
LARGEST = 1 << 26
#: Vectors that are compared at once.
BATCH = 8192

#: Unit roundoff of single precision, and of double precision.
_U32, _U64 = 2.0**-24, 2.0**-53


def screened(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of the nearest centroid of each point, how many distances had to be computed again). Both are int64.

    With |x|^2 left out, as it is the same for all centroids, s = |c|^2 - 2 x.c decides. The float32 product of n terms errs
    by at most g(n + 2) |x| |c|, g(k) = k u / (1 - k u): n products and sums in any order, and two roundings of the inputs.
    """
    n, d = points.shape
    x32, c32 = points.astype(np.float32), centroids.astype(np.float32)
    product = (x32 @ c32.T).astype(np.float64)
    # Norms in double precision, rounded up by more than their own error.
    norm = lambda a: np.sqrt(np.einsum("ij,ij->i", a.astype(np.float64), a.astype(np.float64))) * (1 + (d + 4) * _U64)
    of_points, of_centroids = norm(points), norm(centroids)
    gamma = (d + 2) * _U32 / (1 - (d + 2) * _U32)
    squares = np.einsum("ij,ij->i", centroids, centroids).astype(np.float64)
    near = squares - 2 * product
    slack = 2 * gamma * np.outer(of_points, of_centroids)
    slack = slack * (1 + 8 * _U64) + 8 * _U64 * (squares + 2 * np.abs(product))  # and the roundings made here
    upper = (near + slack).min(axis=1)
    open_ = near - slack <= upper[:, None]
    best = open_.argmax(axis=1)
    rows = np.flatnonzero(open_.sum(axis=1) > 1)
    if not len(rows):
        return best, 0
    at, which = np.nonzero(open_[rows])
    gap = points[rows[at]] - centroids[which]
    exact = np.einsum("ij,ij->i", gap, gap)
    # Candidates stand in ascending order of their numbers, so the first of a row's least distances has the lowest.
    order = np.lexsort((which, exact, at))
    first = order[np.r_[True, np.diff(at[order]) > 0]]
    best[rows] = which[first]
    return best, len(at)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, x): the vectors of so many finite components, as integers floor(scale * component)."""
    v = F.col(vector_col)
    usable = (F.size(v) == dimensions) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    beyond = F.raise_error(F.lit(f"components of integers beyond {LARGEST} make distances that a long may not hold"))
    x = F.transform(v, lambda c: F.when(F.abs(F.lit(float(scale)) * c.cast("double")) < float(LARGEST), whole(c)).otherwise(beyond.cast("long")))
    return vectors.where(v.isNotNull() & usable).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def draw(vec_id: Column) -> Column:
    """The hash that picks the first centroids; a missing id counts as the empty text."""
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def _points(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("x")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; those without vectors stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for run in _runs(batches):
            points = _points(run)
            best, _ = screened(points, centroids)
            counts += np.bincount(best, minlength=len(centroids))
            for k in np.unique(best):
                total[k] += points[best == k].sum(axis=0)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(held, pa.int32()), "n": pa.array(counts[held], pa.int64()), "total": pa.array(list(total[held]), pa.list_(pa.int64()))})

    partial = kept.select("x").mapInArrow(sums, "cluster int, n long, total array<long>")
    each = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():  # a row a centroid
        out[row["cluster"]] = [int(row[f"t{i}"]) // row["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): a row for each vector that takes part.

    Vectors that are null, of another number of components, or hold null or non-finite ones take no part. Components are
    floored to integers after scaling. Centroids start as the k vectors of the smallest hash of their ids (of one id, the
    one of the smaller components first), are moved `rounds` times to the floored means of their vectors, and number the
    clusters. Equal distances go to the smaller number, so of equal centroids the later ones stay as they are. Fewer than k
    vectors are as many centroids; without any the result is empty. Repeated rows and missing ids are rows like any other;
    further columns, of any names, are never read. A component of 2^26 or more after scaling is an error, as a long may not
    hold its distances.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col, dimensions, scale)
    starts = kept.select(draw(F.col("vec_id")).alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    centroids = np.array([r["x"] for r in starts], np.int64).reshape(len(starts), dimensions)
    if not len(centroids):
        return spark.createDataFrame([], _RESULT.replace("vec_id long", f"vec_id {kept.schema['vec_id'].dataType.simpleString()}"))
    for _ in range(rounds):
        centroids = _moved(kept, centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            points = _points(run)
            best, _ = screened(points, centroids)
            gap = points - centroids[best]
            yield pa.RecordBatch.from_arrays([run.column("vec_id"), pa.array(best, pa.int32()), pa.array(np.einsum("ij,ij->i", gap, gap), pa.int64())], names=["vec_id", "cluster", "distance"])

    # Staged, so that vectors aren't compared once for the sums and once for the rows.
    found = staged(kept.mapInArrow(nearest, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    told = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    named = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
