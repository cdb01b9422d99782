import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.llm import neighbours, shards


def brute(rows, k=20, every=20):
    out = {}
    for q, x in rows:
        if q % every == 0:
            near = sorted((-float(np.dot(x, y)), v) for v, y in rows if v != q)[:k]
            out[q] = [v for _, v in near]
    return out


def search(spark, rows, target=1.0, **how):
    """Exact by default, for what is told of ties, copies and order."""
    df = spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], 1) for i, x in rows], "vec_id long, embedding array<float>, rank int")
    out = {}
    for r in sorted(neighbours.search(df, target=target, **how).collect()):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.5, 3)).astype(np.float32).astype(float)) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(30)]  # ties: one vector many times, queries among them
    found = search(spark, [*rows, (400, None), (401, []), (402, [0.0] * 8), (403, [math.nan] * 8), (404, [None] * 8), (405, [1.0] * 3), (420, [math.inf] * 8)])
    wanted = brute(rows)
    assert {q: [v for _, v, _ in r] for q, r in found.items()} == wanted
    at = dict(rows)
    for q, r in found.items():
        assert [k for k, _, _ in r] == list(range(1, 21))
        assert all(s == pytest.approx(float(np.dot(at[q], at[v])), abs=1e-12) for _, v, s in r)


def test_repeated_rows_take_no_neighbours_place(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).astype(np.float32).astype(float)) for i in range(100)]
    rows += [rows[20]] + [rows[40]] * 25 + [rows[7]] * 2
    found, wanted = search(spark, rows), brute(rows)
    assert set(found) == set(wanted)
    for q, r in found.items():
        answers = sum(v == q for v, _ in rows)  # each copy of an asking row is answered
        assert len(r) == 20 * answers
        assert [v for _, v, _ in r][::answers] == wanted[q], q


def test_few_and_none(spark):
    assert {q: [v for _, v, _ in r] for q, r in search(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]).items()} == {0: [1, 2]}
    assert search(spark, []) == {} and search(spark, [(0, None)]) == {} and search(spark, [(0, [1.0])]) == {}


def test_recall_over_lists_and_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 50)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 20)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    rows = [(i, c / np.linalg.norm(c)) for i, c in enumerate(centres[rng.integers(0, 12, 3000)] + 0.4 * rng.standard_normal((3000, 24)))]
    rows = [(i, x.astype(np.float32).astype(float)) for i, x in rows]
    found, wanted = search(spark, rows, neighbours.TARGET), brute(rows)
    assert found.keys() == wanted.keys() and all(len(r) == 20 for r in found.values())
    hits = sum(len({v for _, v, _ in found[q]} & set(wanted[q])) for q in wanted)
    assert hits / (20 * len(wanted)) >= 0.9


def test_recall_on_vectors_without_clusters(spark):
    """Nothing but noise: the number of probed lists has to follow."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 48))
    rows = [(i, v.astype(np.float32).astype(float)) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    found, wanted = search(spark, rows, neighbours.TARGET), brute(rows)
    hits = sum(len({v for _, v, _ in found[q]} & set(wanted[q])) for q in wanted)
    assert hits / (20 * len(wanted)) >= 0.9 and all(len(r) == 20 for r in found.values())


def test_small_tables_are_searched_like_large_ones(spark):
    """Lists and probes from the first rows on: not all lists, yet nine in ten neighbours; and always k of them."""
    rng = np.random.default_rng(11)
    rows = [(4 * i, rng.standard_normal(64).astype(np.float32).astype(float)) for i in range(500)]  # a fifth of them asks
    index = neighbours.Index(np.array([x for _, x in rows]), 500, max(np.linalg.norm(x) for _, x in rows))
    assert len(index.centres) == 44 and index.probes < 44
    found, wanted = search(spark, rows, neighbours.TARGET), brute(rows)
    hits = sum(len({v for _, v, _ in found[q]} & set(wanted[q])) for q in wanted)
    assert len(wanted) == 100 and hits / (20 * len(wanted)) >= 0.9 and all(len(r) == 20 for r in found.values())


def test_very_long_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.standard_normal(3000).astype(np.float32).tolist(), 1, 2.0, "x", [0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double, rep string, vec array<double>")
    found = neighbours.search(df, target=1.0).collect()
    wanted = brute([(r[0], np.array(r[1])) for r in rows])
    assert {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in wanted} == wanted


def test_a_sure_scan_keeps_all_within_the_limit():
    rng = np.random.default_rng(13)
    x, q = rng.standard_normal((2000, 65)).astype(np.float32), rng.standard_normal((4, 65)).astype(np.float32)
    far = ((q[:, None, :].astype(float) - x[None]) ** 2).sum(2)
    limits = np.sort(far, 1)[:, 40].astype(np.float32) * np.float32(1.0001)
    i, j = neighbours.scan(x, q, limits, sure=True)
    assert {(a, b) for a in range(4) for b in np.argsort(far[a])[:41]} <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) < 200


def test_scan_abandons_but_keeps_the_nearest():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((5000, 65)).astype(np.float32), rng.standard_normal((3, 65)).astype(np.float32)
    far = ((q[:, None, :] - x[None]) ** 2).sum(2)
    limits = np.sort(far, 1)[:, 20]
    i, j = neighbours.scan(x, q, limits * 1.0001)
    assert len(i) <= 70 and (far[i, j] <= limits[i] * 1.001).all()
    wanted = {(a, b) for a in range(3) for b in np.argsort(far[a])[:20]}
    assert len(wanted & set(zip(i.tolist(), j.tolist(), strict=True))) >= 0.95 * len(wanted)
    every = neighbours.scan(x, q, np.full(3, np.inf, np.float32))
    assert len(every[0]) == 15_000


@pytest.fixture(scope="module")
def assigned(docs):
    return shards.assign(docs, 24).collect()


def test_every_row_has_a_shard_and_a_slot(assigned, awkward):
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: zlib.crc32((t or "").encode())
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["id"], r["size"], r["text_crc32"]) for r in assigned), key=key) == sorted(((d, size(t), crc(t)) for d, t in awkward), key=key)
    by = {}
    for r in assigned:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in assigned if r["id"] == 7}) == 1 and len({r["shard"] for r in assigned if r["id"] is None}) == 1


def test_no_rows(no_docs):
    assert shards.assign(no_docs, 24).count() == 0


def placed(spark, tree, n=20_000):
    return [r[0] for r in spark.range(n).select(shards.place(F.col("id"), tree)).collect()]


@pytest.mark.parametrize("n", [24, 25, 30])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    before, after = placed(spark, shards.topology(n)), placed(spark, shards.topology(n + 1))
    assert all(a == b or b == n for a, b in zip(before, after, strict=True))
    assert sum(b == n for b in after) / len(after) == pytest.approx(1 / (n + 1), rel=0.15)


def test_shares_follow_weights_and_moves_stay_in_their_subtree(spark):
    tree, heavier = shards.topology(24), shards.topology(24)
    heavier.children[1].children[0].children[2].weight = 3.0
    before, after = placed(spark, tree), placed(spark, heavier)
    assert all(abs(before.count(s) / len(before) - 1 / 24) < 0.008 for s in range(24))
    into = {s for a, s in zip(before, after, strict=True) if a != s}
    assert into <= set(range(8, 16))  # only the heavier region gains
    assert after.count(10) / len(after) == pytest.approx(3 / 26, rel=0.12)


def test_place_matches_a_plain_descent(spark):
    """The same draws, descended one node at a time."""
    tree = shards.topology(10, base=8)
    found = placed(spark, tree, 50)
    names, todo = [], [tree]
    while todo:
        at = todo.pop()
        names += [(c.name, float(c.total())) for c in at.children]
        todo += at.children
    drawn = {}
    for name, weight in names:
        rows = spark.range(50).select("id", shards.draw(F.col("id"), F.lit(name), F.lit(weight)).alias("d")).collect()
        drawn |= {(r["id"], name): r["d"] for r in rows}
    for key, shard in enumerate(found):
        at = tree
        while at.children:
            at = max(at.children, key=lambda c: drawn[key, c.name])
        assert at.shard == shard
