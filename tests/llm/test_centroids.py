"""Exact clustering against plain integers."""

import hashlib
import math

import numpy as np
import pytest

from shelfrank.llm import centroids


def plain(rows, k, rounds, scale=64, dimensions=64):
    """The contract, in Python integers."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    now = [x for _, x in sorted((name(i), x) for i, x in kept)][:k]
    apart = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min(range(len(now)), key=lambda c: (apart(x, now[c]), c))
    for _ in range(rounds):
        placed = [(nearest(x), x) for _, x in kept]
        for c in range(len(now)):
            own = [x for at, x in placed if at == c]
            if own:
                now[c] = [sum(d) // len(own) for d in zip(*own, strict=True)]
    told = [(i, c := nearest(x), apart(x, now[c]), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, x in kept]
    of = {c: sum(t[2] for t in told if t[1] == c) for c in range(len(now))}
    return sorted(((i, c, d, of[c], sum(of.values()), h) for i, c, d, h in told), key=repr)


def run(spark, rows, **how):
    typed = [(i, None if v is None else [None if c is None else float(c) for c in v], i, 1.0) for i, v in rows]
    df = spark.createDataFrame(typed, "vec_id long, embedding array<float>, cluster long, distance double").repartition(5)
    return sorted((tuple(r) for r in centroids.cluster(df, **how).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.02, 0.4, 300.0])
def test_equals_plain_integers(spark, spread):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(64) * spread).astype(np.float32).tolist()) for i in range(400)]
    rows += [(None, rows[3][1]), (9, rows[9][1]), (9, rows[9][1]), (9, rows[10][1])] + [(500 + i, rows[0][1]) for i in range(40)]
    rows += [(600, None), (601, []), (602, [0.0] * 63), (603, [math.nan] * 64), (604, [None] * 64), (605, [math.inf] + [0.0] * 63), (606, [0.0] * 64)]
    assert run(spark, rows) == plain(rows, 16, 3)


def test_ties_and_few_rows(spark):
    box = [(i, [float(i >> b & 1) for b in range(4)]) for i in range(16)] * 3
    assert run(spark, box, k=6, dimensions=4, scale=2) == plain(box, 6, 3, 2, 4)
    few = [(1, [0.5] * 64), (1, [0.5] * 64), (2, [-0.01] * 64)]
    assert run(spark, few) == plain(few, 16, 3)
    assert run(spark, []) == run(spark, [(1, None)]) == []


def test_screen_never_loses_the_nearest():
    rng = np.random.default_rng(1)
    for size in (2, 50, 9_000, 1 << 26):
        points = rng.integers(-size, size, (600, 64))
        middles = points[:16] + rng.integers(-1, 2, (16, 64))
        middles[5] = middles[2]  # a tie for whatever is nearest to either
        points = np.vstack([points, middles, middles + 1])
        found, again = centroids.screened(points, middles)
        wanted = [min(range(16), key=lambda c: (sum((int(a) - int(b)) ** 2 for a, b in zip(x, middles[c], strict=True)), c)) for x in points]
        assert found.tolist() == wanted
        assert 0 < again < points.shape[0] * 16


def test_most_are_decided_by_the_screen():
    rng = np.random.default_rng(2)
    points = rng.integers(-64, 64, (5000, 64))
    assert centroids.screened(points, points[:16].copy())[1] < 100


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="a long may not hold"):
        run(spark, [(1, [2.0**20] * 64)])
