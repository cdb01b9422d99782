"""Mixes: sizes and targets against plain Python, balance, expectations, and what mustn't matter."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from shelfrank.llm import mixing


def plain_targets(size_of, weights=(5, 2, 1), most=3):
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    whole, full = Fraction(sum(size_of.values())), set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: float(most * size_of[s]) for s in names}
        share = (whole - sum(most * size_of[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > most * size_of[s]}
        if not over:
            return {s: float(most * size_of[s] if s in full else weight[s] * share) for s in names}
        full |= over


def check(rows, found, slack):
    """found: (id, size, source_size, target, taken, copies) rows of the documents (id, text, source)."""
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    source_of, size_of = {}, Counter()
    for i, t, s in rows:
        source_of[i] = s
        size_of[s] += size(t)
    wanted = plain_targets(size_of)
    assert Counter((r[0], r[1]) for r in found) == Counter((i, size(t)) for i, t, _ in rows)
    taken, copies, number = Counter(), Counter(), Counter()
    for i, n, source_size, target, words, times in found:
        s = source_of[i]
        assert source_size == size_of[s] and target == pytest.approx(wanted[s], rel=1e-12)
        assert words == times * n <= 3 * n
        share = target / source_size if source_size else 0
        assert int(share + 1e-9) <= times <= int(share + 1 - 1e-9) or source_size == 0
        taken[s] += words
        copies[s] += times
        number[s] += 1
    for s, n in number.items():
        assert abs(taken[s] - wanted[s]) <= slack, (s, taken[s], wanted[s])
        if size_of[s]:
            assert abs(copies[s] - n * wanted[s] / size_of[s]) <= 20
    return taken


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, s, 0, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, target string").repartition(parts, "text")
    return sorted((tuple(r) for r in mixing.mix(df).collect()), key=repr)


def documents(seed=1, n=1500):
    rng = random.Random(seed)
    names = ["b", "a", "ä", None, "c", "Z"]
    rows = []
    for i in range(n):
        s = "b" if rng.random() < 0.33 else rng.choice(names)
        rows.append((i, " ".join(["w"] * int(rng.lognormvariate(3, 1.3))), s))
    rows += [(5000, "long " * 3_000, "b"), (5001, None, "a"), (5002, "", "c"), (5003, " \n", "empty"), (5004, "x", "tiny")]
    return rows


def test_targets_and_balance(spark):
    rows = documents()
    found = run(spark, rows)
    check(rows, found, 3)
    assert run(spark, rows, 7) == found  # however rows are split


def test_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = documents(2)
    check(rows, run(spark, rows), 3)


def test_equal_rows_and_missing_ids(spark):
    rows = [(None, "one two three", "s")] * 700 + [(4, "a b c d", "s")] * 300 + [(k, "word " * (k % 40), "t") for k in range(10, 400)]
    found = run(spark, rows)
    assert run(spark, rows, 5) == found
    size_of = {"s": 700 * 3 + 300 * 4, "t": sum(k % 40 for k in range(10, 400))}
    wanted = plain_targets(size_of)
    taken = defaultdict(int)
    for i, _, _, _, words, _ in found:
        taken["t" if i is not None and i >= 10 else "s"] += words
    assert all(abs(taken[s] - wanted[s]) <= 4 for s in wanted)


def test_small_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None), (2, "", "a")]) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]
    assert run(spark, [(1, "a b", "s")]) == [(1, 2, 2, 2.0, 2, 1)]
    rows = [(k, "w " * 10, "a") for k in range(2)] + [(k, "w " * 10, "b") for k in range(10, 100)]
    check(rows, run(spark, rows), 10)  # a stops at three times its words, and b takes the rest


def test_one_very_long_text(spark):
    rows = [(k, "w " * (k % 50), "s") for k in range(200)] + [(900, "w " * 200_000, "s"), (901, "w", "t")]
    found = {r[0]: r for r in run(spark, rows)}
    assert found[900][1] == 200_000 and found[900][4] in (0, 200_000, 400_000, 600_000)
    assert len(found) == 202


def test_capped_sources_pass_the_excess_on(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 5000, "e": 3, "f": 0, None: 700}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(4)
    found = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert found == pytest.approx(plain_targets(sizes), rel=1e-12)
    assert found["a"] == 30.0 and sum(found.values()) == pytest.approx(sum(sizes.values()))


def test_flights_keep_totals_and_expectations():
    rng = np.random.default_rng(3)
    size = rng.integers(32, 64, 40)
    start = np.full(40, 0.37)
    mean = np.zeros(40)
    for seed in range(1500):
        p = mixing.stepped(start, size, np.random.default_rng(seed), 2)
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert p.sum() == pytest.approx(start.sum()) and (p * size).sum() == pytest.approx((start * size).sum())
        mean += p / 1500
    assert np.abs(mean - 0.37).max() < 0.06


def test_landing_takes_the_nearest_subset():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 11))
        p, size = rng.uniform(0.05, 0.95, n), rng.integers(0, 2000, n)
        out = mixing.landed(p, size, np.random.default_rng(0))
        assert set(out) <= {0.0, 1.0}
        sums = [sum(int(size[k]) for k in range(n) if m >> k & 1) for m in range(1 << n)]
        wanted = (p * size).sum()
        assert abs((out * size).sum() - wanted) == pytest.approx(min(abs(s - wanted) for s in sums))
    assert abs((mixing.landed(np.full(70, 0.5), np.arange(70) + 1, np.random.default_rng(0)) * (np.arange(70) + 1)).sum() - 1242.5) <= 1
