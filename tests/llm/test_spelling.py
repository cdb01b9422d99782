"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from shelfrank.llm import spelling
from shelfrank.llm.shared import staged

from ..conftest import plan_of


def one_edit(v, w):
    if len(v) == len(w):
        return sum(a != b for a, b in zip(v, w, strict=True)) == 1
    short, long = sorted((v, w), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows, shortest=7, least=2, lead=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= lead * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    return sorted((tuple(r) for r in spelling.variants(df, **how).collect()), key=repr)


def changed(rng, word):
    at = rng.randrange(len(word))
    new = rng.choice("abcdeéß")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + new + word[at:], word[:at] + new + word[at + 1 :], word[:at] + word[at:][::-1]])


def test_equals_plain(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeÉéß") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    base += [w[::-1] for w in base[:20]] + ["aaaaaaaa", "aaaaaaaaa", "aaaabaaa", "abababab", "babababa"]
    rows = []
    for i in range(300):
        words = [w if rng.random() < 0.7 else changed(rng, w) for w in rng.choices(base, [1 / (k + 1) for k in range(len(base))], k=40)]
        rows.append((i % 250 if i % 7 else None, rng.choice([" ", " ", "1", ", ", "漢"]).join(words)))
    rows += [(1, None), (2, ""), (3, "Straße STRASSE " * 50), (4, "x" * 100_000 + " " + "x" * 100_000), (4, "y" * 3000 + " " + "y" * 2999 + " " + "y" * 3000 + " " + "y" * 2999)] + [(5, "z" * 60)] * 40
    wanted = plain(rows)
    assert run(spark, rows) == wanted
    assert sum(w[1] is not None for w in wanted) > 20


def test_forms_lead_on(spark):
    text = " ".join(["kitchenab"] * 2 + ["kitchena"] * 20 + ["kitchen"] * 400 + ["kitchens"] * 41 + ["kitkhens"] * 5)
    rows = [(0, text)]  # not the operator's own slips
    found = {r[0]: r for r in run(spark, rows, shortest=5)}
    assert found["kitchenab"][1:3] == ("kitchena", "kitchen")
    assert found["kitchens"][1] is None and found["kitchens"][4] == 3  # without an s, with another letter for it or inside
    assert run(spark, rows, shortest=5) == plain(rows, shortest=5)


def test_empty(spark):
    assert run(spark, []) == run(spark, [(1, None), (None, None), (2, "short words only")]) == []


def test_a_class_of_many_orders(spark):
    """Thousands of words of the same letters: none is near another but through an exchanged letter."""
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(1500)}
    words |= {w.replace("a", "z") for w in sorted(words)[:100]}
    rows = [(k, f"{w} {w} {w} {w}") for k, w in enumerate(sorted(words))]
    assert run(spark, rows) == plain(rows)


def test_keys_differ_by_letter_values(spark):
    key = lambda w: spark.range(1).select(spelling.anagram_key(F.lit(w))).first()[0]
    assert key("listen") == key("silent") == sum(ord(c) ** 5 for c in "listen")
    assert key("listens") - key("listen") == ord("s") ** 5
    assert key("gisten") - key("listen") == ord("g") ** 5 - ord("l") ** 5


def test_words_are_joined_by_key_and_not_crossed(spark):
    words = spark.createDataFrame([("abcdefg", 3), ("abcdefh", 4)], "word string, n long")
    plan = plan_of(spelling.near_words(words))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_join_is_broadcast(spark):
    """Words go through no driver, however small Spark takes their tables for."""
    words = staged(spark.createDataFrame([("abcdefg", 3), ("abcdefh", 40)], "word string, n long"), "test")
    docs = spark.createDataFrame([(0, "abcdefg abcdefg abcdefh abcdefh")], "doc_id long, text string")
    for found in (spelling.near_words(words), spelling.variants(docs)):
        assert "Join" in plan_of(found) and "Broadcast" not in plan_of(found)
