"""Near-duplicates of the pipeline against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

from shelfrank.llm import jaccard, simhash
from shelfrank.llm.shared import space_words, staged
from shelfrank.llm.simhash import wide_links, wide_plans

corpus_pipeline = pytest.importorskip("corpus_pipeline")
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def similarity(a, b):
    x, y = (set(jaccard.shingle_set(space_words((t or "").encode()), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def least_of_components(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similarity(texts[i], texts[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return set(root)


def kept(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = staged(spark.createDataFrame(rows, KIND).repartition(3), "test")
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}


def pair(rng, shared):
    """Two texts of 204 words and 200 shingles, of which a run of `shared` is common."""
    same = words(rng, shared + 4)
    return [" ".join(same + words(rng, 200 - shared)), " ".join(words(rng, 200 - shared) + same)]


def test_every_pair_at_the_threshold_is_found(spark):
    rng = random.Random(5)
    texts = [t for _ in range(60) for t in pair(rng, 178)]  # 178 of 222
    assert all(similarity(*texts[i : i + 2]) >= 0.8 for i in range(0, 120, 2))
    assert kept(spark, texts) == set(range(0, 120, 2))


def test_pairs_below_the_threshold_stay(spark):
    rng = random.Random(6)
    texts = [t for _ in range(60) for t in pair(rng, 170)]  # 170 of 230
    assert kept(spark, texts) == set(range(120))


def test_common_passage_does_not_chain_and_failed_stars_hide_no_link(spark):
    rng = random.Random(7)
    passage = words(rng, 150)
    texts = [" ".join(passage + words(rng, 50)) for _ in range(40)]
    for i in range(12):  # near copies of some, in the same buckets
        own = texts[i].split()
        own[-3] = "other"
        texts.append(" ".join(own))
    texts += ["", None, "  ", "one two", "one two", "One two"]
    assert kept(spark, texts) == least_of_components(texts) == {*range(40), 52, 55}


@pytest.mark.parametrize("chunk_shingles", [800, 1 << 20])
def test_large_chains_are_dealt_out_whole(spark, chunk_shingles):
    rng = random.Random(8)
    passage = words(rng, 170)
    texts = [" ".join(passage + words(rng, 34)) for _ in range(20)]
    texts += [" ".join([*t.split()[:-1], "end"]) for t in texts]
    docs = staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test")
    found = jaccard.near_duplicates(docs, "doc_id", chunk_shingles=chunk_shingles).collect()
    assert {r["component_id"] for r in found} == least_of_components(texts)


def test_recall_of_candidates_at_the_threshold():
    rng = np.random.default_rng(9)
    met = 0
    for _ in range(2000):
        pool = rng.integers(-(2**63), 2**63, 224)  # 180 of 224
        (a, b), (c, d) = (jaccard.words_of(np.sort(x)) for x in (pool[:202], pool[22:]))
        first, second = (int(x ^ y) % 2**64 for x, y in ((a, c), (b, d)))
        met += min(first.bit_count(), second.bit_count()) <= jaccard.RADIUS and first.bit_count() + second.bit_count() <= jaccard.TOTAL
    assert met >= 1985


def test_links_chain_every_near_pair(spark):
    """All pairs within the radius of either word and the total of both, against brute force; buckets dealt out too."""
    rng = np.random.default_rng(10)
    base = rng.integers(0, 2**64, (60, 2), np.uint64)
    rows = [tuple(int(x) for x in r) for r in base]
    for _ in range(400):
        x, y = rows[rng.integers(60)]
        for b in rng.integers(0, 64, rng.integers(0, 20)):
            x ^= 1 << int(b)
        for b in rng.integers(0, 64, rng.integers(0, 24)):
            y ^= 1 << int(b)
        rows.append((x, y))
    signed = lambda v: v - (v >> 63 << 64)
    number = {(signed(x), signed(y)): k for k, (x, y) in enumerate(rows)}
    rows = [(x % 2**64, y % 2**64) for x, y in number]
    marks = staged(spark.createDataFrame([(k, signed(x), signed(y)) for k, (x, y) in enumerate(rows)], "mark long, w0 long, w1 long").selectExpr("*", "mark AS root"), "test")
    plans = wide_plans(marks, ("w0", "w1"), 14)
    near = set()
    for i, (a, b) in enumerate(rows):
        for j, (c, d) in enumerate(rows[:i]):
            u, v = (a ^ c).bit_count(), (b ^ d).bit_count()
            if min(u, v) <= 14 and u + v <= 34:
                near.add((j, i))
    root = list(range(len(rows)))
    for a, b in near:
        lo, hi = sorted((root[a], root[b]))
        root = [lo if r == hi else r for r in root]
    for bucket_rows in (1 << 16, 20):
        found = [(r["a"], r["b"]) for r in wide_links(marks, ("w0", "w1"), plans, 14, 34, bucket_rows=bucket_rows).collect()]
        assert len(near) > 300 and {(min(p), max(p)) for p in found} <= near
        joined = list(range(len(rows)))
        for a, b in found:
            lo, hi = sorted((joined[a], joined[b]))
            joined = [lo if r == hi else r for r in joined]
        assert joined == root
    # What agrees in a partition is found without probes, and what shares a root needs no link.
    some = [(r["a"], r["b"]) for r in wide_links(marks, ("w0", "w1"), plans, 14, 34, False).collect()]
    assert some and {(min(p), max(p)) for p in some} <= near
    one = staged(marks.drop("root").selectExpr("*", "0L AS root"), "test")
    assert wide_links(one, ("w0", "w1"), plans, 14, 34).count() == 0


def test_a_large_group_of_near_copies_gives_few_links(spark, monkeypatch):
    """Hundreds of copies of one text, each changed in places: links of the whole search stay near the documents' number."""
    rng = random.Random(11)
    base = words(rng, 300)
    texts = []
    for _ in range(400):
        own = list(base)
        for k in rng.sample(range(300), 3):
            own[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    found, counts = jaccard.wide_links, []

    def counted(*args):
        links = staged(found(*args), "test")
        counts.append(links.count())
        return links

    monkeypatch.setattr(jaccard, "wide_links", counted)
    docs = staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test")
    assert {r["component_id"] for r in jaccard.near_duplicates(docs, "doc_id").collect()} == {0}
    assert len(counts) == 2 and sum(counts) <= 3 * len(texts)


def test_tables_keep_pairs_and_their_buckets_small(spark):
    """Of pairs at the threshold 0.998 agree in a table; what a fingerprint is compared with hardly grows with their number."""
    for n in (10**5, 10**7):
        bits, tables = simhash.how_many_tables(n, jaccard.APART, jaccard.TOTAL, jaccard.RECALL)
        assert tables * n / 2 ** (bits + 1) < 0.1 * n  # two words' partitions: half of n
    few, many = (tables * n / 2**bits for n in (10**6, 10**8) for bits, tables in [simhash.how_many_tables(n, jaccard.APART, jaccard.TOTAL, jaccard.RECALL)])
    assert many < 20 * few
    rng = np.random.default_rng(12)
    made = simhash.Tables(*simhash.how_many_tables(10**6, jaccard.APART, jaccard.TOTAL, jaccard.RECALL))
    met = 0
    for _ in range(2000):
        pool = rng.integers(-(2**63), 2**63, 224)  # 180 of 224
        a, b = (np.array(jaccard.words_of(np.sort(x)), np.int64).view(np.uint64) for x in (pool[:202], pool[22:]))
        own, other = np.array([a[0], b[0]]), np.array([a[1], b[1]])
        buckets = np.concatenate([made.dealt(own, other, probes)[0].reshape(2, -1) for probes in (False, True)], 1)
        met += bool((buckets[0] == buckets[1]).any() and simhash.apart(a, b).sum() <= jaccard.TOTAL)
    assert met >= 1990


def test_tables_find_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIGEONHOLE_ROWS", 0)
    rng = random.Random(13)
    texts = [t for _ in range(60) for t in pair(rng, 178)] + [t for _ in range(30) for t in pair(rng, 170)]
    base = words(rng, 300)
    for _ in range(200):  # a group of near copies
        own = list(base)
        own[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += ["", None, "one two", "One two"]
    docs = staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test")
    assert {r["component_id"] for r in jaccard.near_duplicates(docs, "doc_id").collect()} == least_of_components(texts)


@pytest.mark.parametrize("bucket_rows", [1 << 16, 20])
def test_links_of_tables_lie_within_the_total(spark, bucket_rows):
    rng = np.random.default_rng(14)
    rows = [tuple(int(x) for x in r) for r in rng.integers(0, 2**64, (40, 2), np.uint64)]
    for k in range(300):
        x, y = rows[k % 40]
        for b in rng.integers(0, 64, 8):
            x ^= 1 << int(b)
        for b in rng.integers(0, 64, 8):
            y ^= 1 << int(b)
        rows.append((x, y))
    signed = lambda v: v - (v >> 63 << 64)
    marks = staged(spark.createDataFrame([(k, signed(x), signed(y)) for k, (x, y) in enumerate(rows)], "mark long, w0 long, w1 long").selectExpr("*", "mark AS root"), "test")
    plans = simhash.wide_tables(spark, len(rows), jaccard.APART, jaccard.TOTAL, jaccard.RECALL)
    found = [(r["a"], r["b"]) for probes in (False, True) for r in simhash.wide_links(marks, ("w0", "w1"), plans, 64, 34, probes, bucket_rows).collect()]
    assert all(sum((u ^ v).bit_count() for u, v in zip(rows[a], rows[b], strict=True)) <= 34 for a, b in found)
    root = list(range(len(rows)))
    for a, b in found:
        lo, hi = sorted((root[a], root[b]))
        root = [lo if r == hi else r for r in root]
    assert root == [*range(40), *(k % 40 for k in range(300))]
