import math
import random
from collections import Counter

import numpy as np
import pytest

from shelfrank.llm import lm
from shelfrank.llm.shared import staged


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_base_score_and_counts(docs, awkward, broadcast_bytes):
    """With the model broadcast, and asked by segments, against counting in plain Python."""
    few = docs.where("length(text) < 20000 or text is null")
    rows = [(d, t) for d, t in awkward if t is None or len(t) < 20000]
    c = Counter(w for _, t in rows for w in tokens(t))
    n, v = sum(c.values()), len(c)
    found = lm.score_texts(few, few.where("doc_id < 1000000 or doc_id is null"), broadcast_bytes=broadcast_bytes).collect()
    base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
    got = sorted((r["id"] is None, r["id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert got == sorted((d is None, d or 0, len(tokens(t)), sum(w in c for w in tokens(t)), n, round(base(t), 6)) for d, t in rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_segments_change_nothing(docs):
    few = docs.where("doc_id < 60")
    one, many = (sorted((r["id"], round(r["score"], 9)) for r in lm.score_texts(few, few, broadcast_bytes=b).collect()) for b in (1 << 30, 0))
    assert one == many


def plain_scores(rows, training, mus):
    """score of each text from plain dictionaries of quantised counts."""
    quantised = lambda c: {k: (3 * 2 ** (n.bit_length() - 1) - 1) / 2 for k, n in c.items()}
    words, pairs, triples = Counter(), Counter(), Counter()
    for t in training:
        own = tokens(t)
        words.update(own)
        pairs.update(zip([None, *own], own, strict=False))
        triples.update(zip([None, None, *own], [None, *own], own, strict=False))
    norm = sum(words.values()) + 0.5 * (len(words) + 1)
    c1, c2, c3 = quantised(words), quantised(pairs), quantised(triples)
    out = []
    for t in rows:
        u = v = None
        total, before1, before2 = 0.0, len(training), len(training)
        for w in tokens(t):
            one, two = c1.get(w, 0), min(c2.get((v, w), 0), before1)
            three = min(c3.get((u, v, w), 0), before2)
            share = (two + mus[0] * (one + 0.5) / norm) / (before1 + mus[0])
            total += math.log10(share if len(mus) == 1 else (three + mus[1] * share) / (before2 + mus[1]))
            u, v, before1, before2 = v, w, one, two
        out.append(total)
    return out


@pytest.mark.parametrize("mus", [lm.MUS, lm.TRIPLE_MUS])
@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_scores_equal_a_plain_model(docs, awkward, broadcast_bytes, mus):
    """Every text, the very long one too; with so many bits that no probe errs."""
    train = [t for d, t in awkward if d is None or d % 5 != 1]
    found = lm.score_texts(docs, docs.where("doc_id is null or doc_id % 5 <> 1"), broadcast_bytes=broadcast_bytes, bits_per_entry=4096, mus=mus, keep=["words"]).collect()
    wanted = dict(zip([t for _, t in awkward], plain_scores([t for _, t in awkward], train, mus), strict=True))
    assert len(found) == len(awkward)
    assert all(r["score"] == pytest.approx(wanted[r["words"]], rel=1e-9) for r in found)


def test_blocks_by_way_of_groups_change_nothing(docs, monkeypatch):
    few = docs.where("doc_id < 60")
    one = sorted(map(tuple, lm.count_events(few, 64).collect()))
    assert sorted(map(tuple, lm.count_events(few.repartition(5), 64, blocks=4).collect())) == one
    monkeypatch.setattr(lm, "KEPT_EVENTS", 50)
    assert sorted(map(tuple, lm.count_events(few, 64, blocks=4).collect())) == one


def test_held_out_texts_score_better_than_words_alone(spark):
    """Texts of a few set phrases: what comes before a word tells much about it."""
    rng = random.Random(3)
    phrases = [[f"w{rng.randrange(40)}" for _ in range(6)] for _ in range(12)]
    rows = [(i, " ".join(w for _ in range(8) for w in rng.choice(phrases))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm.score_texts(docs.where("doc_id % 5 = 1"), docs.where("doc_id % 5 <> 1")).collect()
    assert all(r["score"] > r["base_score"] for r in found)
    triples = lm.score_texts(docs.where("doc_id % 5 = 1"), docs.where("doc_id % 5 <> 1"), mus=lm.TRIPLE_MUS).collect()
    assert sum(r["score"] for r in triples) > sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_what_every_run_asks_for_is_answered_from_a_table(spark, monkeypatch):
    """A word in all texts, and many segments: scores as by broadcast, and nothing asked of the common word's segment."""
    rng = random.Random(6)
    rows = [(i, " ".join(["the"] * 5 + [f"w{rng.randrange(4000)}" for _ in range(40)])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 40)
    monkeypatch.setattr(lm, "COMMON_EVENTS", 2000)
    key = lambda r: r["id"]
    one, two = (sorted(lm.score_texts(docs, docs, broadcast_bytes=b).collect(), key=key) for b in (1 << 30, 0))
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in two]) and [tuple(r)[:5] for r in one] == [tuple(r)[:5] for r in two]
    size = sum(len(t) for _, t in rows)
    model = staged(lm.count_events(docs, size // 40, common=max(2, size // 4000)), "test")
    often = lm._common(model, size // 40)
    the = lm.token_hashes([b"the"])[0][0]
    assert 0 < len(often) <= 2 * 2000 and often[np.searchsorted(often["key"], the)]["count"] == 1500 * 5


def test_names_of_its_own_are_refused(docs):
    with pytest.raises(ValueError):
        lm.score_texts(docs, docs, keep=["score"])


def test_nothing_to_learn_from(docs, no_docs):
    rows = lm.score_texts(docs, no_docs).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)
    assert lm.score_texts(no_docs, docs).count() == 0


def test_filter_holds_every_level():
    rng = np.random.default_rng(4)
    keys, counts = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64)), None
    counts = rng.integers(1, 5000, len(keys)).astype(np.uint64)
    seg = keys % np.uint64(8)
    rows = []
    for s in range(8):
        own = seg == s
        rows.append((s, keys[own].tobytes(), counts[own].tobytes(), lm.filter_bits(keys[own], counts[own]).tobytes()))
    shard = lm.Shard(rows, 8)
    wanted = lm.levels_of(counts)
    got = shard.levels(keys)
    assert (got >= wanted).all()  # never too low
    assert (got > wanted).mean() < 0.1  # seldom too high
    other = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    assert (shard.levels(other) > 0).mean() < 0.06
    assert (shard.exact(keys) == counts).all() and not shard.exact(other).any()


def test_levels_and_counts():
    assert lm.levels_of(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]
    assert lm.count_of(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]


def test_probabilities_sum_to_one():
    """Over six equally common words after the text's start, four of which ever follow it."""
    level = int(lm.levels_of(np.array([16]))[0])
    middle = lm.count_of(np.array([level]))[0]
    settings = lm.Settings(96, 6 * (middle + 0.5), 16, lm.TRIPLE_MUS)
    follows = [2, 2, 3, 3, 0, 0]  # levels: counts of 2.5, 2.5, 5.5 and 5.5, together the 16 starts
    shares = [10 ** settings.columns(np.array([0, 1]), np.array([0]), np.array([16]), [np.array([x]) for x in (level, f, f)])["score"][0] for f in follows]
    assert sum(shares) == pytest.approx(1) and shares[2] > shares[0] > shares[4] > 0
