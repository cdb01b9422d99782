import random
import re

import pytest

from shelfrank.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(window, len(b))
        for win in {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else ():
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) == win:
                    hit |= set(range(s, s + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), sorted(hit), sorted(found)


@pytest.fixture(scope="module")
def items(awkward):
    long = [" ".join(words(t)[2:22]) for _, t in awkward[:6]]
    return [(1, long[0]), (2, long[0] + " extra"), (10, long[1].upper()), (10, long[1]), (3, "one"), (4, "one two"), (5, ""), (6, None), (7, "!!"), (None, long[2]), (8, "no such passage in any of these documents at all it is quite new"), (9, "a a a"), (11, long[3])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_equals_brute_force(spark, docs, awkward, items, block_bytes):
    bench = spark.createDataFrame([(i, t, 0.1) for i, t in items], "item_id long, text string, score double")
    found = decontaminate.contamination(docs, bench, block_bytes=block_bytes, keep=["score"])
    order = lambda rows: sorted(rows, key=repr)
    assert order((r["id"], r["n_words"], list(r["hits"]), list(r["items"])) for r in found.collect()) == order((d, *brute(t, items)) for d, t in awkward)


def test_empty_tables(spark, docs, no_docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, none).count() == 0
    assert decontaminate.summary(decontaminate.contamination(docs, none)).where("contaminated or n_hit > 0 or listed <> ''").count() == 0


def test_matcher_finds_overlapping_and_mixed_lengths():
    rng = random.Random(9)
    for _ in range(300):
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        patterns = [(str(k), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 5))]) for k in range(4)]
        got = sorted((s, e, i) for s, e, i in decontaminate.Matcher([(i, b" ".join(p)) for i, p in patterns], None).find(text))
        assert got == sorted((s, s + len(p), i) for i, p in patterns for s in range(len(text) - len(p) + 1) if text[s : s + len(p)] == p)


def test_matcher_of_full_windows():
    rng = random.Random(10)
    for _ in range(200):
        texts = [(str(k % 3), [rng.choice([b"a", b"b"]) for _ in range(rng.randint(3, 20))]) for k in range(4)]
        text = [rng.choice([b"a", b"b"]) for _ in range(40)]
        got = sorted((s, e, i) for s, e, i in decontaminate.Matcher([(i, b" ".join(p)) for i, p in texts], 3).find(text))
        windows = {(i, tuple(p[a : a + 3])) for i, p in texts for a in range(len(p) - 2)}
        assert got == sorted((s, s + 3, i) for i, w in windows for s in range(38) if tuple(text[s : s + 3]) == w)


def test_long_items_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    rng = random.Random(11)
    body = [f"w{rng.randrange(500)}" for _ in range(100)]
    docs = spark.createDataFrame([(k, " ".join(["x", *body[k : k + 15], "y"])) for k in range(86)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(body)), (6, " ".join(body[:13])), (7, " ".join(body[40:52]))], "item_id long, text string")
    items = [(5, " ".join(body)), (6, " ".join(body[:13])), (7, " ".join(body[40:52]))]
    found = {r["id"]: (r["n_words"], list(r["hits"]), list(r["items"])) for r in decontaminate.contamination(docs, bench).collect()}
    assert found == {r["doc_id"]: brute(r["text"], items) for r in docs.collect()}


def test_tables_are_small_beside_their_text():
    rng = random.Random(12)
    words = [f"{rng.randrange(10**5):x}".encode() for _ in range(200_000)]
    body = b" ".join(words)
    m = decontaminate.Matcher([("1", body)], 13)
    held = sum(x.nbytes for x in (m.keys, m.at, m.size, m.words, m.owner)) + len(m.body) + len(m.shift)
    assert held < 12 * len(body)  # short words; a Python object a window would take a hundred times the text


def test_names_of_its_own_are_refused(docs):
    for name in ("id", "words"):
        keep = [name]
        if name == "id":
            with pytest.raises(ValueError):
                decontaminate.contamination(docs, docs, item_col="doc_id", keep=keep)
        else:
            assert "words" in decontaminate.contamination(docs, docs.limit(2), item_col="doc_id", keep=keep).columns


def test_verdict_at_a_twentieth(spark):
    bench = spark.createDataFrame([(1, "needle in")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "needle in " + "w " * 38), (2, "needle in " + "w " * 39)], "doc_id long, text string")
    assert {r["id"]: r["contaminated"] for r in decontaminate.summary(decontaminate.contamination(docs, bench)).collect()} == {1: True, 2: False}
