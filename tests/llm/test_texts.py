"""Byte-level BPE, language and quality."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import zstandard

from shelfrank.llm import bpe, langid, quality

from .conftest import prose

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_rank_files_own_library(docs, awkward, plain):
    found = bpe.encode_decode(docs, PATH, PATTERN, keep=["score"], real=True).collect()

    def wanted(t):
        ids = plain.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, t or ""

    got = sorted(((r["id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["ids"]), r["decoded"]) for r in found), key=repr)
    assert got == sorted(((d, *wanted(t)) for d, t in awkward), key=repr)


def test_bpe_of_odd_texts(plain):
    rng = random.Random(8)
    ranks = bpe.read_ranks(PATH)
    coder = bpe.Coder(ranks, bpe.model_bytes(ranks), PATTERN)
    texts = ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1FAFF), 32, 10, 0x2581, 0x120, 0])) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["a" * 3000, " " * 500, "<|endoftext|>", "\x00", "don't I'll", "x" * 41 + "y"]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_bpe_without_rows(no_docs):
    assert bpe.encode_decode(no_docs, PATH, PATTERN).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, rng.randint(5, 80)), lang) for i in range(300) for lang in [rng.choice(["en", "de"])]]
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "text", None), (902, "123", "de")], "doc_id long, text string, lang string")


def test_languages_of_held_out_texts(labelled):
    models = langid.fit(labelled.where("doc_id % 5 <> 0"))
    assert set(models) == {"en", "de"} and all(len(m) <= langid.DICT_BYTES for m in models.values())
    rows = langid.identify(labelled.where("doc_id % 5 = 0 and doc_id < 900"), models, keep=["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["margin"] <= 1 for r in rows)


def test_texts_without_letters_are_undetermined(spark, docs, no_docs, labelled):
    models = langid.fit(labelled)
    found = {(r["id"], r["words"]): r for r in langid.identify(docs, models, keep=["words"]).collect()}
    for (_, t), r in found.items():
        assert (r["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t)) and (r["lang_pred"] != "und" or r["rejected"])
    assert langid.identify(no_docs, models).count() == 0
    assert langid.fit(labelled.where("false")) == {}
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(docs, {"en": models["en"]}).collect()} == {"en", "und"}


def test_narrow_margins_are_rejected_at_any_length(labelled):
    models = langid.fit(labelled)
    both = langid.Classifier({"a": models["en"], "b": models["en"]})
    for n in (1, 3, 20, 400):
        assert both.classify(prose(random.Random(n), "en", n)) == ("a", 0.0, True)


def test_few_words_are_told_apart(labelled):
    own = langid.Classifier(langid.fit(labelled))
    rng = random.Random(5)
    for n, least, most in ((3, 0.9, 0.2), (8, 0.97, 0.05)):
        found = [(lang, own.classify(prose(rng, lang, n))) for lang in ("en", "de") for _ in range(150)]
        assert sum(lang == f[0] for lang, f in found) >= least * len(found)
        assert sum(f[2] for _, f in found) <= most * len(found)


def test_prediction_equals_plain_compression(labelled, docs):
    """The smallest sum of block sizes, compressed one by one."""
    models = langid.fit(labelled)
    letters = regex.compile(r"\p{L}+")

    def size(body, lang, level):
        own = zstandard.ZstdCompressionDict(models[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        c = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_dict_id=False)
        if len(body) < 512:
            return len(c.compress(b"\n".join([body] * 8)))
        return sum(len(c.compress(body[i : i + 1024])) for i in range(0, len(body), 1024))

    for r in langid.identify(docs, models, keep=["words"]).collect():
        words = letters.findall((r["words"] or "").lower())
        if not words:
            assert r["lang_pred"] == "und"
            continue
        body = " ".join(w for w, before in zip(words, [None, *words], strict=False) if w != before).encode()
        ranked = sorted(models, key=lambda m: (size(body, m, langid.LEVEL), size(body, m, langid.TIE_LEVEL), list(models).index(m)))
        first, second = (size(body, m, langid.LEVEL) for m in ranked[:2])
        assert r["lang_pred"] == ranked[0] and r["margin"] == pytest.approx(1 - first / second)
        assert r["rejected"] == (1 - first / second < langid.NARROW_MARGIN)


def test_only_the_commonest_languages_are_learned(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, "en", 20), f"l{i % 7}" if i % 7 < 3 or i < 70 else "l0") for i in range(300)]
    assert list(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=3)) == ["l0", "l1", "l2"]


def bad(rng):
    return rng.choice([lambda: "spam " * rng.randint(5, 60), lambda: "!!! ".join(prose(rng, "en", 20).upper().split()), lambda: " | ".join(prose(rng, "en", 20).split())])()


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(12)
    rows = [(i, bad(rng) if rng.random() < 0.3 else prose(rng, "en", rng.randint(10, 90))) for i in range(700)]
    labels = [(i, int("spam spam" not in t and "!!!" not in t and "|" not in t)) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1), (None, 0), (3, None)], "doc_id long, quality int")


def test_quality_on_held_out_rows(judged):
    docs, labels = judged
    model = quality.fit(docs, labels.where("doc_id % 4 <> 0"))
    assert 0 < len(model.rules) < 200
    rows = quality.score(docs.where("doc_id % 4 = 0").join(labels, "doc_id"), model, keep=["quality"]).collect()
    right = [(r["score"] >= 0.3) == bool(r["quality"]) for r in rows if r["quality"] is not None]
    assert sum(right) / len(right) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_compiled_column_equals_the_rules(judged, docs):
    d, labels = judged
    model = quality.fit(d, labels)
    found = quality.with_statistics(docs).withColumn("score", model.column()).collect()
    x = np.array([[r[s] for s in quality.STATS] for r in found])
    assert np.allclose(model.predict(x), [r["score"] for r in found])
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())


def test_nothing_or_one_class_to_learn(judged, docs, no_docs):
    d, labels = judged
    for few in (labels.where("false"), labels.where("quality = 1")):
        model = quality.fit(d, few)
        assert model.rules == [] and all(0 < r["score"] < 1 for r in quality.score(docs, model).collect())
    assert quality.score(no_docs, model).count() == 0


def test_statistics_equal_plain_ones(awkward):
    """Recounted on characters, one at a time."""
    ascii_lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for _, t in awkward:
        t = t if t is None or len(t) < 20_000 else t[:20_000]
        got = dict(zip(quality.STATS, quality.statistics(t.encode() if t is not None else None), strict=True))
        if not t:
            assert set(got.values()) == {0.0}
            continue
        raw, words = len(t.encode()), regex.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        n, of = max(len(words), 1), lambda test: sum(len(c.encode()) for c in t if test(c)) / raw  # noqa: B023
        runs, here = [0], 0
        for a, b in zip(words, words[1:], strict=False):
            here = here + 1 if a == b else 0
            runs.append(here)
        lines = [x for x in t.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
        want = {
            "size": np.log1p(raw), "words": np.log1p(len(words)), "word_length": sum(len(w.encode()) for w in words) / n, "distinct": len(set(words)) / n,
            "commonest": max([words.count(w) for w in set(words)], default=0) / n, "run": max(runs) / n, "repeats": sum(r > 0 for r in runs) / n,
            "upper": of(lambda c: "A" <= c <= "Z"), "digits": of(lambda c: c in "0123456789"), "marks": of(lambda c: c in "!?.,;:'\"()-"), "symbols": of(lambda c: c in "#$%&*+/<=>@[\\]^_`{|}~"),
            "pipes": t.count("|") / n, "stops": sum(t.count(c) for c in ".!?") / n, "blanks": of(lambda c: c in " \t\r\n"), "wide": of(lambda c: ord(c) > 127), "lines": np.log1p(len(lines)),
            "line_length": raw / max(len(lines), 1), "line_repeats": 1 - len(set(lines)) / max(len(lines), 1), "no_letter": sum(bool(regex.fullmatch(r"[0-9!?.,;:'\"()\-#$%&*+/<=>@\[\\\]^_`{|}~]+", w)) for w in words) / n, "exclamations": t.count("!") / n,
        }
        assert set(want) == set(quality.STATS) and got == {k: pytest.approx(v) for k, v in want.items()}


def test_columns_of_any_name_may_stand_beside(judged, docs, labelled):
    d, labels = judged
    beside = d.selectExpr("*", "1 label", "2 label_id", "3 body", "4 id", "5 words", "6 score")
    assert quality.fit(beside, labels) == quality.fit(d, labels)
    assert quality.score(beside, quality.fit(d, labels), keep=["label", "body"]).columns == ["id", "label", "body", "score"]
    models = langid.fit(labelled.selectExpr("*", "1 n", "2 size", "3 at", "4 below"))
    assert models == langid.fit(labelled)
    for call in (lambda: quality.score(beside, quality.fit(d, labels), keep=["words"]), lambda: langid.identify(docs.withColumn("margin", docs["score"]), models, keep=["margin"]), lambda: bpe.encode_decode(docs, PATH, PATTERN, keep=["id"])):
        with pytest.raises(ValueError):
            call()


def test_statistics_of_nothing():
    assert quality.statistics(None) == quality.statistics(b"") == [0.0] * len(quality.STATS)
    assert all(np.isfinite(quality.statistics(b" \n!! ")))


def test_language_of_few_usable_rows_is_learned_from_whole_texts(spark):
    rng = random.Random(12)
    rows = [(i, "en", prose(rng, "en", 40) if i < 40 else ["", None, " 12 "][i % 3]) for i in range(60_000)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))["en"].count(b"\n") == 39


def test_dictionaries_hold_whole_texts_and_pieces_of_long_ones(spark):
    rng = random.Random(13)
    rows = [(i, "en", prose(rng, "en", 300 if i < 8 else 4000)) for i in range(60)] + [(i, "de", prose(rng, "de", 9000 + 10 * i)) for i in range(100, 104)]
    rows += [(k, "xx", "äb" * 30_000) for k in range(200, 203)]  # one long word
    models = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    whole = [langid.words_of(t) for _, _, t in rows]
    assert all(0 < len(m) <= langid.DICT_BYTES for m in models.values()) and len(models["en"]) > langid.DICT_BYTES / 2
    parts = models["de"].decode().split("\n")
    assert len(parts) == 4 and all(len(p.encode()) <= langid.TEXT_BYTES and any(f" {p} " in f" {w} " for w in whole) for p in parts)
    assert len({next(w.index(p) for w in whole if p in w) for p in parts}) > 1  # from anywhere, not from the start
