import random

import pytest

WORDS = {
    "en": "the of and to in is that for with this from have are not but they which one all would there their what".split(),
    "de": "der die und das ist nicht von mit sich auf für eine dem auch als nach wird bei einer über durch können".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, null ids, a very long text."""
    rng = random.Random(3)
    texts = [prose(rng, rng.choice(["en", "de"]), rng.randint(3, 120)) for _ in range(60)]
    near = texts[0].split()
    near[5] = "changed"
    texts += [texts[0], texts[0], " ".join(near), None, None, "", "   \n", "!!!", "one", "One two", "É à 漢字 𝔘nicode", "tab\tsep\x0bvt nbsp\xa0x", prose(rng, "en", 30_000)]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """The awkward rows with columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 0.5, t) for i, t in awkward]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score double, words string")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
