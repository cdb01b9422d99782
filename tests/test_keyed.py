"""Keyed documents: what is rewritten, crashes, and writers at once."""

import pytest
from pyspark.sql import functions as F

from shelfrank.sources import keyed, places

KIND = "title string, n int, s string"


@pytest.fixture
def documents(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "documents"), KIND, buckets=16)
    table.upsert(spark.range(500).selectExpr("concat('t', id) AS title", "int(id) AS n", "'x' AS s"))
    return table


def rows_of(df):
    return {r["title"]: (r["n"], r["s"]) for r in df.collect()}


def new(spark, rows, kind="title string, n int"):
    return spark.createDataFrame(rows, kind)


def test_an_upsert_of_few_keys_rewrites_few_buckets(spark, documents):
    before, first = rows_of(documents.read()), documents.manifest()
    assert len(before) == 500 and len(first["files"]) == 16
    after = documents.upsert(new(spark, [("t3", -3), ("new", 9)]))
    changed = [b for b in after["files"] if after["files"][b] != first["files"][b]]
    assert 1 <= len(changed) <= 2 and after["number"] == 2
    assert rows_of(documents.read()) == before | {"t3": (-3, "x"), "new": (9, None)}
    assert rows_of(documents.lookup(["t3", "none", "t77"])) == {"t3": (-3, "x"), "t77": (77, "x")}
    assert len(documents.lookup(["t3"]).inputFiles()) == 1
    assert rows_of(documents._read(documents.manifest(1))) == before  # readers of the older manifest


def test_supplied_nulls_overwrite_and_absent_fields_stay(spark, documents):
    rows = new(spark, [("t1", None, True), ("t2", None, False)], "title string, n int, has boolean")
    documents.upsert(rows, supplied={"n": F.col("has")})
    found = rows_of(documents.lookup(["t1", "t2"]))
    assert found == {"t1": (None, "x"), "t2": (2, "x")}


def test_a_crash_before_the_swap_leaves_the_old_table(spark, documents, monkeypatch):
    before = rows_of(documents.read())

    def dies(*_):
        raise OSError("killed")

    monkeypatch.setattr(documents, "_publish", dies)
    with pytest.raises(OSError):
        documents.upsert(new(spark, [("t1", -1)]))
    monkeypatch.undo()
    assert rows_of(documents.read()) == before and documents.manifest()["number"] == 1
    assert len(documents.vacuum()) == 1
    documents.upsert(new(spark, [("t1", -1)]))
    assert rows_of(documents.read()) == before | {"t1": (-1, "x")}


@pytest.mark.parametrize("other", ["t1", "elsewhere"])
def test_two_writers_lose_nothing(spark, documents, monkeypatch, other):
    """Another upsert commits while this one has merged and not yet published."""
    second = keyed.KeyedTable(spark, documents.path, KIND)  # finds the buckets of the first write
    before, merges, publish = rows_of(documents.read()), [], documents._publish
    merged = documents._merged
    monkeypatch.setattr(documents, "_merged", lambda *a: merges.append(1) or merged(*a))

    def late(base, done):
        if base["number"] == 1:
            if other == "t1":
                second.upsert(new(spark, [("t1", "theirs")], "title string, s string"))
            else:
                away = next(t for t in before if str(bucket(spark, second, t)) not in done)
                second.upsert(new(spark, [(away, "theirs")], "title string, s string"))
                before[away] = (before[away][0], "theirs")
        return publish(base, done)

    monkeypatch.setattr(documents, "_publish", late)
    assert documents.upsert(new(spark, [("t1", -1)]))["number"] == 3
    assert rows_of(documents.read()) == before | {"t1": (-1, "theirs" if other == "t1" else "x")}
    assert len(merges) == (2 if other == "t1" else 1)  # merged again only where both changed a bucket


def bucket(spark, table, key):
    return spark.range(1).select(table._bucket(F.lit(key), table.manifest())).first()[0]


def test_what_is_refused(spark, documents):
    before = documents.manifest()
    with pytest.raises(ValueError, match="one key"):
        documents.upsert(new(spark, [("a", 1), ("a", 2)]))
    for key in (None, ""):
        with pytest.raises(Exception, match="needs a key"):
            documents.upsert(new(spark, [(key, 1)]))
    assert documents.manifest() == before
    assert rows_of(documents.read()) == rows_of(documents._read(before))


def test_empty_tables_and_upserts(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "none"), KIND)
    assert table.read().count() == 0 and table.lookup(["a"]).count() == 0
    table.upsert(new(spark, []))
    assert table.read().count() == 0 and table.manifest()["number"] == 1


def test_old_manifests_go(spark, documents):
    for k in range(3):
        documents.upsert(new(spark, [(f"t{k}", -k)]))
    wanted = rows_of(documents.read())
    assert documents.vacuum(keep=1) == [] and documents.manifests.numbers() == [4]  # no folder lost all of its buckets
    assert rows_of(documents.read()) == wanted


def test_a_name_is_published_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "log" / "1.json")
    assert places.published(spark, path, "one é") and not places.published(spark, path, "two")
    assert places.read_small(spark, path) == "one é"
    assert [n for n in places.listed(spark, str(tmp_path / "log")) if not n.endswith(".crc")] == ["1.json"]
