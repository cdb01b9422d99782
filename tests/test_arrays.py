"""JSON arrays read by splits, against the whole file parsed at once."""

import contextlib
import json
import random

import pytest
from pyspark.sql import functions as F

from shelfrank.sources import arrays, catalogue

from .conftest import plan_of

NASTY = ['"', "\\", '\\"', "{", "}", "[", "]", ",", "},{", '"}', "\n", "é", "漢", "𝔘", "a", "\\u007d", ":", " "]


@contextlib.contextmanager
def splits(spark, size, cost="1"):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": cost}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind == 0:
        return rng.choice([None, True, 0, -1.5, 1e10])
    if kind < 5:
        return "".join(rng.choices(NASTY, k=rng.randrange(12)))
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{k}{rng.choice(NASTY)}": value(rng, depth + 1) for k in range(rng.randrange(5))}


def read(spark, path):
    rows = arrays.elements(spark, str(path)).collect()
    out = {}
    for r in rows:
        assert (r["file"], r["place"]) not in out
        out[r["file"], r["place"]] = json.loads(r["value"])
    return out


@pytest.mark.parametrize("size", [37, 500, 1 << 27])
def test_elements_equal_the_parsed_file(spark, tmp_path, size):
    rng = random.Random(size)
    wanted = []
    for k in range(4):
        items = [value(rng) if rng.random() < 0.8 else {"n": i, "s": "x" * rng.randrange(200)} for i in range(60 * k)]
        text = json.dumps(items, indent=rng.choice([None, None, 2]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"{k}.json").write_text(("﻿" if k == 1 else "") + " \n" * (k % 2) + text + rng.choice(["", "\n"]))
        wanted.append(items)
    with splits(spark, size):
        found = read(spark, tmp_path)
        files = {}
        for (file, place), v in found.items():
            files.setdefault(file, {})[place] = v
    lists = [[own[k] for k in range(len(own))] for own in files.values()]
    assert sorted(map(json.dumps, lists)) == sorted(json.dumps(w) for w in wanted if w)


def test_small_and_odd_files(spark, tmp_path):
    cases = {"[]": [], " [ ] ": [], "": [], " \n": [], "[1]": [1], '["}"]': ["}"], "[[],[1,2],{}]": [[], [1, 2], {}], '{"a": [1, {"b": 2}]}': [{"a": [1, {"b": 2}]}], '[{"a": 1},]': [{"a": 1}], '["\\\\", "\\""]': ["\\", '"'], "[null, null]": [None, None]}
    for size in (1 << 27, 3):
        for k, (text, wanted) in enumerate(cases.items()):
            place = tmp_path / f"{size}-{k}.json"
            place.write_text(text)
            with splits(spark, size):
                found = read(spark, place)
            assert [found[key] for key in sorted(found)] == wanted, (text, size)


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    records = [{"_id": f"d{i}", "title": "{T} \"q\", " * rng.randrange(9), "price": i + 0.5, "images": ["a", "b}"], "parseHtmlSpec": {"meta": {"brand": "B"}}} for i in range(3000)]
    place = tmp_path / "devices.json"
    place.write_text(json.dumps(records))
    numbers = []
    for size in (9_000, 70_000):
        with splits(spark, size):
            rows = catalogue.read_catalogue(spark, str(place))
            got = rows.orderBy("_ordinal").select("_ordinal", "_id", "title", "price", "images", "parseHtmlSpec.meta.brand").collect()
            assert [tuple(r) for r in got] == [(i, r["_id"], r["title"], r["price"], r["images"], "B") for i, r in enumerate(records)]
            numbers.append([r["_ordinal"] for r in got])
            # No task has more bytes than a split and the rest of one row.
            tasks = arrays._rows(spark, str(place)).groupBy(F.spark_partition_id()).agg(F.sum(F.length("value") + 1).alias("n")).collect()
            assert len(tasks) >= place.stat().st_size // size and max(r["n"] for r in tasks) <= size + 1000
    assert numbers[0] == numbers[1] == list(range(3000))


def test_only_cut_elements_are_shuffled(spark, tmp_path):
    records = [{"_id": f"d{i}", "images": ["a"] * 5} for i in range(2000)]
    place = tmp_path / "devices.json"
    place.write_text(json.dumps(records))
    with splits(spark, 10_000):
        states = arrays.split_states(spark, str(place))
        many = states.count()
        rows = arrays._rows(spark, str(place)).join(F.broadcast(states), ["file", "start"]).select("value", "file", "start", "base", "inside", "depth", "first")
        pieces = rows.mapInArrow(lambda b: arrays._cut(b, False), "file bigint, place bigint, part bigint, value string").count()
        assert many > 5 and pieces <= 2 * many
        plan = plan_of(arrays.elements(spark, str(place)))
    assert "Cartesian" not in plan and "SortMergeJoin" not in plan


def test_export_as_arrays_and_back(spark, tmp_path):
    rows = [json.dumps({"_id": f"d{i}", "title": 't"}' * (i % 3), "price": float(i)}) for i in range(50)]
    (tmp_path / "in.json").write_text("[" + ", ".join(rows) + "]")
    devices = catalogue.read_catalogue(spark, str(tmp_path / "in.json"))
    for single in (True, False):
        out = str(tmp_path / f"out{single}")
        catalogue.export(devices.drop("_ordinal").orderBy("price"), out, single=single, layout="array")
        back = catalogue.read_catalogue(spark, out)
        assert [r[0] for r in back.orderBy("_ordinal").select("_id").collect()] == [f"d{i}" for i in range(50)]
        assert {json.loads(p.read_text())[0]["_id"] for p in (tmp_path / f"out{single}").glob("*.txt")} and (not single or len(list((tmp_path / "outTrue").glob("*.txt"))) == 1)


def test_variants_of_lines_and_arrays(spark, tmp_path):
    rows = [{"_id": "a", "price": 5, "title": "T"}, {"_id": 7, "price": "9"}, {"_id": None}]
    (tmp_path / "rows.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    wanted = [("a", 5.0, "T"), (None, None, None), (None, None, None)]
    for name, layout in (("rows", "array"), ("lines", "lines")):
        variants = catalogue.read_variants(spark, str(tmp_path / f"{name}.json"), layout)
        assert [tuple(r) for r in catalogue.typed_catalogue(variants).orderBy("_ordinal").select("_id", "price", "title").collect()] == wanted


def test_too_many_files_are_an_error(spark, tmp_path, monkeypatch):
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("[{}]")
    monkeypatch.setattr(catalogue, "MOST_FILES", 3)
    with pytest.raises(Exception, match="at the most"):
        catalogue.read_catalogue(spark, str(tmp_path)).select("_ordinal").collect()


def test_broken_elements_are_rows_of_nulls(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"_id": "a"}, 5, {"_id": "b" "c"}, {"_id": "d"}]')
    rows = catalogue.read_catalogue(spark, str(tmp_path / "x.json")).orderBy("_ordinal").select("_ordinal", "_id").collect()
    assert [(r[0], r[1]) for r in rows if r[0] != 2] == [(0, "a"), (1, None), (3, "d")] and len(rows) == 4
