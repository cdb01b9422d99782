"""HTML extraction, chip documents, upserts, threads and the stream of messages."""

import json

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import dedup, threads
from shelfrank.operators.store import Store
from shelfrank.plans import conversation, planner
from shelfrank.sources import catalogue, chips, listings, schemas
from shelfrank.streaming.threads import append_stream

LAYOUT = listings.ListingLayout("https://shop.test")
CARD = '<div data-id="1"><a class="k7wcnx" href="/p/1"><div class="RG5Slk"> A &amp; B </div></a><img class="UCc1lI z" src="" data-src="i.png"><div class="hZ3P6w DeU9vF">₹9</div><div class="MKiFS6">4.6<img src=s></div><ul class="HwRTzP"><li class="DTBslk">x<li class="DTBslk"> <li class="DTBslk">y</ul></div>'


def test_cards():
    page = CARD + '<div data-id="2"><a class="k7wcnx" href="http://h/2">t</a></div><div data-id="3">nothing</div>'
    assert listings.cards(page, LAYOUT) == [
        {"title": "A & B", "price": "₹9", "description": "x | y", "link": "https://shop.test/p/1", "image": "i.png", "rating": "4.6"},
        {"title": None, "price": None, "description": None, "link": "http://h/2", "image": None, "rating": None},
    ]
    assert listings.cards(None, LAYOUT) == listings.cards("", LAYOUT) == listings.cards("<p>text", LAYOUT) == []


def test_listing_caps_each_page(spark):
    pages = spark.createDataFrame([(1, CARD * 35), (2, CARD), (3, None)], "page_id long, html string")
    assert {r["page_id"]: r["count"] for r in listings.listing(pages, LAYOUT, cap=30).groupBy("page_id").count().collect()} == {1: 30, 2: 1}


RANKING = """<table class="table-list sortable"><thead><tr><th>n</th></tr></thead><tbody>
<tr><td>1</td><td><a href="/soc/x">Chip X</a><span class="text-gray-small">Brand</span></td><td><div class="table-list-score-box">99</div></td><td><div><div>1000</div><div>z</div></div></td><td><div><div>2000</div></div></td><td><span class="table-list-custom-circle">8</span></td><td>3 GHz</td><td>G1</td></tr>
<tr><td>2</td><td>none</td></tr></tbody></table>"""
DETAIL = """<h1 class="title-h1"> Chip X </h1><div class="card-block pb bt-light">About</div>
<div class="card"><h2 id="review">R</h2><div class="score-bar"><span class="score-bar-name">CPU</span><span class="score-bar-result-square">90</span></div><div class="score-bar"><span>no name</span></div></div>
<div class="card"><h2 id="antutu">A</h2><b class="score-bar-result-number">500</b><table class="specs-table"><tbody><tr><td class="cell-h">CPU</td><td class="cell-s">1</td></tr><tr><td class="cell-h"></td><td class="cell-s">2</td></tr><tr><td class="cell-h">CPU</td><td class="cell-s">3</td></tr></tbody></table></div>
<div class="card"><h3 class="title-h2">Recent AnTuTu v11 Results</h3><table class="table-list"><tbody><tr><td>1
 May</td><td>7  8</td><td>u</td><td>p</td></tr></tbody></table></div>
<div class="card"><i id="geekbench"></i><table class="specs-table"><tbody><tr><td class="cell-h">S</td><td class="cell-s">9</td></tr></tbody></table></div>
<div class="card"><i id="phones"></i><table class="table-list"><tbody><tr><td><a href="/ph">Ph</a></td><td>5</td></tr><tr><td>Bare</td></tr></tbody></table></div>
<div class="card"><h3 class="title-h2">Graphics card</h3><table class="specs-table"><tbody><tr><td class="cell-h">n</td><td class="cell-s">G</td></tr></tbody></table></div>"""


def test_ranking_rows(spark):
    pages = spark.createDataFrame([(1, RANKING)], "page_id long, html string")
    rows = chips.rankings(pages).orderBy("at").collect()
    assert rows[0].asDict() == {"page_id": 1, "at": 0, "name": "Chip X", "brand": "Brand", "rating": "99", "antutu": "1000", "geekbench": "2000", "cores": "8", "clock": "3 GHz", "gpu": "G1", "href": "/soc/x"}
    assert rows[1]["name"] is None and rows[1]["href"] is None
    assert [r["at"] for r in chips.wanted_details(chips.rankings(pages)).collect()] == [0]


def test_detail_pages(spark):
    pages = spark.createDataFrame([(1, DETAIL), (2, "<p>nothing")], "page_id long, html string")
    full, none = chips.details(pages).orderBy("page_id").collect()
    assert (full["title"], full["description"]) == ("Chip X", "About")
    assert [tuple(x) for x in full["reviewScores"]] == [("CPU", "90")]
    assert full["antutu"].asDict(True) == {"total": "500", "breakdown": {"CPU": "3"}}
    assert [tuple(x) for x in full["recentAntutu"]] == [("1 May", "7 8", "u", "p")]
    assert full["geekbench"]["breakdown"] == {"S": "9"}
    assert [tuple(x) for x in full["smartphones"]] == [("Ph", "/ph", "5"), ("Bare", None, None)]
    assert full["sections"] == {"Graphics": {"n": "G"}}
    assert none["title"] is None and none["reviewScores"] is None and none["sections"] == {}


def test_details_join_by_place(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "at int, name string")
    found = spark.createDataFrame([(1, "T", "d")], "at int, title string, description string")
    out = {r["at"]: r for r in chips.with_details(rows, found).collect()}
    assert out[0]["detailTitle"] is None and out[0]["detail"] is None
    assert out[1]["detailTitle"] == "T" and out[1]["detail"]["description"] == "d" and out[1]["detailTextSnippet"] is None


def test_upsert_knows_absent_from_null(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "title string, n int, s string")
    new = spark.createDataFrame([("b", None, True), ("c", None, False), ("d", 9, True)], "title string, n int, has boolean")
    out = {r["title"]: (r["n"], r["s"]) for r in chips.upserted(stored, new, supplied={"n": F.col("has")}).collect()}
    assert out == {"a": (1, "x"), "b": (None, "y"), "c": (3, "z"), "d": (9, None)}
    with pytest.raises(Exception, match="needs a key"):
        chips.upserted(stored, new.withColumn("title", F.lit(""))).collect()


@pytest.fixture
def talk(spark):
    rows = [("t", i, "text", "user" if i % 2 == 0 else "assistant", f"m{i}", None) for i in range(13)]
    rows += [("u", 0, "product-view", "assistant", "look", [("T", "V", 1.0, "l", "b", "i", [])]), ("u", 1, "note", "system", "n", None), ("u", 2, "product-view", "assistant", "none", [])]
    return spark.createDataFrame(rows, "thread_id string, seq bigint, type string, role string, content string, products array<struct<title: string, verdict: string, price: double, link: string, brand: string, dbRecordId: string, images: array<string>>>").withColumn("timestamp", F.current_timestamp())


def test_threads(talk):
    last = threads.last_messages(talk).where("thread_id = 't'").orderBy("seq").collect()
    assert [r["seq"] for r in last] == list(range(1, 13))
    said = {r["seq"]: r["content"] for r in threads.turns(talk).where("thread_id = 'u'").collect()}
    assert said == {0: "look\n\nProduct: T\nVerdict: V", 2: "none\n\n"}
    added = threads.appended_turn(talk, "t", "hello", "hi").collect()
    assert [(r["seq"], r["role"], r["type"]) for r in added] == [(13, "user", "text"), (14, "assistant", "text")]
    assert threads.appended_turn(talk, "n", "q", "", [("T", "", 1.0, "", "", "", [])]).collect()[1]["content"] == threads.DEFAULT_CONTENT
    for bad in (("", "x"), ("t", " ")):
        with pytest.raises(ValueError):
            threads.appended_turn(talk, *bad, "a")
    full = talk.where("thread_id = 't'").crossJoin(talk.sparkSession.range(4)).drop("id")
    with pytest.raises(ValueError):
        threads.appended_turn(full, "t", "x", "a")


def test_first_documents(spark):
    rows = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), ("b", 3, "only")], "thread_id string, _ordinal long, query string")
    assert {r["thread_id"]: r["query"] for r in threads.first_documents(rows).collect()} == {"a": "first", "b": "only"}
    assert threads.first_of_thread(rows, "a").first()["query"] == "first"
    assert threads.first_of_thread(rows, "zz").count() == 0
    with pytest.raises(ValueError):
        threads.first_of_thread(rows, " ")


def test_first_by_keeps_a_row_a_key_before_the_shuffle(spark):
    from .conftest import plan_of

    rows = spark.range(10).select(F.col("id").alias("_ordinal"), F.concat(F.lit("t"), F.col("id") % 3).alias("title"))
    assert plan_of(dedup.first_models(rows)).count("WindowGroupLimit") == 2


def test_stream_appends_up_to_the_cap(spark, tmp_path):
    kind = "thread_id string, arrived timestamp, role string, content string"
    at = "2024-01-01 00:00:0"
    for k, rows in enumerate(([("a", f"{at}{i}", "user", f"m{i}") for i in range(3)], [("a", f"{at}{i}", "user", f"m{i}") for i in range(3, 6)] + [("b", f"{at}1", "user", "x")])):
        spark.createDataFrame(rows, "thread_id string, arrived string, role string, content string").withColumn("arrived", F.to_timestamp("arrived")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        append_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), most=4).awaitTermination(60)
    kept = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["thread_id"], r["seq"], r["content"]) for r in kept) == [("a", 0, "m0"), ("a", 1, "m1"), ("a", 2, "m2"), ("a", 3, "m3"), ("b", 0, "x")]
    assert spark.read.parquet(str(tmp_path / "out-rejected")).count() == 2


def test_schemas_parse(spark):
    for ddl in (schemas.CATALOGUE, schemas.MESSAGE, schemas.CHIP, schemas.LISTING, schemas.RANKING):
        assert spark.createDataFrame([], ddl).count() == 0


def record(i, **more):
    return {"_id": f"d{i}", "title": f"T{i}", "price": 100.0 + i, **more}


@pytest.mark.parametrize("layout", ["lines", "array", "parquet"])
def test_places_follow_files_and_rows_however_files_are_split(spark, tmp_path, layout):
    """Files of very different sizes, small ones packed together, read under two split layouts."""
    sizes, at = {"c": 3, "a": 4000, "b": 400, "d": 1}, 0
    wanted = []
    for name in sorted(sizes):
        rows = [record(at + k, link="x" * 60) for k in range(sizes[name])]
        at += len(rows)
        wanted += [r["_id"] for r in rows]
        place = tmp_path / f"{name}.json"
        if layout == "parquet":
            spark.read.schema(schemas.CATALOGUE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1)).coalesce(1).write.parquet(str(tmp_path / f"p_{name}"))
            (part,) = (tmp_path / f"p_{name}").glob("*.parquet")
            (tmp_path / "in").mkdir(exist_ok=True)
            part.rename(tmp_path / "in" / f"{name}.parquet")
        else:
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / place.name).write_text(json.dumps(rows) if layout == "array" else "\n".join(map(json.dumps, rows)))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    numbers = []
    try:
        for most, cost in (("128m", "4m"), ("20k", "1k")):
            spark.conf.set(names[0], most)
            spark.conf.set(names[1], cost)
            rows = catalogue.read_catalogue(spark, str(tmp_path / "in"), layout).orderBy("_ordinal").select("_id", "_ordinal").collect()
            assert [r["_id"] for r in rows] == wanted and len({r["_ordinal"] for r in rows}) == len(rows)
            numbers.append([r["_ordinal"] for r in rows])
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert layout != "parquet" or numbers[0] == numbers[1]


def test_values_of_the_wrong_type_are_missing(spark, tmp_path):
    def own(i, capacity, cpu):
        extracted = {"battery": {"capacity": {"value": capacity, "unit": "mAh"}}, "technical": {"benchmark": {"antutu": {"breakdown": {"CPU": cpu, "GPU": "5"}}}}}
        return {"_id": i, "title": "T", "price": 5, "normalizedSpecs": {"specs": {"memory": {"ram": "8 GB"}}, "extracted": extracted}}

    rows = [own("a", 4000, "123"), own("b", "4000", 123), own("c", None, None), {"_id": 7, "title": "T", "price": "9"}]
    (tmp_path / "v.json").write_text(json.dumps(rows))
    found = catalogue.typed_catalogue(catalogue.read_variants(spark, str(tmp_path / "v.json"))).orderBy("_ordinal")
    got = found.select("_id", "price", F.col("normalizedSpecs.extracted.battery.capacity.value"), F.col("normalizedSpecs.extracted.technical.benchmark.antutu.breakdown")["CPU"], F.col("normalizedSpecs.specs")["memory"]["ram"]).collect()
    assert [tuple(r) for r in got] == [("a", 5.0, 4000.0, "123", "8 GB"), ("b", 5.0, None, None, "8 GB"), ("c", 5.0, None, None, "8 GB"), (None, None, None, None, None)]


def test_pages_from_folders_and_addresses(spark, tmp_path):
    (tmp_path / "soc.html").write_text(RANKING)
    for path in (str(tmp_path), f"file://{tmp_path}/soc.html"):
        pages = chips.read_pages(spark, path)
        assert pages.count() == 1 and pages.first()["base"].endswith(f"{tmp_path}/")
        assert chips.rankings(pages).where("name = 'Chip X'").count() == 1
    asked = []
    pages = chips.read_pages(spark, "https:\\\\shop.test\\soc", lambda address: asked.append(address) or RANKING)
    assert asked == ["https://shop.test/soc"] and chips.rankings(pages).count() == 2
    with pytest.raises(ValueError):
        chips.read_pages(spark, "http:/shop.test")


def test_store(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/threads")
    assert store.lookup("t") is None
    first, second = store.insert("t", "phones"), store.insert("t", "again")
    assert first != second and store.lookup("t")["_id"] == first and store.read_back(second)["query"] == "again"
    assert store.found_or_inserted("t", "x")["_id"] == first and store.found_or_inserted("u", "new")["query"] == "new"
    assert store.read_back(store.insert(None, "q"))["thread_id"].startswith("thread_")
    assert store.append(first, "hello", "hi") == 2 and store.append(first, "and", "so", [("T", "V", 1.0, "l", "b", "i", [])]) == 4
    rows = store.messages(first).orderBy("seq").collect()
    assert [(r["seq"], r["role"], r["type"]) for r in rows] == [(0, "user", "text"), (1, "assistant", "text"), (2, "user", "text"), (3, "assistant", "product-view")]
    assert store.messages(second).count() == 0
    with pytest.raises(ValueError):
        store.append(first, "x", "y", most=4)


def test_a_thread_without_products_gets_them_and_is_talked_about_then(spark, sf_dir, tmp_path):
    from shelfrank.plans import adapter

    store, devices = Store(spark, f"{tmp_path}/threads"), adapter.catalogue(spark, sf_dir)
    found = conversation.reply(store, devices, "t", "camera phone between 901 and 1000")
    assert 0 < len(found.products) <= 8 and found.said == threads.DEFAULT_CONTENT
    told = []
    again = conversation.reply(store, devices, "t", f"and {found.products[1]['title']}?", answer=lambda context: told.append(context) or conversation.named_product(context))
    assert again.products == [] and again.said.startswith(f"{found.products[1]['title']} costs")
    assert [m["role"] for m in told[0]] == ["system", "user", "assistant", "user"] and len(json.loads(told[0][0]["content"])["products"]) == len(found.products)
    assert "Product: " in told[0][2]["content"]
    asked = conversation.reply(store, devices, "v", "phone under 20k, can extend")
    assert asked.said == planner.EXTENSION_QUESTION and asked.products == []
    nothing = conversation.reply(store, devices, "w", "phone under 5")
    assert nothing.said.split("\n") == planner.BLANK_QUESTIONS
    for bad in ((" ", "x"), ("t", "")):
        with pytest.raises(ValueError):
            conversation.reply(store, devices, *bad)


def test_stream_orders_ties_and_refuses_another_streams_table(spark, tmp_path):
    kind = "thread_id string, arrived timestamp, role string, content string"
    rows = [("a", f"m{i:02}") for i in range(30)]
    spark.createDataFrame(rows, "thread_id string, content string").selectExpr("thread_id", "timestamp'2024-01-01' AS arrived", "'user' AS role", "content").repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), most=20).awaitTermination(60)
    kept = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r["seq"], r["content"]) for r in kept] == [(i, f"m{i:02}") for i in range(20)]
    assert spark.read.parquet(str(tmp_path / "out-rejected")).where("seq is null").count() == 10
    with pytest.raises(ValueError):
        append_stream(stream, str(tmp_path / "out"), str(tmp_path / "other"))


def test_places_count_over_arrays_of_many_tasks(spark, tmp_path):
    path = str(tmp_path / "arrays")
    rows = spark.range(500).selectExpr("cast(id as string) _id", "concat('t', id) title").repartitionByRange(6, F.col("_id").cast("int"))
    catalogue.export(rows, path, layout="array")
    assert len(list((tmp_path / "arrays").glob("part-*"))) > 1
    found = catalogue.numbered(catalogue.read_catalogue(spark, path))
    assert sorted((r["place"], r["_id"]) for r in found.select("place", "_id").collect()) == [(k, str(k)) for k in range(500)]
