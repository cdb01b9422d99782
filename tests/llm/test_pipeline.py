"""Stages against brute force, on rows with planted copies, passages and personal data."""

import random

import pyarrow as pa
import pytest

from .conftest import prose
from .test_jaccard import least_of_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = [prose(rng, "en", rng.randint(40, 200)) for _ in range(60)]
    near = texts[3].split()
    near[10] = "other"
    passage = " ".join(prose(rng, "de", 40).split())
    texts += [texts[0], texts[0], " ".join(near), "12345 !!", None, "", prose(rng, "en", 60) + " " + passage, "write to jo@mail.example.com or call 415-555-2671"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    place = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place), texts


def test_stages_take_effect(spark, corpus):
    place, texts = corpus
    docs, kept = spark.read.parquet(f"{place}/documents.parquet"), [set(range(len(texts)))]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.staged(out, "test")
        kept.append({r["doc_id"] for r in docs.collect()})
    n = len(texts)
    assert kept[0] - kept[1] == {n - 5, n - 4, n - 3}
    rows = [(i, texts[i]) for i in sorted(kept[1])]
    assert kept[2] == {rows[k][0] for k in least_of_components([t for _, t in rows])}
    assert kept[1] - kept[2] >= {60, 61, 62}
    assert kept[2] - kept[3] == {n - 2}
    last = {r["doc_id"]: r for r in docs.collect()}
    assert "jo@mail" not in last[n - 1]["text"] and "555-2671" not in last[n - 1]["text"] and last[n - 1]["n_chars"] == len(last[n - 1]["text"])
    assert all(last[i]["text"] == texts[i] for i in last if i != n - 1)


def test_run(spark, corpus):
    place, _ = corpus
    rows = corpus_pipeline.run(spark, place).collect()
    assert rows and all(len(r["ids"]) == r["n_tokens"] and r["text"] for r in rows)


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    rng = random.Random(2)
    a, b = prose(rng, "en", 60), prose(rng, "de", 60)
    rows = [(1, a), (1, b), (None, prose(rng, "en", 60)), (None, prose(rng, "de", 60)), (2, a), (2, a)]
    docs = corpus_pipeline.staged(spark.createDataFrame([(i, t, "l", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "test")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=repr) == sorted(rows[:4], key=repr)


def test_a_run_leaves_its_last_staged_table_alone(spark, corpus):
    from shelfrank.llm.shared import Stage

    place, _ = corpus
    with Stage() as own:
        out = corpus_pipeline.run(spark, place)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    exists = lambda f: jvm.org.apache.hadoop.fs.Path(f).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(f))
    left = {f.rsplit("/", 1)[0] for t in own.made for f in t.inputFiles() if exists(f)}
    assert len(left) == 1 and "staged-pii" in next(iter(left)) and out.count() > 0


def test_no_rows(spark, corpus):
    place, _ = corpus
    docs = spark.read.parquet(f"{place}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, place).count() == 0


def test_rows_keep_their_numbers_when_input_is_split_anew(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, prose(rng, "en", 60), "l", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/docs")
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[2], "1")
        kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
        for n in names[:2]:
            spark.conf.set(n, "4096")
        spark.conf.set(names[2], "4")
        assert {r["doc_id"] for r in kept.collect()} == set(range(40))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v else spark.conf.unset(n)


def test_columns_of_any_name_may_stand_beside(spark, corpus):
    """Extra columns under the stages' and operators' own names come through, and nothing else changes."""
    place, _ = corpus
    docs = spark.read.parquet(f"{place}/documents.parquet")
    extra = ["id", "margin", "rejected", "lang_pred", "hits", "items", "n_words", "label", "fp", "component_id", "row", "__body", "words", "pii_kinds", "body", "score", "ids", "n_tokens"]
    wide = corpus_pipeline.staged(docs.selectExpr("*", *(f"'kept' AS `{c}`" for c in extra)), "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        narrow, out = stage(spark, docs, place), stage(spark, wide, place)
        assert out.columns == wide.columns, name
        assert out.where(" or ".join(f"`{c}` <> 'kept'" for c in extra)).count() == 0, name
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in narrow.collect()), name
    last = corpus_pipeline.STAGES[-1][1](spark, wide, place)
    assert last.where("ids_before <> 'kept' or n_tokens_before <> 'kept'").count() == 0
    assert {"margin", "label", "source", "n_chars"} <= set(last.columns) and len(set(last.columns)) == len(last.columns)
    assert all(len(r["ids"]) == r["n_tokens"] for r in last.collect())


def test_stages_take_awkward_rows(spark, awkward, corpus):
    place, _ = corpus
    docs = corpus_pipeline.staged(spark.createDataFrame([(i, t, "l", "s", None) for i, t in awkward], "doc_id long, text string, lang string, source string, n_chars long"), "test")
    rows = {name: [(r["doc_id"], r["text"]) for r in stage(spark, docs, place).collect()] for name, stage in corpus_pipeline.STAGES}
    order = lambda x: sorted(x, key=repr)
    lettered = [(i, t) for i, t in awkward if t and any(c.isalpha() for c in t)]
    assert order(rows["language id"]) == order(lettered)
    assert order(rows["pii"]) == order(awkward) and order(rows["byte-level bpe"]) == order((i, t or "") for i, t in awkward)
    assert order(rows["benchmark decontamination"]) == order(awkward)
    kept = rows["simhash near-dedup"]
    assert len(kept) == len(set(kept)) and sum(not (t or "").strip() for _, t in kept) == 1  # wordless texts are copies of each other


def test_whole_documents_reach_python_in_short_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(5000).selectExpr("id doc_id", "'the text' text", "'en' lang")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        beside = corpus_pipeline._beside(docs).coalesce(1)
        assert max(r["n"] for r in beside.mapInArrow(sizes, "n long").collect()) <= 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
