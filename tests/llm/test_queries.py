"""The registered queries: on empty tables, on tables of nulls, and beside their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from shelfrank.llm import queries

NAN = float("nan")
TABLES = {
    "empty": ([], [], [], []),
    "nulls": (
        [(1, None, None), (None, None, None), (None, "some text here", "en"), (2, "", "en"), (3, "x " * 3000, None), (3, "x " * 3000, None)],
        [(0, None), (None, [1.0, 2.0]), (20, [0.0, 0.0]), (40, [1.0, NAN]), (60, [None, 1.0])],
        [(1, None), (None, 1), (3, 1)],
        [(None, None), (1, None), (None, "some text")],
    ),
}


def write(place, docs, vectors, labels, items):
    col = lambda rows, k, kind: pa.array([r[k] for r in rows], kind)
    none = lambda rows, kind: pa.array([None] * len(rows), kind)
    pq.write_table(pa.table({"doc_id": col(docs, 0, pa.int64()), "text": col(docs, 1, pa.string()), "lang": col(docs, 2, pa.string()), "source": none(docs, pa.string()), "n_chars": none(docs, pa.int64())}), f"{place}/documents.parquet")
    pq.write_table(pa.table({"vec_id": col(vectors, 0, pa.int64()), "embedding": col(vectors, 1, pa.list_(pa.float32())), "label": none(vectors, pa.int32())}), f"{place}/embeddings.parquet")
    pq.write_table(pa.table({"doc_id": col(labels, 0, pa.int64()), "quality": col(labels, 1, pa.int64()), "toxic": none(labels, pa.int64())}), f"{place}/labels.parquet")
    pq.write_table(pa.table({"item_id": col(items, 0, pa.int64()), "text": col(items, 1, pa.string())}), f"{place}/benchmark.parquet")


@pytest.mark.parametrize("kind", list(TABLES))
@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_awkward_tables(spark, tmp_path, name, kind):
    write(tmp_path, *TABLES[kind])
    run = contract.queries().get(name)
    if run is None:
        pytest.skip("there is no pipeline here")
    rows = run(spark, str(tmp_path)).collect()
    if kind == "empty" or name in ("op6_neighbours", "op12_centroids"):
        assert rows == []
    elif name == "op13_spelling":
        assert rows == []  # no word of seven letters stands twice
    elif name == "pipeline":
        assert [r["doc_id"] for r in rows] == [3]  # one of the copies; the row without an id holds the last item
    else:
        assert len(rows) == len(TABLES[kind][0])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    wanted = c.execute(queries.ORACLES[name])
    names = [d[0] for d in wanted.description]
    found = queries.QUERIES[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(wanted.fetchall(), key=repr)
    assert name != "op2_decontaminate" or any(r["contaminated"] for r in found)


def test_each_operator_has_its_query():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(queries.ORACLES) <= set(queries.QUERIES)
