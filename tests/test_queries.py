"""Every registered query against its SQL, on the smallest tables."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from shelfrank.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return [columns[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    wanted = duck.execute(catalog.ORACLES[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in wanted.description], wanted.fetchall())


@pytest.mark.parametrize("gone", [["shelfrank/llm", "tests/llm"], ["shelfrank/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, gone):
    root = Path(contract.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        place = tmp_path / "copy" / g
        shutil.rmtree(place) if place.is_dir() else place.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))], said.stderr


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
