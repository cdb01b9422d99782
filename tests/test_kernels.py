"""Scalar kernels against hand-computed values."""

import math
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from shelfrank.functions import numbers, text
from shelfrank.operators import filters, threads
from shelfrank.operators.filters import Budget, Query

from .conftest import plan_of


def over(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_number_prefix(spark):
    given = {"448527": 448527.0, "1,234": 1.0, "12abc": 12.0, ".5": 0.5, "1e3": 1000.0, "-2.": -2.0, "  7": 7.0, "": None, "abc": None, "Infinity": None, None: None, "1e999": math.inf, "+3x": 3.0}
    assert over(spark, text.number_prefix("x"), list(given)) == list(given.values())


def test_number_text(spark):
    assert over(spark, text.number_text("x"), [30000.0, 0.5, -1.0, None], "double") == ["30000", "0.5", "-1", None]


@pytest.mark.parametrize(
    ("title", "model"),
    [
        (None, ""),
        ("Phone 15 (White Titanium, 512 GB)", "phone 15"),
        ("Phone X 8GB RAM 128 GB ROM Black", "phone x"),
        ("Reddish redmi RED", "reddish redmi"),
        ("éred note", "é note"),
        ("Phone  A  1 TB", "phone a"),
        ("A,256 GB Black", "a,"),
        ("64GBx stays", "64gbx stays"),
        ("(all gone)", ""),
    ],
)
def test_base_model(spark, title, model):
    assert over(spark, text.base_model("x"), [title]) == [model]


def test_tokens(spark):
    assert over(spark, text.tokens(text.without_brackets("x")), [" A  b A (c d) E", None, "  "]) == [["a", "b", "a", "e"], [], []]


def test_capacities(spark):
    given = ["8 GB", "12GB", "8 GB + 8 GB Virtual", "512 MB", "0 GB", "1.5 tb", "256 GB, up to 1 TB", None]
    assert over(spark, text.ram_gb("x"), given) == [8.0, 12.0, 8.0, None, None, None, 256.0, None]
    assert over(spark, text.rom_gb("x"), given) == [8.0, 12.0, 8.0, None, None, 1536.0, 1024.0, None]


def test_links_ratings_and_the_like(spark):
    assert over(spark, text.absolute_link("x", "https://h"), ["http://a", "/p", "", None]) == ["http://a", "https://h/p", None, None]
    assert over(spark, text.rating_prefix("x"), ["4.6(1,200)", "4", "none", None]) == ["4.6", "4", None, None]
    assert over(spark, text.url_slashes("x"), ["https:\\\\a\\b", "http:////c", "file"]) == ["https://a/b", "http://c", "file"]
    assert over(spark, text.bearer_token("x"), ["bearer ab c", "Basic x"]) == ["ab c", None]
    assert over(spark, text.trim("x"), ["　 a b\t﻿"]) == ["a b"]


def test_normalise(spark):
    lit = lambda v: F.lit(float(v))
    values = [None, math.nan, 5.0, -1.0, 20.0, 2.5]
    assert over(spark, numbers.normalise(F.col("x"), lit(0), lit(10)), values, "double") == [0.0, 0.0, 0.5, 0.0, 1.0, 0.25]
    assert over(spark, numbers.normalise(F.col("x"), lit(3), lit(3)), [None, 9.0], "double") == [0.0, 0.5]


def test_largest_skips_what_is_no_number(spark):
    given = [[1.0, 5.0, None], [], None, [-1.0, -3.0], [math.nan, 2.0, math.inf]]
    assert over(spark, numbers.largest(F.col("x")), given, "array<double>") == [5.0, None, None, None, 2.0]


@pytest.mark.parametrize(
    ("price", "low", "most", "budget", "extension", "passes", "limit"),
    [
        (100, None, None, None, None, False, None),
        (100, None, 0, None, None, False, None),
        (25000, None, None, 30000, 2000, False, None),
        (25000, 25000, 25000, None, None, True, 25000),
        (20900, None, 20000, 20000, None, True, 21000),
        (20400, None, 19999, 19999, None, True, 20499),
        (20500, None, 19999, 19999, None, False, 20499),
        (20001, None, 20000, 20000, 0, False, 20000),
        (40000, None, 50000, 30000, 1000, True, 50000),
        (None, 5, 10, None, None, True, 10),
        (math.nan, 5, 10, None, None, True, 10),
    ],
)
def test_price_check(spark, price, low, most, budget, extension, passes, limit):
    query = Query("q", most, low, budget=None if budget is None else Budget(budget, extension))
    found = over(spark, filters.price_check(F.col("x"), query), [None if price is None else float(price)], "double")[0]
    assert (found["passed"], found["limit"]) == (passes, limit)
    assert (found["reason"] is None) == passes


def test_budget_serves_as_maximum_only_on_request(spark):
    query = Query("q", budget=Budget(100.0, 5.0))
    column = lambda d: filters.price_check(F.col("x"), query, d)["passed"]
    assert over(spark, column(False), [104.0, 106.0], "double") == [False, False]
    assert over(spark, column(True), [104.0, 106.0], "double") == [True, False]


def test_last_elements(spark):
    given = [[], [1, 2], list(range(14))]
    assert over(spark, threads.last_elements(F.col("x")), given, "array<int>") == [[], [1, 2], list(range(2, 14))]


ODD_LINKS = "g:h|g|./g|g/|/g|//g|?y|g?y|#s|g#s|g?y#s|;x|g;x|g;x?y#s||.|./|..|../|../g|../..|../../|../../g|../../../g|../../../../g|/./g|/../g|g.|.g|g..|..g|./../g|./g/.|g/./h|g/../h|g;x=1/./y|g;x=1/../y|g?y/./x|g?y/../x|g#s/./x|g#s/../x|http:g|http:|mailto:a@b|//h|//h/p?q|?|#|a//b|//|///x|..;x|a:b/c|é/漢?ü| g|g\nh|javascript:x|/a;p/b;q|g/..//h|https:g|HTTP:g|tel:+1|a b|%2e%2e/x|file:x|..//|/..//x//y|x:|https://o/./x|FILE:///y".split("|")


def test_links_resolve_as_the_standard_library_does(spark):
    """Every odd link against every odd base, without a Python worker."""
    bases = ["http://a/b/c/d;p?q", "https://a.b/x/", "https://a.b", "https://a.b?q=1", "http://a/b//c/d", "http://u:p@h:8/q#f", "", "http://a/b/../c/./d", "HTTPS://A/b/", "mailto:x@y"]
    df = spark.createDataFrame([(b, h) for b in bases for h in ODD_LINKS], "b string, h string").select("b", "h", text.resolved("b", "h").alias("link"))
    assert "Python" not in plan_of(df) and "MapIn" not in plan_of(df)
    for b, h, link in df.collect():
        wanted = h if not b or re.match("(?i)https?://|file://", h) else urljoin(b, h)
        assert link == wanted, (b, h)
    # Above the root of a file's path there is nothing; missing links and bases.
    few = spark.createDataFrame([("file:///x/y", "../../g"), ("file:///x/y", "z"), (None, "x"), ("https://a", None)], "b string, h string")
    assert [r[0] for r in few.select(text.resolved("b", "h")).collect()] == ["file:///g", "file:///x/z", "x", None]
