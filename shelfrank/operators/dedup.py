"""First of each key, in input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def first_by(rows: DataFrame, key: Column, ordinal: str = "_ordinal") -> DataFrame:
    """The first row of each key; rows of a null or empty key are dropped. Each task keeps one row a key before the
    shuffle, so a common key isn't heavy."""
    keyed = rows.withColumn("__key", key).where(F.col("__key") != "")
    return keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(ordinal))).where("__n = 1").drop("__key", "__n")


def first_models(rows: DataFrame, title: str = "title", ordinal: str = "_ordinal") -> DataFrame:
    return first_by(rows, text.base_model(title), ordinal)


def first_by_title(rows: DataFrame, title: str = "title", ordinal: str = "_ordinal") -> DataFrame:
    return first_by(rows, F.col(title), ordinal)


def appended(*pages: DataFrame) -> DataFrame:
    """Pages one after another: all rows, repeats included, with their page's number."""
    out = None
    for k, page in enumerate(pages):
        own = page.withColumn("page_no", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def first_n_each(rows: DataFrame, group: str, ordinal: str, n: int) -> DataFrame:
    """The first n rows of each group: a page's cards up to a cap, detail pages of a crawl."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(ordinal))
    return rows.withColumn("__n", at).where(F.col("__n") <= n).drop("__n")
