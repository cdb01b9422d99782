"""Price and facet filters, with reasons."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Budgets of this much and more stretch by the first amount, smaller ones by the second.
LARGE_BUDGET, LARGE_EXTENSION, SMALL_EXTENSION = 20000, 1000, 500


@dataclass(frozen=True)
class Budget:
    budget: float
    extension: float | None = None


@dataclass(frozen=True)
class Query:
    text: str
    max_price: float | None = None
    min_price: float | None = None
    brands: list[str] | None = None
    storage: str | None = None
    ram: list[str] | None = None
    budget: Budget | None = None


@dataclass(frozen=True)
class Clarification:
    questions: list[str] = field(default_factory=list)


def effective_maximum(budget: Column, extension: Column) -> Column:
    """A budget with its stretch: the amount named, 0 included, else one that depends on the budget."""
    own = F.when(budget >= LARGE_BUDGET, budget + LARGE_EXTENSION).otherwise(budget + SMALL_EXTENSION)
    return F.when(extension.isNotNull(), budget + extension).otherwise(own)


def price_check(price: Column, query: Query, derive_maximum: bool = False) -> Column:
    """struct(passed, reason, limit): the checks in order are the minimum, that there is a maximum, and the limit.

    A missing or NaN price passes both comparisons. Without a maximum (or with 0) nothing passes; derive_maximum takes
    the budget for one instead.
    """
    most = query.max_price or (query.budget.budget if derive_maximum and query.budget else None)
    low = F.lit(None).cast("double") if query.min_price is None else F.lit(float(query.min_price))
    price = F.when(~F.isnan(price), price)
    if most and query.budget:
        extension = F.lit(None).cast("double") if query.budget.extension is None else F.lit(float(query.budget.extension))
        limit = F.greatest(F.lit(float(most)), effective_maximum(F.lit(float(query.budget.budget)), extension))
    else:
        limit = F.lit(float(most)) if most else F.lit(None).cast("double")
    below, above = F.coalesce(price < low, F.lit(False)), F.coalesce(price > limit, F.lit(False))
    shown = text.number_text
    reason = (
        F.when(below, F.concat(F.lit("price "), shown(price), F.lit(" is below the minimum "), shown(low)))
        .when(limit.isNull(), F.lit("no maximum price"))
        .when(above, F.concat(F.lit("price "), shown(price), F.lit(" is above the limit "), shown(limit)))
    )
    return F.struct((~below & limit.isNotNull() & ~above).alias("passed"), reason.alias("reason"), F.when(~below, limit).alias("limit"))


def within_price(devices: DataFrame, query: Query, derive_maximum: bool = False) -> DataFrame:
    return devices.where(price_check(F.col("price"), query, derive_maximum)["passed"])


def with_facets(devices: DataFrame, query: Query) -> DataFrame:
    """Filters by brand, memory and storage as well, which ranking by itself leaves to the search address."""
    memory = F.col("normalizedSpecs.specs")["memory"]
    tests = []
    if query.brands:
        tests.append(F.lower("brand").isin(*(b.lower() for b in query.brands)))
    if query.ram:
        wanted = [text.ram_gb(F.lit(r)) for r in query.ram]
        tests.append(reduce(lambda a, b: a | b, (text.ram_gb(memory["ram"]) == w for w in wanted)))
    if query.storage:
        tests.append(text.rom_gb(memory["storage"]) == text.rom_gb(F.lit(query.storage)))
    return devices.where(reduce(lambda a, b: a & b, tests)) if tests else devices
