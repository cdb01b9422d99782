"""Validation, normalisation over the candidates, weighted scores and the top of the ranking.

A category is data: the values it reads, how they are combined and which must be there. From the registry follow the
validators, one aggregate with all minima and maxima, and the score columns. Every value is parsed once, in `derive`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import finite, largest, normalise


@dataclass(frozen=True)
class Part:
    """One value of a category: its name, how to read it, its share, and whether a record is invalid without it."""

    name: str
    read: Callable[[], Column]
    share: float | None = None
    required: bool = True
    default: tuple[float, float] = (0.0, 1.0)


@dataclass(frozen=True)
class Category:
    name: str
    parts: tuple[Part, ...]


def _extracted(path: str) -> Column:
    return F.col(f"normalizedSpecs.extracted.{path}")


def _score(part: str) -> Callable[[], Column]:
    return lambda: finite(text.number_prefix(_extracted("technical.benchmark.antutu.breakdown")[part]))


def _optional(path: str) -> Callable[[], Column]:
    return lambda: F.when(~F.isnan(_extracted(path)), _extracted(path))


def _memory(key: str, parse: Callable[[Column], Column]) -> Callable[[], Column]:
    return lambda: parse(F.col("normalizedSpecs.specs")["memory"][key])


def _camera(side: str) -> Callable[[], Column]:
    return lambda: largest(F.transform(_extracted(f"camera.{side}"), lambda c: c["megapixel"]))


#: The categories in order, what they read, and the shares of their parts.
CATEGORIES = (
    Category("batteryEndurance", (Part("capacity", lambda: finite(_extracted("battery.capacity.value"))),)),
    Category(
        "displayQuality",
        (
            Part("displayType", lambda: finite(_extracted("display.type.score")), 0.5, True, (0.0, 10.0)),
            Part("ppi", _optional("display.ppi.value"), 0.2, False),
            Part("refreshRate", _optional("display.refreshRate.value"), 0.15, False),
            Part("brightness", _optional("display.brightness.value"), 0.15, False),
        ),
    ),
    Category("cpuPerformance", (Part("cpu", _score("CPU")),)),
    Category("gpuPerformance", (Part("gpu", _score("GPU")),)),
    Category("cameraQuality", (Part("rearCamera", _camera("rearCamera"), 0.7), Part("frontCamera", _camera("frontCamera"), 0.3))),
    Category("ramCapacity", (Part("ram", _memory("ram", text.ram_gb)),)),
    Category("romCapacity", (Part("rom", _memory("storage", text.rom_gb)),)),
)


def _ladder(x: Column, steps: list[tuple[list[str], float]], rest: float) -> Column:
    out = F.lit(rest)
    for words, value in reversed(steps):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words)), F.lit(value)).otherwise(out)
    return out


def _software() -> Column:
    """0.4 system + 0.3 surface + 0.3 brand, each from a ladder of keywords (fixed values)."""
    technical = F.col("normalizedSpecs.specs")["technical"]
    first = lambda *keys: F.lower(F.coalesce(*(F.nullif(technical[k], F.lit("")) for k in keys), F.lit("")))
    system = _ladder(
        first("OS", "Operating System"),
        [(["android 14", "android 15"], 10.0), (["android 13", "android 12"], 8.0), (["android 11", "android 10"], 6.0), (["android"], 5.0), (["ios 17", "ios 18"], 10.0), (["ios 16", "ios 15"], 8.0), (["ios"], 7.0)],
        3.0,
    )
    ui = first("Custom UI", "User Interface", "UI")
    surface = F.when(ui.isin("", "none"), F.lit(10.0)).otherwise(_ladder(ui, [(["stock", "pure", "vanilla"], 10.0), (["one ui", "oxygenos", "coloros", "miui"], 7.0)], 5.0))
    maker = F.lower(F.coalesce(F.nullif("brand", F.lit("")), F.col("normalizedSpecs.meta.brand"), F.lit("")))
    policy = _ladder(maker, [(["google", "pixel", "samsung", "oneplus", "apple"], 10.0), (["xiaomi", "oppo", "vivo", "realme"], 6.0)], 5.0)
    return system * 0.4 + surface * 0.3 + policy * 0.3


#: An optional further category.
SOFTWARE = Category("softwareExperience", (Part("software", _software, None, False),))

Weights = dict[str, float]


def checked_weights(weights: Weights, categories: tuple[Category, ...] = CATEGORIES) -> Weights:
    """The weights, if there is one from 0 to 1 for each category, no other, and their sum is 1 within 0.01."""
    names = [c.name for c in categories]
    if sorted(weights) != sorted(names):
        raise ValueError(f"weights are needed for exactly {names}")
    if any(not 0 <= w <= 1 for w in weights.values()):
        raise ValueError("each weight is from 0 to 1")
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError("the weights' sum is 1")
    return weights


def _parts(categories: tuple[Category, ...]) -> list[Part]:
    return [p for c in categories for p in c.parts]


def derive(devices: DataFrame, categories: tuple[Category, ...] = CATEGORIES) -> DataFrame:
    """devices with every value the categories read, in a struct _v; null where it is missing or no finite number."""
    return devices.withColumn("_v", F.struct(*(p.read().alias(p.name) for p in _parts(categories))))


def valid(category: Category) -> Column:
    """Over derived rows: whether all that the category requires is there."""
    return reduce(lambda a, b: a & b, (F.col("_v")[p.name].isNotNull() for p in category.parts if p.required), F.lit(True))


def failed_categories(categories: tuple[Category, ...] = CATEGORIES) -> Column:
    return F.array_compact(F.array(*(F.when(~valid(c), F.lit(c.name)) for c in categories)))


def validated(derived: DataFrame, categories: tuple[Category, ...] = CATEGORIES) -> DataFrame:
    return derived.where(reduce(lambda a, b: a & b, map(valid, categories)))


def context(rows: DataFrame, categories: tuple[Category, ...] = CATEGORIES) -> DataFrame:
    """One row with the least and the largest of every value, in one pass; defaults where there is none."""
    found = []
    for p in _parts(categories):
        v = F.col("_v")[p.name]
        found += [F.coalesce(F.min(v), F.lit(p.default[0])).alias(f"{p.name}_min"), F.coalesce(F.max(v), F.lit(p.default[1])).alias(f"{p.name}_max")]
    return rows.agg(*found)


def raw_score(category: Category) -> Column:
    """Over derived rows beside the context: the category's score from 0 to 1."""
    total = None
    for p in category.parts:
        own = normalise(F.col("_v")[p.name], F.col(f"{p.name}_min"), F.col(f"{p.name}_max"))
        own = own if p.share is None else own * F.lit(p.share)
        total = own if total is None else total + own
    return total


def scored(rows: DataFrame, weights: Weights, categories: tuple[Category, ...] = CATEGORIES, among: DataFrame | None = None) -> DataFrame:
    """rows with a struct (rawScore, weightedScore) for each category and their sum, added in the categories' order.
    among: the rows that scores are relative to, rows themselves by default."""
    beside = rows.crossJoin(F.broadcast(context(rows if among is None else among, categories)))  # the context is one row
    bounds = [f"{p.name}_{end}" for p in _parts(categories) for end in ("min", "max")]
    raws = beside.withColumn("_raw", F.struct(*(raw_score(c).alias(c.name) for c in categories))).drop(*bounds)
    each = {c.name: F.struct(F.col("_raw")[c.name].alias("rawScore"), (F.col("_raw")[c.name] * F.lit(float(weights[c.name]))).alias("weightedScore")) for c in categories}
    out = raws.withColumns(each)
    return out.withColumn("totalWeightedScore", reduce(lambda a, b: a + b, (F.col(c.name)["weightedScore"] for c in categories))).drop("_raw")


def rank(devices: DataFrame, weights: Weights, n: int = 20, categories: tuple[Category, ...] = CATEGORIES) -> DataFrame:
    """The n best valid records, best first; ties keep the order of _ordinal. Scores are relative to the candidates."""
    rows = scored(validated(derive(devices, categories), categories), checked_weights(weights, categories), categories)
    return rows.orderBy(F.desc("totalWeightedScore"), F.asc("_ordinal")).limit(n)


def presented(ranked: DataFrame, categories: tuple[Category, ...] = CATEGORIES) -> DataFrame:
    """The columns of a ranked result."""
    return ranked.select("link", "title", "brand", F.col("parseHtmlSpec.specs").alias("specs"), F.coalesce("images", F.array().cast("array<string>")).alias("images"), "price", F.col("_id").alias("dbRecordId"), *(c.name for c in categories), "totalWeightedScore", "_ordinal")


def short_format(ranked: DataFrame) -> DataFrame:
    return ranked.select("title", "link", F.col("totalWeightedScore").alias("score"))


def enriched(devices: DataFrame, title: Column | None = None) -> DataFrame:
    """devices with realTitle (their own, or one matched), images never null, and dbRecordId."""
    return devices.withColumns({"realTitle": F.col("title") if title is None else title, "images": F.coalesce("images", F.array().cast("array<string>")), "dbRecordId": F.col("_id")})


def tracked(devices: DataFrame, weights: Weights, categories: tuple[Category, ...] = CATEGORIES) -> DataFrame:
    """(_id, title, _ordinal, steps): what happened to each record, as an array of (name, details).

    validation says what failed; scoring, of valid records only, their total and categories as JSON. Entries are by
    record; `tracked_by_title` has one chain for each title.
    """
    rows = derive(devices, categories)
    all_of = scored(rows, weights, categories, among=validated(rows, categories)).withColumn("_failed", failed_categories(categories))
    step = lambda name, details: F.struct(F.lit(name).alias("name"), details.alias("details"))
    passed = F.size("_failed") == 0
    checks = step("validation", F.to_json(F.struct(passed.alias("valid"), F.col("_failed").alias("failedProcessors"))))
    totals = step("scoring", F.to_json(F.struct(F.col("totalWeightedScore").alias("total"), *(c.name for c in categories))))
    return all_of.select("_id", "title", "_ordinal", F.array_compact(F.array(checks, F.when(passed, totals))).alias("steps"))


def tracked_by_title(devices: DataFrame, weights: Weights, categories: tuple[Category, ...] = CATEGORIES) -> DataFrame:
    """(title, price, link, brand, at, name, details): the chain of every title, a row for each step.

    Records of one title share its chain, which tells price, link and brand of the first of them: the validations of all
    in their order, then the scorings of those that passed. Rows instead of one array, so a common title isn't heavy.
    """
    steps = tracked(devices, weights, categories).select("title", "_ordinal", F.posexplode("steps").alias("stage", "step"))
    at = F.row_number().over(Window.partitionBy("title").orderBy("stage", "_ordinal")) - 1
    first = devices.groupBy("title").agg(F.min_by(F.struct("price", "link", "brand"), "_ordinal").alias("first"))
    return steps.withColumn("at", at).join(first, steps["title"].eqNullSafe(first["title"])).select(steps["title"], "first.price", "first.link", "first.brand", "at", "step.name", "step.details")
