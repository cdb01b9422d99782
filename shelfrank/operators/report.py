"""Why records are rejected: counts and ids by category and failing value.

A value's ids may be most of the catalogue's, as a missing one's may be. They are numbered in input order without meeting
in one task, and reported in chunks.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import places
from .scoring import CATEGORIES, derive, valid

MISSING = "MISSING"
#: Ids of a value that stand in one row of a report, and those that a document shows; counts are of all.
CHUNK, SHOWN = 1000, 100
#: Categories reported by chipset instead of by value.
BY_CHIPSET = {"cpuPerformance": ("CPU", "cpuScore"), "gpuPerformance": ("GPU", "gpuScore")}


def _shown(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(MISSING))


def _number(x: Column) -> Column:
    return F.coalesce(text.number_text(x), F.lit(MISSING))


def _cameras() -> Column:
    rear = F.col("normalizedSpecs.extracted.camera.rearCamera")
    main = F.filter(rear, lambda c: c["position"] == "main")
    none = lambda what: F.to_json(F.struct(F.lit(what).alias("rearCamera"), F.lit(MISSING).alias("mainCameraMegapixel"), F.lit(False).alias("hasMainCamera")))
    some = F.to_json(F.struct(F.size(rear).alias("rearCameraCount"), _number(F.try_element_at(main, F.lit(1))["megapixel"]).alias("mainCameraMegapixel"), (F.size(main) > 0).alias("hasMainCamera")))
    return F.when(rear.isNull(), none(MISSING)).when(F.size(rear) == 0, none("EMPTY_ARRAY")).otherwise(some)


def failing_values() -> dict[str, Column]:
    """For each category, what a rejected record shows, as JSON; missing values are named as such."""
    x = lambda path: F.col(f"normalizedSpecs.extracted.{path}")
    memory = F.col("normalizedSpecs.specs")["memory"]
    score = x("technical.benchmark.antutu.breakdown")
    obj = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    display = {"typeType": _shown(x("display.type.type")), "typeScore": _number(x("display.type.score")), "ppiValue": _number(x("display.ppi.value")), "refreshRateValue": _number(x("display.refreshRate.value")), "brightnessValue": _number(x("display.brightness.value"))}
    return {
        "batteryEndurance": obj(capacityValue=_number(x("battery.capacity.value"))),
        "displayQuality": obj(**display),
        "cpuPerformance": _shown(score["CPU"]),
        "gpuPerformance": _shown(score["GPU"]),
        "cameraQuality": _cameras(),
        "ramCapacity": obj(ram=_shown(memory["ram"])),
        "romCapacity": obj(storage=_shown(memory["storage"])),
    }


def chipset() -> Column:
    return F.coalesce(text.blank_to_null("normalizedSpecs.extracted.technical.chipset"), F.lit(MISSING))


def failures(devices: DataFrame) -> DataFrame:
    """(processor, value, chipset, _id, _ordinal): a row for each record and category that it fails."""
    values = failing_values()
    each = F.array(*(F.when(~valid(c), F.struct(F.lit(c.name).alias("processor"), values[c.name].alias("value"))) for c in CATEGORIES))
    rows = derive(devices).select("_id", "_ordinal", chipset().alias("chipset"), F.explode(F.array_compact(each)).alias("f"))
    return rows.select("f.processor", "f.value", "chipset", "_id", "_ordinal")


def _chunked(rows: DataFrame, keys: list[str], told: dict[str, tuple[Column, Column]], chunk: int) -> DataFrame:
    """(keys..., told..., chunk, document_ids): each key's ids in input order, `chunk` a row, and what is told of all of its
    rows: for each name, an aggregate and how it is read.

    Rows are dealt out by their place in the input, whatever their keys, so parts are of one size. A row's number is its
    place in its part and key, after those of the parts before.
    """
    dealt = places.staged(rows.repartitionByRange("_ordinal", "_id").withColumn("part", F.spark_partition_id()), "failures")
    of_part = dealt.groupBy("part", *keys).agg(F.count("*").alias("__n"), *(made.alias(f"__{name}") for name, (made, _) in told.items()))
    key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row a part and key; parts are as many as tasks.
    known = of_part.select("part", *keys, before.alias("__before"), F.sum("__n").over(key).alias("failed_count"), *(how.over(key).alias(name) for name, (_, how) in told.items()))
    at = F.row_number().over(Window.partitionBy("part", *keys).orderBy("_ordinal", "_id"))
    placed = dealt.select("part", *keys, "_id", at.alias("__at")).join(known, ["part", *keys]).withColumn("__place", F.col("__before") + F.col("__at") - 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("__place", "_id"))), lambda s: s["_id"])  # a chunk's
    return placed.groupBy(*keys, "failed_count", *told, F.floor(F.col("__place") / chunk).cast("int").alias("chunk")).agg(ids.alias("document_ids"))


def by_value(failed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(processor, value, failed_count, first_seen, chunk, document_ids): how many records fail with each value, and all
    their ids in input order, repeats included, `chunk` of them a row."""
    rows = failed.where(~F.col("processor").isin(*BY_CHIPSET))
    return _chunked(rows, ["processor", "value"], {"first_seen": (F.min("_ordinal"), F.min("__first_seen"))}, chunk)


def by_chipset(failed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(processor, chipset, value, failed_count, first_seen, chunk, document_ids): how many distinct ids fail with each
    chipset, all of them in the order in which they are first seen, `chunk` a row, and the last record's value."""
    rows, keys = failed.where(F.col("processor").isin(*BY_CHIPSET)), ["processor", "chipset"]
    once = rows.groupBy(*keys, "_id").agg(F.min("_ordinal").alias("_ordinal"), F.max(F.struct("_ordinal", "value")).alias("last"))
    told = {"first_seen": (F.min("_ordinal"), F.min("__first_seen")), "last": (F.max("last"), F.max("__last"))}
    return _chunked(once, keys, told, chunk).select(*keys, F.col("last.value").alias("value"), "failed_count", "first_seen", "chunk", "document_ids")


def totals(failed: DataFrame) -> DataFrame:
    """(processor, failed_count), most failures first. Categories by value stand even without failures, the others not."""
    order = {c.name: i for i, c in enumerate([*(c for c in CATEGORIES if c.name not in BY_CHIPSET), *(c for c in CATEGORIES if c.name in BY_CHIPSET)])}
    names = failed.sparkSession.createDataFrame(list(order.items()), "processor string, place int")
    # Records count once for each chipset, or as often as they stand, in one pass over the failures.
    each = failed.groupBy("processor", "chipset", "_id").agg(F.count("*").alias("n"))
    own = F.when(F.col("processor").isin(*BY_CHIPSET), F.lit(1)).otherwise(F.col("n"))
    counts = each.groupBy("processor").agg(F.sum(own).cast("long").alias("failed_count"))
    joined = names.join(F.broadcast(counts), "processor", "left")  # a row a category
    all_of = joined.withColumn("failed_count", F.coalesce("failed_count", F.lit(0).cast("long")))
    shown = all_of.where((F.col("failed_count") > 0) | ~F.col("processor").isin(*BY_CHIPSET))
    return shown.orderBy(F.desc("failed_count"), "place").select("processor", "failed_count")


def document(devices: DataFrame, shown: int = SHOWN) -> dict:
    """The report as one document: all counts, the first `shown` ids of each value, and whether there are more (cut). It
    holds a row for each distinct value; `write_whole` is the form for any size."""
    failed = failures(devices)
    values: dict[str, list] = {}

    def add(r, value) -> None:
        ids = r["document_ids"][:shown]
        values.setdefault(r["processor"], []).append({"value": value, "failedCount": r["failed_count"], "documentIds": ids, "cut": r["failed_count"] > len(ids)})

    first = lambda rows: rows.where("chunk = 0").orderBy("first_seen").collect()
    for r in first(by_value(failed, max(shown, 1))):
        add(r, json.loads(r["value"]))
    for r in first(by_chipset(failed, max(shown, 1))):
        add(r, {"chipset": r["chipset"], BY_CHIPSET[r["processor"]][1]: r["value"]})
    found = [{"processor": r["processor"], "failedCount": r["failed_count"], "failedValues": values.get(r["processor"], [])} for r in totals(failed).collect()]
    return {"totalRecords": devices.count(), "processorFailures": found}


STEM = "processor-failures"


def _next_number(taken: list[str], stem: str, end: str) -> int:
    found = [int(m[1]) for name in taken if (m := re.fullmatch(rf"{re.escape(stem)}-(\d+){end}", name))]
    return max(found, default=0) + 1


def write_numbered(report: dict, folder: str, stem: str = STEM) -> Path:
    """Writes a report under the next free number and returns the file's path; two writers at once take two numbers."""
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    while True:
        path = place / f"{stem}-{_next_number([p.name for p in place.iterdir()], stem, '[.]json')}.json"
        try:
            with path.open("x") as f:
                f.write(json.dumps(report, indent=2))
            return path
        except FileExistsError:
            continue


def write_whole(devices: DataFrame, folder: str, stem: str = STEM, chunk: int = CHUNK) -> str:
    """Writes the whole report, with every id, under the next free number, as folders of JSON lines: totals, by_value and
    by_chipset, ids in chunks. Returns its path. Tasks write; nothing is gathered. A file named complete comes last, so a
    report without one was cut short. For several writers at once, each takes its own folder."""
    spark: SparkSession = devices.sparkSession
    root, fs = places.place_of(spark, folder)
    fs.mkdirs(root)
    path = f"{folder.rstrip('/')}/{stem}-{_next_number([s.getPath().getName() for s in fs.listStatus(root)], stem, '')}"
    failed = places.staged(failures(devices), "failures")
    totals(failed).withColumn("total_records", F.lit(devices.count())).coalesce(1).write.json(f"{path}/totals")  # a row a category
    by_value(failed, chunk).write.json(f"{path}/by_value")
    by_chipset(failed, chunk).write.json(f"{path}/by_chipset")
    fs.create(places.place_of(spark, f"{path}/complete")[0], False).close()
    return path
