"""Reading and writing catalogues."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, schemas


#: Bits of _ordinal for a row's place in its file; what is above them numbers the files, of which there may be so many.
FILE_BITS = 43
MOST_FILES = 1 << (63 - FILE_BITS)


def _ranks(spark: SparkSession, path: str) -> DataFrame:
    """(__path, __rank): the files of a path in the order of their names; more of them than numbers have room for are an
    error."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("__path"))  # names only
    rank = F.row_number().over(Window.orderBy("__path")).cast("long") - 1
    fits = F.when(rank < MOST_FILES, rank).otherwise(F.raise_error(F.lit(f"places can be numbered in {MOST_FILES} files at the most")).cast("long"))
    return files.distinct().withColumn("__rank", fits)


def _ordinal(rank: Column, within: Column) -> Column:
    return F.shiftleft(rank, FILE_BITS) + within


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """(_ordinal, value) of JSON arrays, one a file: a file's rank and the element's place in its array."""
    found = arrays.elements(spark, path)
    ranks = _ranks(spark, path).select(F.xxhash64("__path").alias("file"), "__rank")
    return found.join(ranks, "file").select(_ordinal(F.col("__rank"), F.col("place")).alias("_ordinal"), "value")


def _placed(rows: DataFrame, path: str, within: Column | None = None) -> DataFrame:
    """Rows of split files with _ordinal. within: a row's place in its file; by default a number in its order."""
    # A split starts at a byte of its file. Only a file's last split can share a task, so a row's count within its task,
    # added to that byte, stays below the next split's start.
    counted = F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)
    placed = rows.select("*", F.col("_metadata.file_path").alias("__path"), (counted if within is None else within).alias("__within"))
    joined = placed.join(_ranks(rows.sparkSession, path), "__path")
    return joined.withColumn("_ordinal", _ordinal(F.col("__rank"), F.col("__within"))).drop("__path", "__rank", "__within")


def read_catalogue(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """Product records with their place in the input as _ordinal.

    layout: "array", one JSON array a file, "lines", a JSON record a line, or "parquet"; files of any size are read by as
    many tasks as they have splits. _ordinal orders rows by their file's path and their place in it, however files are
    split and packed into tasks. In an array and in Parquet a row's number is its place, for the first file from 0 on; of
    lines the order is always the same, while numbers have gaps and can differ between reads with other split sizes. An
    element that isn't a record is a row of nulls. Numbers where the schema has text come as text; `typed_catalogue` takes
    only what has the right type.
    """
    if layout == "array":
        return _elements(spark, path).select(F.from_json("value", schemas.struct_of(schemas.CATALOGUE)).alias("r"), "_ordinal").select("r.*", "_ordinal")
    reader = spark.read.schema(schemas.CATALOGUE)
    if layout == "parquet":
        return _placed(reader.parquet(path), path, F.col("_metadata.row_index"))
    return _placed(reader.json(path), path)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of arrays or Parquet, as `read_catalogue` reads them, with `place`: numbered from 0 on over all files, in the
    order of their names. Rows are read twice; what is broadcast is a row a file."""
    rank, within = F.shiftright("_ordinal", FILE_BITS), F.col("_ordinal").bitwiseAND(F.lit((1 << FILE_BITS) - 1))
    lengths = rows.groupBy(rank.alias("__rank")).agg((F.max(within) + 1).alias("__n"))
    before = Window.orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(lengths.select("__rank", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    return rows.join(starts, rank == F.col("__rank")).withColumn("place", F.col("__start") + within).drop("__rank", "__start")


def read_variants(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """(_ordinal, record) of JSON arrays or lines, a variant each, placed as by `read_catalogue`: keeps whether a value was
    a number, a text, null or absent. What isn't JSON is a null record."""
    if layout == "array":
        return _elements(spark, path).select("_ordinal", F.try_parse_json("value").alias("record"))
    return _placed(spark.read.option("singleVariantColumn", "record").json(path), path).select("_ordinal", "record")


def only_text(record: Column | str, path: str) -> Column:
    """The text at a variant's path; null where it is a number, null or absent."""
    v = F.try_variant_get(record, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(record, path, "string"))


def only_number(record: Column | str, path: str) -> Column:
    """The number at a variant's path; null where it is a text, null or absent."""
    v = F.try_variant_get(record, path, "variant")
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$"), F.try_variant_get(record, path, "double"))


#: Places of values that are read as they are only if they have the right type: numbers, and texts.
NUMBERS = ("price", "normalizedSpecs.extracted.battery.capacity.value", "normalizedSpecs.extracted.display.type.score", "normalizedSpecs.extracted.display.ppi.value", "normalizedSpecs.extracted.display.refreshRate.value", "normalizedSpecs.extracted.display.brightness.value")
TEXTS = ("_id", "title", "link", "brand")
TEXT_MAPS = ("normalizedSpecs.extracted.technical.benchmark.antutu.breakdown",)


def typed_catalogue(variants: DataFrame) -> DataFrame:
    """The catalogue of `read_variants` records in which a value of another type than its place asks for is missing: a
    number as text is no number there, and a score that is a number is no text. Validation then rejects what lacks it."""
    whole = variants.select("_ordinal", "record", F.try_variant_get("record", "$", schemas.struct_of(schemas.CATALOGUE)).alias("r")).select("_ordinal", "record", "r.*")
    out = whole
    for place in (*NUMBERS, *TEXTS):
        read = only_number if place in NUMBERS else only_text
        top, _, rest = place.partition(".")
        value = read("record", f"$.{place}")
        out = out.withColumn(top, F.col(top).withField(rest, value) if rest else value)
    for place in TEXT_MAPS:
        top, _, rest = place.partition(".")
        typed = F.try_variant_get("record", f"$.{place}", "map<string, variant>")
        texts = F.map_filter(F.transform_values(typed, lambda _, v: only_text(v, "$")), lambda _, v: v.isNotNull())
        out = out.withColumn(top, F.col(top).withField(rest, texts))
    return out.drop("record")


def exportable(devices: DataFrame, lifecycles: tuple[str, ...] = schemas.LIFECYCLES) -> DataFrame:
    """Records whose life cycle is wanted, without raw pages; an empty result is an error for `export`."""
    return devices.where(F.col("parseHtmlSpec.meta.lifecycle").isin(*lifecycles)).drop("html")


def export(devices: DataFrame, path: str, single: bool = False, layout: str = "lines") -> None:
    """Writes records as JSON: "lines", or an "array" a file. single: into one file, for catalogues that one task can
    write."""
    if not devices.take(1):
        raise ValueError("no record of a wanted life cycle")
    rows = devices.coalesce(1) if single else devices
    if layout == "lines":
        rows.write.mode("overwrite").json(path)
    else:
        rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's records as the lines of one array."""
    lead = "["
    for batch in batches:
        values = batch.column("value").to_pylist()
        yield pa.RecordBatch.from_pydict({"value": pa.array([(lead if k == 0 else ",") + v for k, v in enumerate(values)], pa.string())})
        lead = "," if values else lead
    if lead == ",":
        yield pa.RecordBatch.from_pydict({"value": pa.array(["]"])})
