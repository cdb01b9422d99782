"""The benchmark tables as catalogues, listings and threads, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each part: specs from its size, measurements from its line items, gaps at fixed places."""
    key = F.col("p_partkey")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("mx"), F.min("l_extendedprice").alias("mn"), F.max("l_quantity").alias("mq"), F.min("l_quantity").alias("nq"), F.max("l_tax").alias("mt"))
    rows = table(spark, sf_dir, "part").join(sums.hint("merge"), key == F.col("l_partkey"))  # neither side fits the driver as it grows
    size = F.col("p_size")
    box = lambda v, unit: F.struct(v.cast("double").alias("value"), F.lit(unit).alias("unit"))
    unless = lambda n, v: F.when(key % n != 0, v)
    camera = lambda mp, place: F.struct(mp.cast("double").alias("megapixel"), F.lit(place).alias("position"), F.lit("wide").alias("type"))
    none = F.array().cast("array<struct<megapixel: double, position: string, type: string>>")
    memory = F.create_map(F.lit("ram"), F.concat((size % 16).cast("string"), F.lit(" GB")), F.lit("storage"), F.concat(size.cast("string"), F.when(size % 5 == 0, F.lit(" TB")).otherwise(F.lit("GB"))))
    technical = F.create_map(F.lit("OS"), F.concat(F.lit("Android "), (size % 8 + 8).cast("string")), F.lit("UI"), F.when(size % 2 == 0, F.lit("One UI")).otherwise(F.lit("")))
    scores = F.create_map(F.lit("CPU"), unless(17, F.col("mx").cast("string")), F.lit("GPU"), F.concat(F.col("mn").cast("string"), F.lit(" pts")))
    extracted = F.struct(
        F.struct(F.struct(F.lit("OLED").alias("type"), unless(13, size.cast("double")).alias("score")).alias("type"), box(F.col("mq") * 10, "nits").alias("brightness"), box(unless(4, F.col("q") * 0.5), "Hz").alias("refreshRate"), box(unless(3, size * 7.5), "ppi").alias("ppi")).alias("display"),
        F.struct(box(unless(11, F.col("q")), "mAh").alias("capacity")).alias("battery"),
        F.struct(F.when(key % 19 == 0, none).otherwise(F.array(camera(F.col("nq"), "ultrawide"), camera(F.col("mq"), "main"))).alias("rearCamera"), F.array(camera(F.col("mt") * 100, "front")).alias("frontCamera")).alias("camera"),
        F.struct(F.when(key % 7 == 0, F.lit(" ")).otherwise(F.concat("p_brand", F.lit(" chip "))).alias("chipset"), F.struct(F.struct(F.lit(None).cast("string").alias("total"), scores.alias("breakdown")).alias("antutu")).alias("benchmark")).alias("technical"),
    )
    lifecycle = F.element_at(F.array(F.lit("unknown"), F.lit("considerable"), F.lit("released")), (size % 3 + 1).cast("int"))
    specs = F.create_map(F.lit("memory"), memory, F.lit("technical"), technical)
    meta = F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), lifecycle.alias("lifecycle"))
    return rows.select(
        key.cast("string").alias("_id"),
        F.concat(F.lit("/item/"), key.cast("string")).alias("link"),
        F.concat_ws(" ", "p_brand", "p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.when(key % 2 == 1, F.array(F.lit("front.png"))).alias("images"),
        F.lit("<p>raw</p>").alias("html"),
        F.struct(meta.alias("meta"), specs.alias("specs")).alias("parseHtmlSpec"),
        F.struct(meta.alias("meta"), specs.alias("specs"), extracted.alias("extracted")).alias("normalizedSpecs"),
        key.alias("_ordinal"),
    )


def mixed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): the catalogue's records as JSON, with values of the wrong type: every third CPU score is a number, every
    fifth capacity and every seventh price a text."""
    key = F.col("_ordinal")
    body = F.to_json(F.struct("_id", "title", "brand", "price", "images", "parseHtmlSpec", "normalizedSpecs"))
    score = F.when(key % 3 == 0, F.regexp_replace(body, '"CPU":"([^"]*)"', '"CPU":$1')).otherwise(body)
    capacity = F.when(key % 5 == 0, F.regexp_replace(score, '("capacity":[{]"value":)([0-9.E]+)', '$1"$2"')).otherwise(score)
    return catalogue(spark, sf_dir).select(F.when(key % 7 == 0, F.regexp_replace(capacity, '("price":)([0-9.E]+)', '$1"$2"')).otherwise(capacity).alias("value"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing titles: every part in one of eight colours and four sizes, in the forms that shops write."""
    colours = F.array(*(F.lit(c) for c in ("Black", "BLUE", "titanium", "Grey", "Teal", "gold", "Red", "white")))
    key = F.col("p_partkey")
    colour = F.element_at(colours, (key % 8 + 1).cast("int"))
    size = F.pow(F.lit(2), (key % 4 + 5)).cast("int").cast("string")
    title = F.when(key % 3 == 0, F.concat("p_name", F.lit(" ("), colour, F.lit(", "), size, F.lit(" GB)"))).when(key % 3 == 1, F.concat(colour, F.lit(" "), "p_name", F.lit(" "), size, F.lit("GB RAM"))).otherwise(F.concat("p_name", F.lit("  "), size, F.lit(" gb "), colour))
    return table(spark, sf_dir, "part").select(key.alias("_ordinal"), title.alias("title"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as thread messages: an assistant's even turns show two products, a system's are of no known type."""
    view = (F.col("role") == "assistant") & (F.col("turn") % 4 == 3)
    item = lambda n: F.struct(F.concat(F.lit(f"item {n} of "), F.col("conv_id").cast("string")).alias("title"), F.when(F.col("conv_id") % 2 == 0, F.lit(f"verdict {n}")).alias("verdict"))
    kind = F.when(view, F.lit("product-view")).when(F.col("role") == "system", F.lit("note")).otherwise(F.lit("text"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), kind.alias("type"), "role", F.col("text").alias("content"), F.when(view, F.array(item(1), item(2))).alias("products"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of ten parts each, written as a shop's markup: relative and absolute links, missing titles."""
    key = F.col("p_partkey")
    card = F.concat(
        F.lit('<div data-id="'), key.cast("string"), F.lit('"><a class="k7wcnx" href="'), F.when(key % 2 == 0, F.lit("http://shop.test")).otherwise(F.lit("")), F.lit("/item/"), key.cast("string"), F.lit('">'),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('<div class="x RG5Slk"> '), F.col("p_name"), F.lit(" &amp; case </div>"))),
        F.lit('</a><img class="UCc1lI" data-src="/i.png"><div class="hZ3P6w DeU9vF">'), F.col("p_retailprice").cast("string"), F.lit('</div><div class="MKiFS6">'), (key % 5).cast("string"), F.lit('.5<img src="star.png"></div><ul class="HwRTzP"><li class="DTBslk">'),
        F.col("p_type"), F.lit('<li class="DTBslk"> </li><li class="DTBslk">size '), F.col("p_size").cast("string"), F.lit("</ul></div>"))
    rows = table(spark, sf_dir, "part").select(F.floor(key / 10).cast("bigint").alias("page_id"), key.alias("k"), card.alias("card"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda s: s["card"]), "\n").alias("html"))
