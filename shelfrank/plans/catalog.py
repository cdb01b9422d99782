"""The registered catalogue queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import dedup, filters, matching, report, scoring, threads
from ..operators.filters import Budget
from ..operators.filters import Query as Constraints
from ..operators.store import Store
from ..sources import catalogue as source
from ..sources import chips, crawl, html, keyed, listings, places, schemas
from . import adapter, conversation, planner
from .adapter import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WEIGHTS = {"batteryEndurance": 0.2, "displayQuality": 0.2, "cpuPerformance": 0.15, "gpuPerformance": 0.15, "cameraQuality": 0.1, "ramCapacity": 0.1, "romCapacity": 0.1}
SHOP, LAYOUT = planner.Shop("https://shop.test/search", "tyy,4io", "SHOP"), listings.ListingLayout("https://shop.test")
WINDOW = Constraints("parts", 915.0, 900.5)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# The catalogue of parts in SQL: its columns flat, and the values that the categories read from them.
CAT = """
li AS (SELECT l_partkey, sum(l_quantity) AS q, max(l_extendedprice) AS mx, min(l_extendedprice) AS mn, max(l_quantity) AS mq, min(l_quantity) AS nq, max(l_tax) AS mt FROM lineitem GROUP BY l_partkey),
cat AS (
  SELECT p_partkey AS id, p_brand || ' ' || p_name AS title, p_brand AS brand, p_name, p_size, p_retailprice AS price, mx, mn, mq, nq, mt, q,
    CASE WHEN p_partkey % 11 <> 0 THEN q END AS v_capacity, CASE WHEN p_partkey % 13 <> 0 THEN p_size::DOUBLE END AS v_display,
    CASE WHEN p_partkey % 3 <> 0 THEN p_size * 7.5::DOUBLE END AS v_ppi, CASE WHEN p_partkey % 4 <> 0 THEN q * 0.5::DOUBLE END AS v_refresh, mq * 10 AS v_bright,
    CASE WHEN p_partkey % 17 <> 0 THEN mx END AS v_cpu, mn AS v_gpu, CASE WHEN p_partkey % 19 <> 0 THEN greatest(nq, mq) END AS v_rear, mt * 100 AS v_front,
    nullif(p_size % 16, 0)::DOUBLE AS v_ram, (CASE WHEN p_size % 5 = 0 THEN p_size * 1024 ELSE p_size END)::DOUBLE AS v_rom,
    CASE WHEN p_partkey % 7 = 0 THEN 'MISSING' ELSE p_brand || ' chip' END AS chipset
  FROM part JOIN li ON p_partkey = l_partkey)
"""
VALID = "v_capacity IS NOT NULL AND v_display IS NOT NULL AND v_cpu IS NOT NULL AND v_gpu IS NOT NULL AND v_rear IS NOT NULL AND v_front IS NOT NULL AND v_ram > 0 AND v_rom > 0"
_VALUES = ["capacity", "display", "ppi", "refresh", "bright", "cpu", "gpu", "rear", "front", "ram", "rom"]
CTX = "ctx AS (SELECT " + ", ".join(f"min(v_{v}) AS {v}_min, max(v_{v}) AS {v}_max" for v in _VALUES) + " FROM ok)"


def _norm(v: str) -> str:
    return f"(CASE WHEN v_{v} IS NULL THEN 0.0::DOUBLE WHEN {v}_max = {v}_min THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v_{v} - {v}_min) / ({v}_max - {v}_min))) END)"


RAW = {
    "batteryEndurance": _norm("capacity"),
    "displayQuality": f"({_norm('display')} * 0.5::DOUBLE + {_norm('ppi')} * 0.2::DOUBLE + {_norm('refresh')} * 0.15::DOUBLE + {_norm('bright')} * 0.15::DOUBLE)",
    "cpuPerformance": _norm("cpu"),
    "gpuPerformance": _norm("gpu"),
    "cameraQuality": f"({_norm('rear')} * 0.7::DOUBLE + {_norm('front')} * 0.3::DOUBLE)",
    "ramCapacity": _norm("ram"),
    "romCapacity": _norm("rom"),
}
TOTAL = " + ".join(f"{RAW[c]} * {w}::DOUBLE" for c, w in WEIGHTS.items())
RANKED = f"WITH {CAT}, ok AS (SELECT * FROM cat WHERE price >= 900.5 AND price <= 915 AND {VALID}), {CTX}"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.within_price(adapter.catalogue(spark, sf_dir), WINDOW)


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.derive(adapter.catalogue(spark, sf_dir))


@query("rank_topn", f"{RANKED} SELECT id, title, price, {TOTAL} AS total FROM ok, ctx ORDER BY total DESC, id LIMIT 8")
def rank_topn(spark, sf_dir):
    return scoring.rank(_candidates(spark, sf_dir), WEIGHTS, 8).select(F.col("_ordinal").alias("id"), "title", "price", F.col("totalWeightedScore").alias("total"))


@query("short_format", f"{RANKED} SELECT title, '/item/' || id AS link, {TOTAL} AS score FROM ok, ctx ORDER BY score DESC, id LIMIT 8")
def short_format(spark, sf_dir):
    return scoring.short_format(scoring.rank(_candidates(spark, sf_dir), WEIGHTS, 8))


@query("ranked_products", f"{RANKED} SELECT id::VARCHAR AS \"dbRecordId\", brand, CASE WHEN id % 2 = 1 THEN 1 ELSE 0 END AS n_images, (p_size % 16) || ' GB' AS ram, {TOTAL} AS total FROM ok, ctx ORDER BY total DESC, id LIMIT 20")
def ranked_products(spark, sf_dir):
    found = scoring.presented(scoring.rank(scoring.enriched(_candidates(spark, sf_dir)), WEIGHTS))
    return found.select("dbRecordId", "brand", F.size("images").alias("n_images"), F.col("specs")["memory"]["ram"].alias("ram"), F.col("totalWeightedScore").alias("total"))


@query("catalog_scan_prune", f"WITH {CAT} SELECT id, title, CASE p_size % 3 WHEN 0 THEN 'unknown' ELSE 'considerable' END AS lifecycle FROM cat WHERE p_size % 3 < 2")
def catalog_scan_prune(spark, sf_dir):
    kept = source.exportable(adapter.catalogue(spark, sf_dir))
    return kept.select(F.col("_ordinal").alias("id"), "title", F.col("parseHtmlSpec.meta.lifecycle").alias("lifecycle"))


def _price_sql(low: str, limit: str) -> str:
    return f"""SELECT p_partkey AS id, p_retailprice >= {low} AND p_retailprice <= {limit} AS passed,
      CASE WHEN p_retailprice < {low} THEN 'below' WHEN p_retailprice > {limit} THEN 'above' END AS reason, CASE WHEN p_retailprice >= {low} THEN {limit}::DOUBLE END AS price_limit FROM part"""


def _priced(spark: SparkSession, sf_dir: str, constraints: Constraints) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("c", filters.price_check(F.col("p_retailprice"), constraints))
    return rows.select(F.col("p_partkey").alias("id"), "c.passed", F.nullif(F.regexp_extract("c.reason", " is (below|above) ", 1), F.lit("")).alias("reason"), F.col("c.limit").alias("price_limit"))


@query("price_filter", _price_sql("900.5", "915"))
def price_filter(spark, sf_dir):
    return _priced(spark, sf_dir, WINDOW)


@query("price_filter_budget_ext", _price_sql("905", "912"))
def price_filter_budget_ext(spark, sf_dir):
    return _priced(spark, sf_dir, Constraints("parts", 910.0, 905.0, budget=Budget(900.0, 12.0)))


@query("price_filter_no_maximum", "SELECT p_partkey AS id, false AS passed FROM part")
def price_filter_no_maximum(spark, sf_dir):
    return _priced(spark, sf_dir, Constraints("parts", budget=Budget(900.0))).select("id", "passed")


@query("effective_budget", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + (o_orderkey % 2) * 250 WHEN o_totalprice >= 20000 THEN o_totalprice + 1000 ELSE o_totalprice + 500 END AS effective FROM orders")
def effective_budget(spark, sf_dir):
    extension = F.when(F.col("o_orderkey") % 3 == 0, ((F.col("o_orderkey") % 2) * 250).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", filters.effective_maximum(F.col("o_totalprice"), extension).alias("effective"))


@query("facet_filter", f"WITH {CAT} SELECT id FROM cat WHERE brand IN ('Brand#11', 'Brand#23') AND v_ram IN (8, 12)")
def facet_filter(spark, sf_dir):
    wanted = Constraints("parts", brands=["brand#11", "BRAND#23"], ram=["8 GB", "12GB"])
    return filters.with_facets(adapter.catalogue(spark, sf_dir), wanted).select(F.col("_ordinal").alias("id"))


@query("validate_all", f"WITH {CAT} SELECT id, title FROM cat WHERE {VALID}")
def validate_all(spark, sf_dir):
    return scoring.validated(_derived(spark, sf_dir)).select(F.col("_ordinal").alias("id"), "title")


_FAILED = {"batteryEndurance": "v_capacity IS NULL", "displayQuality": "v_display IS NULL", "cpuPerformance": "v_cpu IS NULL", "gpuPerformance": "v_gpu IS NULL", "cameraQuality": "v_rear IS NULL OR v_front IS NULL", "ramCapacity": "v_ram IS NULL", "romCapacity": "v_rom IS NULL OR v_rom = 0"}
_FAILED_LIST = "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{c}' END" for c, test in _FAILED.items()) + ")"


@query("failed_processors", f"WITH {CAT} SELECT id, {_FAILED_LIST} AS failed FROM cat")
def failed_processors(spark, sf_dir):
    return _derived(spark, sf_dir).select(F.col("_ordinal").alias("id"), F.array_join(scoring.failed_categories(), ",").alias("failed"))


_PARTS = dict(zip(_VALUES, (p.name for c in scoring.CATEGORIES for p in c.parts), strict=True))


@query("normalization_context", f"{RANKED} SELECT * FROM ctx")
def normalization_context(spark, sf_dir):
    found = scoring.context(scoring.validated(scoring.derive(_candidates(spark, sf_dir))))
    return found.select(*(F.col(f"{p}_{end}").alias(f"{v}_{end}") for v, p in _PARTS.items() for end in ("min", "max")))


@query("minmax_normalize", "SELECT p_partkey AS id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (p_retailprice - 905) / 10)) AS share, 0.5::DOUBLE AS equal, 0.0::DOUBLE AS missing FROM part")
def minmax_normalize(spark, sf_dir):
    price, lit = F.col("p_retailprice"), lambda x: F.lit(float(x))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), numbers.normalise(price, lit(905), lit(915)).alias("share"), numbers.normalise(price, lit(7), lit(7)).alias("equal"), numbers.normalise(F.when(price < 0, price), lit(7), lit(7)).alias("missing"))


def _score_query(category: scoring.Category) -> None:
    @query(f"score_{category.name}", f"WITH {CAT}, ok AS (SELECT * FROM cat WHERE {VALID}), {CTX} SELECT id, {RAW[category.name]} AS raw, {RAW[category.name]} * {WEIGHTS[category.name]}::DOUBLE AS weighted FROM ok, ctx")
    def score(spark, sf_dir):
        rows = scoring.scored(scoring.validated(_derived(spark, sf_dir)), WEIGHTS)
        return rows.select(F.col("_ordinal").alias("id"), F.col(category.name)["rawScore"].alias("raw"), F.col(category.name)["weightedScore"].alias("weighted"))


for _category in scoring.CATEGORIES:
    _score_query(_category)


@query("score_softwareExperience", f"""WITH {CAT}, s AS (SELECT id, (CASE WHEN p_size % 8 + 8 IN (14, 15) THEN 10 WHEN p_size % 8 + 8 IN (12, 13) THEN 8 WHEN p_size % 8 + 8 IN (10, 11) THEN 6 ELSE 5 END) * 0.4::DOUBLE
  + (CASE WHEN p_size % 2 = 0 THEN 7 ELSE 10 END) * 0.3::DOUBLE + 5 * 0.3::DOUBLE AS v FROM cat), b AS (SELECT min(v) AS lo, max(v) AS hi FROM s)
  SELECT id, CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v - lo) / (hi - lo))) END AS raw FROM s, b""")  # fmt: skip
def score_software(spark, sf_dir):
    only = (scoring.SOFTWARE,)
    rows = scoring.scored(scoring.derive(adapter.catalogue(spark, sf_dir), only), {"softwareExperience": 1.0}, only)
    return rows.select(F.col("_ordinal").alias("id"), F.col("softwareExperience.rawScore").alias("raw"))


@query("tracking_chain", f"{RANKED.replace('ok AS', 'near AS (SELECT * FROM cat WHERE price >= 900.5 AND price <= 915), ok AS')}, t AS (SELECT id, {TOTAL} AS total FROM ok, ctx) SELECT near.id, CASE WHEN t.id IS NULL THEN 1 ELSE 2 END AS n_steps, {_FAILED_LIST} = '' AS valid, {_FAILED_LIST} AS failed, total FROM near LEFT JOIN t ON near.id = t.id")
def tracking_chain(spark, sf_dir):
    rows = scoring.tracked(_candidates(spark, sf_dir), WEIGHTS)
    details = lambda at, kind: F.from_json(F.try_element_at("steps", F.lit(at))["details"], kind)
    made = rows.select(F.col("_ordinal").alias("id"), F.size("steps").alias("n_steps"), details(1, "valid boolean, failedProcessors array<string>").alias("v"), details(2, "total double").alias("s"))
    return made.select("id", "n_steps", "v.valid", F.array_join("v.failedProcessors", ",").alias("failed"), "s.total")


@query("parse_float_prefix", r"""SELECT event_id, try_cast(nullif(regexp_extract(x, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') AS DOUBLE) AS number
  FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN event_type ELSE '  ' || round(value, 2)::DECIMAL(18,2)::VARCHAR || event_type END AS x FROM events)""")  # fmt: skip
def parse_float_prefix(spark, sf_dir):
    number = F.concat(F.lit("  "), F.round("value", 2).cast("decimal(18,2)").cast("string"), "event_type")
    shown = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(number)
    return table(spark, sf_dir, "events").select("event_id", text.number_prefix(shown).alias("number"))


_SIZED = "CASE p_partkey % 5 WHEN 0 THEN p_size || ' GB, up to 1.5 tb' WHEN 1 THEN p_size || 'GB + 8 GB' WHEN 2 THEN p_size || ' MB' WHEN 3 THEN '0 GB' ELSE p_name END"


@query("parse_capacity", rf"""SELECT p_partkey AS id, CASE WHEN g > 0 THEN g END AS ram, CASE WHEN coalesce(t * 1024, g) > 0 THEN coalesce(t * 1024, g) END AS rom FROM (
  SELECT p_partkey, try_cast(nullif(regexp_extract({_SIZED}, '(\d+(?:\.\d+)?)\s*GB', 1, 'i'), '') AS DOUBLE) AS g, try_cast(nullif(regexp_extract({_SIZED}, '(\d+(?:\.\d+)?)\s*TB', 1, 'i'), '') AS DOUBLE) AS t FROM part)""")  # fmt: skip
def parse_capacity(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("x", F.expr(_SIZED))
    return rows.select(F.col("p_partkey").alias("id"), text.ram_gb("x").alias("ram"), text.rom_gb("x").alias("rom"))


@query("largest_in_array", "SELECT l_orderkey, max(CASE WHEN l_linenumber <> 2 THEN l_quantity END) AS largest FROM lineitem GROUP BY l_orderkey")
def largest_in_array(spark, sf_dir):
    values = F.collect_list(F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).otherwise(F.lit(float("nan"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(numbers.largest(values).alias("largest"))


@query("tokenize_title", r"SELECT p_partkey AS id, array_to_string([t FOR t IN string_split_regex(lower(regexp_replace(p_name || ' (' || p_brand || ') ' || p_type, '\s*\([^)]*\)', '', 'g')), '\s+') IF t <> ''], '|') AS tokens FROM part")
def tokenize_title(spark, sf_dir):
    title = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "), "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.tokens(text.without_brackets(title)), "|").alias("tokens"))


_COLOURS = "white|black|blue|red|green|yellow|pink|purple|orange|silver|gold|titanium|graphite|space|gray|grey"
_TITLES = """v AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name || ' (' || c || ', ' || s || ' GB)' WHEN 1 THEN c || ' ' || p_name || ' ' || s || 'GB RAM' ELSE p_name || '  ' || s || ' gb ' || c END AS title
  FROM (SELECT *, (['Black', 'BLUE', 'titanium', 'Grey', 'Teal', 'gold', 'Red', 'white'])[(p_partkey % 8 + 1)::INT] AS c, ((2 ** (p_partkey % 4 + 5))::INT)::VARCHAR AS s FROM part))"""
_MODEL = rf"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\([^)]*\)', '', 'g'), '\b\d+\s*(?:GB|TB|MB)\s*(?:ROM|RAM)?\b', '', 'gi'), '\b\d+\s*(?:GB|TB)\b', '', 'gi'), '\b(?:{_COLOURS})\b', '', 'gi'), '\s+', ' ', 'g')))"""


@query("base_model", f"WITH {_TITLES} SELECT id, {_MODEL} AS model FROM v")
def base_model(spark, sf_dir):
    return adapter.variants(spark, sf_dir).select(F.col("_ordinal").alias("id"), text.base_model("title").alias("model"))


@query("dedup_first", f"WITH {_TITLES} SELECT id, title FROM (SELECT id, title, row_number() OVER (PARTITION BY model ORDER BY id) AS n FROM (SELECT *, {_MODEL} AS model FROM v) WHERE model <> '') WHERE n = 1")
def dedup_first(spark, sf_dir):
    return dedup.first_models(adapter.variants(spark, sf_dir)).select(F.col("_ordinal").alias("id"), "title")


@query("first_by_title", "SELECT id, title FROM (SELECT p_partkey AS id, p_name AS title, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def first_by_title(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_ordinal"), F.col("p_name").alias("title"))
    return dedup.first_by_title(rows).select(F.col("_ordinal").alias("id"), "title")


_SCORES = """lw AS (SELECT lid, len(lt) AS n, unnest(lt) AS w FROM l), rw AS (SELECT rid, w, count(*) AS c FROM (SELECT rid, unnest(rt) AS w FROM r) GROUP BY rid, w),
  rn AS (SELECT rid, len(list_distinct(rt)) AS m FROM r),
  s AS (SELECT lid, rid, sum(c)::DOUBLE / (n + m - count(*)) AS score FROM lw JOIN rw USING (w) JOIN rn USING (rid) GROUP BY lid, rid, n, m),
  b AS (SELECT lid, rid, score FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY score DESC, rid) AS n FROM s) WHERE n = 1)"""


@query("fuzzy_match", rf"""WITH l AS (SELECT p_partkey AS lid, list_distinct([t FOR t IN string_split_regex(lower(p_brand || ' ' || p_name), '\s+') IF t <> '']) AS lt FROM part),
  r AS (SELECT p_partkey AS rid, [t FOR t IN string_split_regex(lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_brand), '\s+') IF t <> ''] AS rt FROM part), {_SCORES}
  SELECT lid AS left_id, rid AS right_id, score FROM b WHERE score > 0.4""")  # fmt: skip
def fuzzy_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return _fuzzy(part, part)


def _fuzzy(asking: DataFrame, part: DataFrame) -> DataFrame:
    left = asking.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", F.lit(" (New)")).alias("title"))
    right = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_brand").alias("title"))
    return matching.best_matches(left, right, "p_partkey", "title", "p_partkey", "title")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's title with a colour in brackets; every tenth in words that match nothing, every seventh in few that do."""
    shown = F.when(F.col("p_partkey") % 10 == 0, F.lit("no such thing")).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("one of a kind "), F.col("p_brand"))).otherwise(F.concat_ws(" ", "p_name", "p_brand", F.lit("(Blue)")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_ordinal"), shown.alias("title"))


_MATCHED = rf"""shown AS (SELECT p_partkey AS lid, CASE WHEN p_partkey % 10 = 0 THEN 'no such thing' WHEN p_partkey % 7 = 0 THEN 'one of a kind ' || p_brand ELSE p_name || ' ' || p_brand || ' (Blue)' END AS shown FROM part),
  l AS (SELECT lid, list_distinct([t FOR t IN string_split_regex(lower(regexp_replace(shown, '\s*\([^)]*\)', '', 'g')), '\s+') IF t <> '']) AS lt FROM shown),
  r AS (SELECT id AS rid, [t FOR t IN string_split_regex(lower(title), '\s+') IF t <> ''] AS rt FROM cat), {_SCORES}"""


@query("match_steps", f"WITH {CAT}, {_MATCHED} SELECT lid AS id, coalesce(score > 0.4, false) AS matched, coalesce(score, 0) AS score, rid AS product FROM shown LEFT JOIN b USING (lid)")
def match_steps(spark, sf_dir):
    found = matching.match_steps(_listings(spark, sf_dir), adapter.catalogue(spark, sf_dir))
    told = found.select(F.col("_ordinal").alias("id"), F.from_json("step.details", "matched boolean, score double, dbProduct long").alias("d"))
    return told.select("id", "d.matched", "d.score", F.col("d.dbProduct").alias("product"))


@query("match_and_rank", f"WITH {CAT}, {_MATCHED}, ok AS (SELECT lid, shown, cat.* FROM b JOIN shown USING (lid) JOIN cat ON rid = id WHERE score > 0.4 AND {VALID}), {CTX} SELECT lid, shown AS title, id::VARCHAR AS device, {TOTAL} AS total FROM ok, ctx ORDER BY total DESC, lid LIMIT 20")
def match_and_rank(spark, sf_dir):
    from .recommend import match_and_rank as run

    found = run(_listings(spark, sf_dir), adapter.catalogue(spark, sf_dir), WEIGHTS)
    return found.select(F.col("_ordinal").alias("lid"), F.col("realTitle").alias("title"), F.col("dbRecordId").alias("device"), F.col("totalWeightedScore").alias("total"))


def _failing_sql(name: str, where: str, value: str) -> str:
    return f"SELECT '{name}' AS processor, {value} AS value, id FROM cat WHERE {where}"


def _shown(v: str) -> str:
    """A double of this catalogue (whole, or with a half) as the report writes it."""
    return f"coalesce(CASE WHEN {v} = floor({v}) THEN {v}::BIGINT::VARCHAR ELSE {v}::VARCHAR END, 'MISSING')"


_DISPLAY = "'{\"typeType\":\"OLED\",\"typeScore\":\"' || " + _shown("v_display") + " || '\",\"ppiValue\":\"' || " + _shown("v_ppi") + " || '\",\"refreshRateValue\":\"' || " + _shown("v_refresh") + " || '\",\"brightnessValue\":\"' || " + _shown("v_bright") + " || '\"}'"
BY_VALUE = " UNION ALL ".join((
    _failing_sql("batteryEndurance", "v_capacity IS NULL", "'{\"capacityValue\":\"MISSING\"}'"),
    _failing_sql("displayQuality", "v_display IS NULL", _DISPLAY),
    _failing_sql("cameraQuality", "v_rear IS NULL", "'{\"rearCamera\":\"EMPTY_ARRAY\",\"mainCameraMegapixel\":\"MISSING\",\"hasMainCamera\":false}'"),
    _failing_sql("ramCapacity", "v_ram IS NULL", "'{\"ram\":\"0 GB\"}'"),
    _failing_sql("romCapacity", "v_rom = 0", "'{\"storage\":\"0 TB\"}'"),
))


#: Ids a row of the reports that are compared: few enough for keys of several rows.
_CHUNK = 40


def _chunks(keys: str, rows: str) -> str:
    """Every id of each key in input order, so many a row."""
    return f"SELECT {keys}, failed_count, chunk::INT AS chunk, string_agg(id::VARCHAR, ',' ORDER BY id) AS document_ids FROM (SELECT *, (row_number() OVER (PARTITION BY {keys} ORDER BY id) - 1) // {_CHUNK} AS chunk, count(*) OVER (PARTITION BY {keys}) AS failed_count FROM ({rows})) GROUP BY {keys}, failed_count, chunk"


@query("failure_report_by_value", f"WITH {CAT}, f AS ({BY_VALUE}) {_chunks('processor, value', 'FROM f')}")
def failure_report_by_value(spark, sf_dir):
    found = report.by_value(report.failures(adapter.catalogue(spark, sf_dir)), _CHUNK)
    return found.select("processor", "value", "failed_count", "chunk", F.array_join("document_ids", ",").alias("document_ids"))


_BY_CHIPSET = "SELECT 'cpuPerformance' AS processor, chipset, 'MISSING' AS value, id FROM cat WHERE v_cpu IS NULL"


@query("failure_report_by_chipset", f"WITH {CAT} {_chunks('processor, chipset, value', _BY_CHIPSET)}")
def failure_report_by_chipset(spark, sf_dir):
    found = report.by_chipset(report.failures(adapter.catalogue(spark, sf_dir)), _CHUNK)
    return found.select("processor", "chipset", "value", "failed_count", "chunk", F.array_join("document_ids", ",").alias("document_ids"))


@query("failure_totals", f"WITH {CAT} " + " UNION ALL ".join(f"SELECT '{c}' AS processor, count(*) FILTER (WHERE {test}) AS failed_count FROM cat" for c, test in _FAILED.items() if c != "gpuPerformance"))
def failure_totals(spark, sf_dir):
    return report.totals(report.failures(adapter.catalogue(spark, sf_dir)))


_PHRASE = "CASE o_orderkey % 4 WHEN 0 THEN 'Show me phones under ' || (o_custkey % 90) || 'k please' WHEN 1 THEN 'I want a tablet between ' || (o_custkey % 50) || ',000 and ' || (o_custkey % 90) || 'k' WHEN 2 THEN 'looking for below ' || o_custkey ELSE 'Phone ' || o_orderpriority END"


@query("nlp_price_parse", rf"""WITH p AS (SELECT o_orderkey, {_PHRASE} AS raw FROM orders), m AS (SELECT *, lower(raw) AS s FROM p),
  x AS (SELECT *, regexp_extract(s, '(under|below)\s*([\d,]+k?)', 2) AS u, regexp_extract(s, 'between\s*([\d,]+k?)\s*(and|to|-)\s*([\d,]+k?)', 1) AS a, regexp_extract(s, 'between\s*([\d,]+k?)\s*(and|to|-)\s*([\d,]+k?)', 3) AS b,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'i want|i need|show me|find me|looking for', '', 'g'), 'under\s*[\d,]+k?', '', 'g'), 'below\s*[\d,]+k?', '', 'g'), 'between\s*[\d,]+k?\s*(and|to|-)\s*[\d,]+k?', '', 'g'), 'for me|please', '', 'g')) AS w FROM m)
  SELECT o_orderkey, try_cast(rtrim(replace(CASE WHEN u <> '' THEN u ELSE b END, ',', ''), 'k') AS DOUBLE) * CASE WHEN (CASE WHEN u <> '' THEN u ELSE b END) LIKE '%k' THEN 1000 ELSE 1 END AS max_price,
    CASE WHEN u = '' THEN try_cast(rtrim(replace(a, ',', ''), 'k') AS DOUBLE) * CASE WHEN a LIKE '%k' THEN 1000 ELSE 1 END END AS min_price, CASE WHEN length(w) < 3 THEN raw ELSE w END AS keywords FROM x""")  # fmt: skip
def nlp_price_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("p", planner.price_phrases(F.expr(_PHRASE)))
    return rows.select("o_orderkey", "p.max_price", "p.min_price", "p.keywords")


def _encoded(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"


@query("search_url", f"""SELECT p_partkey AS id, 'https://shop.test/search?q=' || {_encoded('p_name')} || '&' || CASE WHEN p_partkey % 3 = 0 THEN 'marketplace=SHOP&as-show=on&as=off' ELSE 'sid=tyy%2C4io'
  || '&p%5B%5D=facets.price_range.to%3D' || p_size || CASE WHEN p_partkey % 3 = 1 THEN '&p%5B%5D=facets.brand%5B%5D%3D' || {_encoded('p_brand')} || '&p%5B%5D=facets.brand%5B%5D%3Dx%7Ey*' ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN '&p%5B%5D=facets.internal_storage%5B%5D%3D128+GB' ELSE '' END END AS url FROM part""")  # fmt: skip
def search_url(spark, sf_dir):
    key, none = F.col("p_partkey"), F.lit(None)
    some = key % 3 != 0
    brands = F.when(key % 3 == 1, F.array("p_brand", F.lit("x~y*")))
    url = planner.search_addresses(F.col("p_name"), none.cast("double"), F.when(some, F.col("p_size").cast("double")), brands, F.when(some & (key % 2 == 0), F.lit("128 GB")), none.cast("array<string>"), SHOP)
    return table(spark, sf_dir, "part").select(key.alias("id"), url.alias("url"))


@query("rating_prefix", r"SELECT event_id, nullif(regexp_extract(round(value, 1)::DECIMAL(18,1)::VARCHAR || CASE WHEN event_id % 3 = 0 THEN ' stars' ELSE '' END, '^(\d+\.?\d*)', 1), '') AS rating FROM events")
def rating_prefix(spark, sf_dir):
    shown = F.concat(F.round("value", 1).cast("decimal(18,1)").cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit(" stars")).otherwise(F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", text.rating_prefix(shown).alias("rating"))


_LINK = "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '/p/' || page_id ELSE '' END"


@query("absolutize_link", f"SELECT page_id, CASE WHEN x = '' THEN NULL WHEN starts_with(x, 'http') THEN x ELSE 'https://shop.test' || x END AS link FROM (SELECT page_id, {_LINK} AS x FROM pages)")
def absolutize_link(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.absolute_link(F.expr(_LINK), "https://shop.test").alias("link"))


@query("join_bullets", "SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN p_name ELSE p_name || ' | ' || p_type END AS description FROM part")
def join_bullets(spark, sf_dir):
    items = F.array(F.concat(F.lit("\t"), "p_name", F.lit(" ")), F.lit("  "), F.when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.joined_bullets(items).alias("description"))


@query("collapse_blanks", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[\t-\r \x{00A0}]+', ' ', 'g'), '^ +| +$', '', 'g') AS collapsed FROM documents")
def collapse_blanks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse("text").alias("collapsed"))


@query("url_slashes", r"SELECT page_id, regexp_replace(url, '^(https?):/+', '\1://') AS fixed FROM pages")
def url_slashes(spark, sf_dir):
    broken = F.replace(F.replace("url", F.lit("//"), F.lit("/")), F.lit("/"), F.lit("\\"))
    return table(spark, sf_dir, "pages").select("page_id", text.url_slashes(broken).alias("fixed"))


@query("clean_json", """SELECT event_id, '{"type":"' || event_type || '","n":' || (event_id % 7) || '}' AS cleaned FROM events""")
def clean_json(spark, sf_dir):
    raw = F.concat(F.lit('{ "type" :\n  "'), "event_type", F.lit('\\n" , "n":'), (F.col("event_id") % 7).cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", text.clean_json(raw).alias("cleaned"))


@query("bearer_token", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'tok ' || user_id END AS token FROM events")
def bearer_token(spark, sf_dir):
    header = F.concat(F.element_at(F.array(F.lit("Bearer tok "), F.lit("bearer tok "), F.lit("Basic tok ")), (F.col("event_id") % 3 + 1).cast("int")), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", text.bearer_token(header).alias("token"))


@query("date_layouts", "SELECT event_id, strftime(ts, '%d-%m-%Y') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%H:%M:00') AS minute, dayname(ts) AS weekday FROM events")
def date_layouts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *(F.date_format("ts", layout).alias(name) for name, layout in text.DATE_LAYOUTS.items()))


@query("number_text", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 2 = 0 THEN (l_quantity / 2)::BIGINT::VARCHAR ELSE (l_quantity / 2)::VARCHAR END AS half FROM lineitem")
def number_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.number_text(F.col("l_quantity") / 2).alias("half"))


def _unescaped(x: str) -> str:
    """Entities decoded in SQL; a title may be cut in the middle of its last one."""
    for entity, char in (("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{entity}', '{char}', 'g')"
    return x


_TITLE, _HEADING = (_unescaped(f"trim(regexp_extract(html, '<{tag}[^>]*>([^<]*)</{tag}>', 1))") for tag in ("title", "h1"))


@query("html_title", f"SELECT page_id, nullif({_TITLE}, '') AS title, nullif({_HEADING}, '') AS heading FROM pages")
def html_title(spark, sf_dir):
    return _outlines(spark, sf_dir).select("page_id", "title", "heading")


@query("html_links", "SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1))::INT AS n_links, array_to_string(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def html_links(spark, sf_dir):
    return _outlines(spark, sf_dir).select("page_id", F.size("links").alias("n_links"), F.array_join(F.transform("links", lambda a: a["href"]), " ").alias("links"))


def _outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.records(table(spark, sf_dir, "pages"), listings.outline, "title string, heading string, links array<struct<href: string, text: string>>")


@query("listing_cards", """SELECT p_partkey // 10 AS page_id, CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' & case' END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'http://shop.test' ELSE 'https://shop.test' END || '/item/' || p_partkey AS link,
  p_type || ' | size ' || p_size AS description, (p_partkey % 5) || '.5' AS rating, '/i.png' AS image FROM part""")  # fmt: skip
def listing_cards(spark, sf_dir):
    return listings.listing(adapter.listing_pages(spark, sf_dir), LAYOUT).select("page_id", "title", "link", "description", "rating", "image")


@query("listing_cards_capped", "SELECT p_partkey // 10 AS page_id, count(*)::BIGINT AS n FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS k FROM part) WHERE k <= 3 GROUP BY 1")
def listing_cards_capped(spark, sf_dir):
    return listings.listing(adapter.listing_pages(spark, sf_dir), LAYOUT, cap=3).groupBy("page_id").agg(F.count("*").alias("n"))


@query("last_n_messages", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_n_messages(spark, sf_dir):
    found = threads.last_messages(adapter.messages(spark, sf_dir), 3)
    return found.select(F.col("thread_id").alias("conv_id"), F.col("seq").alias("turn"), F.col("content").alias("text"))


@query("last_n_in_array", "SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 GROUP BY conv_id")
def last_n_in_array(spark, sf_dir):
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ts"))
    return lists.select("conv_id", F.array_join(threads.last_elements(F.col("ts"), 4).cast("array<string>"), ",").alias("turns"))


@query("thread_first", "SELECT c.conv_id, c.turn, c.text FROM conversations c JOIN (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY conv_id) m ON c.conv_id = m.conv_id AND c.turn = m.t")
def thread_first(spark, sf_dir):
    rows = adapter.messages(spark, sf_dir).withColumn("_ordinal", F.col("seq"))
    return threads.first_documents(rows).select(F.col("thread_id").alias("conv_id"), F.col("seq").alias("turn"), F.col("content").alias("text"))


@query("thread_lookup", "SELECT conv_id, turn, text FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 1")
def thread_lookup(spark, sf_dir):
    rows = adapter.messages(spark, sf_dir).withColumn("thread_id", F.col("thread_id").cast("string")).withColumn("_ordinal", F.col("seq"))
    return threads.first_of_thread(rows, "3").select(F.col("thread_id").cast("bigint").alias("conv_id"), F.col("seq").alias("turn"), F.col("content").alias("text"))


@query("thread_cap", "SELECT conv_id, count(*) AS n_messages, count(*) < 5 AS open FROM conversations GROUP BY conv_id")
def thread_cap(spark, sf_dir):
    return threads.may_append(adapter.messages(spark, sf_dir), 5).withColumnRenamed("thread_id", "conv_id")


@query("chat_turns", """SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN text || chr(10) || chr(10) || 'Product: item 1 of ' || conv_id || chr(10) || 'Verdict: ' || CASE WHEN conv_id % 2 = 0 THEN 'verdict 1' ELSE '' END
  || chr(10) || chr(10) || 'Product: item 2 of ' || conv_id || chr(10) || 'Verdict: ' || CASE WHEN conv_id % 2 = 0 THEN 'verdict 2' ELSE '' END ELSE text END AS content FROM conversations WHERE role <> 'system'""")  # fmt: skip
def chat_turns(spark, sf_dir):
    found = threads.turns(adapter.messages(spark, sf_dir))
    return found.select(F.col("thread_id").alias("conv_id"), F.col("seq").alias("turn"), "role", "content")


@query("product_view", f"{RANKED}, t AS (SELECT id, title, {TOTAL} AS total FROM ok, ctx ORDER BY total DESC, id LIMIT 8) SELECT count(*)::INT AS n, string_agg(title, '|' ORDER BY total DESC, id) AS titles, '' AS verdicts FROM t")
def product_view(spark, sf_dir):
    ranked = scoring.presented(scoring.rank(_candidates(spark, sf_dir), WEIGHTS, 8))
    view = ranked.agg(threads.product_view(ranked).alias("v"))
    return view.select(F.size("v").alias("n"), F.array_join(F.transform("v", lambda p: p["title"]), "|").alias("titles"), F.array_join(F.transform("v", lambda p: p["verdict"]), "").alias("verdicts"))


@query("index_left_join", "SELECT o_orderkey AS at, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS \"detailTitle\", CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS customer FROM orders")
def index_left_join(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("name"))
    found = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("title"), F.col("o_custkey").alias("customer"))
    return chips.with_details(rows, found).select("at", "name", "detailTitle", "detail.customer")


@query("limit_details", "SELECT o_orderkey AS at FROM orders WHERE o_orderkey % 2 = 0 ORDER BY o_orderkey LIMIT 20")
def limit_details(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("href"))
    return chips.wanted_details(rows).select("at")


@query("soc_upsert", """WITH o AS (SELECT s_name AS title, s_nationkey AS nation, s_acctbal AS total FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT s_suppkey AS k, s_name AS title, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal + 1 END AS total FROM supplier WHERE s_suppkey % 2 = 0)
  SELECT coalesce(o.title, n.title) AS title, o.nation, CASE WHEN n.title IS NULL OR n.k % 5 = 0 THEN o.total ELSE n.total END AS total FROM o FULL JOIN n ON o.title = n.title""")  # fmt: skip
def soc_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    stored = rows.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("title"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("total"))
    new = rows.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") + 1).alias("total"), "s_suppkey")
    documents = keyed.KeyedTable(spark, places.scratch(spark, "documents"), "title string, nation int, total double", buckets=8)
    documents.upsert(stored)
    documents.upsert(new, supplied={"total": F.col("s_suppkey") % 5 != 0})
    return documents.read()


@query("append_pages", "SELECT p_partkey AS id, p_name AS title, 0 AS page_no FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE p_partkey % 3 = 0")
def append_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return dedup.appended(rows.where("id % 2 = 0"), rows.where("id % 3 = 0"))


@query("first_n_of_array", "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n <= 2 GROUP BY l_orderkey")
def first_n_of_array(spark, sf_dir):
    kept = dedup.first_n_each(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", 2)
    return kept.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("lines"))


@query("recommend", f"WITH {CAT}, ok AS (SELECT * FROM cat WHERE price >= 901 AND price <= 1410 AND {VALID}), {CTX} SELECT id::VARCHAR AS \"dbRecordId\", title FROM (SELECT id, title, {' + '.join(f'{RAW[c]} * ({w})::DOUBLE' for c, w in {'batteryEndurance': '3/13.0::DOUBLE', 'displayQuality': '1/13.0::DOUBLE', 'cpuPerformance': '1/13.0::DOUBLE', 'gpuPerformance': '1/13.0::DOUBLE', 'cameraQuality': '5/13.0::DOUBLE', 'ramCapacity': '1/13.0::DOUBLE', 'romCapacity': '1/13.0::DOUBLE'}.items())} AS total FROM ok, ctx ORDER BY total DESC, id LIMIT 8)")
def recommend(spark, sf_dir):
    from .recommend import recommend as run

    return run(adapter.catalogue(spark, sf_dir), "battery, camera and selfie, between 901 and 910").ranked.select("dbRecordId", "title")


@query("failure_rows", f"WITH {CAT}, f AS ({BY_VALUE}) SELECT processor, value, id::VARCHAR AS document FROM f")
def failure_rows(spark, sf_dir):
    found = report.failures(adapter.catalogue(spark, sf_dir)).where(~F.col("processor").isin(*report.BY_CHIPSET))
    return found.select("processor", "value", F.col("_id").alias("document"))


@query("report_total", f"WITH {CAT} SELECT count(*) AS records, sum({' + '.join(f'({test})::INT' for test in _FAILED.values())})::BIGINT AS failures FROM cat")
def report_total(spark, sf_dir):
    devices = adapter.catalogue(spark, sf_dir)
    return devices.agg(F.count("*").alias("records")).crossJoin(report.failures(devices).agg(F.count("*").alias("failures")))  # a row each


_CHAIN = f"""near AS (SELECT *, {_FAILED_LIST} = '' AS fine FROM cat WHERE price >= 900.5 AND price <= 915), steps AS (SELECT title, id, 0 AS stage FROM near UNION ALL SELECT title, id, 1 FROM near WHERE fine),
  firsts AS (SELECT title, min_by(price, id) AS price, min_by('/item/' || id, id) AS link FROM near GROUP BY title)"""


@query("tracked_by_title", f"WITH {CAT}, {_CHAIN} SELECT title, price, link, (row_number() OVER (PARTITION BY title ORDER BY stage, id) - 1)::INT AS at, CASE stage WHEN 0 THEN 'validation' ELSE 'scoring' END AS name FROM steps JOIN firsts USING (title)")
def tracked_by_title(spark, sf_dir):
    return scoring.tracked_by_title(_candidates(spark, sf_dir), WEIGHTS).select("title", "price", "link", "at", "name")


_RAWS = " UNION ALL ".join(f"SELECT id, total, {i} AS place, '{said}' AS said, {RAW[c]} AS raw, {w}::DOUBLE AS weight FROM t" for i, (c, w, said) in enumerate((c, w, planner.SAID[c]) for c, w in WEIGHTS.items()))


@query("verdicts", f"{RANKED}, t AS (SELECT *, {TOTAL} AS total FROM ok, ctx ORDER BY total DESC, id LIMIT 8), u AS ({_RAWS}), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY raw DESC, weight DESC, place) AS n FROM u), worst AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY raw, weight DESC, place) AS n FROM u) "
       "SELECT best.id::VARCHAR AS \"dbRecordId\", 'Good if ' || best.said || ' matters most to you. Skip if you depend on ' || worst.said || '.' AS verdict FROM best JOIN worst ON best.id = worst.id WHERE best.n = 1 AND worst.n = 1")  # fmt: skip
def verdicts(spark, sf_dir):
    from .recommend import Recommendation, with_verdicts

    ranked = scoring.presented(scoring.rank(scoring.enriched(_candidates(spark, sf_dir)), WEIGHTS, 8))
    return with_verdicts(Recommendation(ranked, [], WEIGHTS, "parts")).select("dbRecordId", "verdict")


@query("product_json", f"{RANKED} SELECT '{{\"title\":\"' || title || '\",\"brand\":\"' || brand || '\",\"n\":' || id || '}}' AS told FROM ok, ctx ORDER BY {TOTAL} DESC, id LIMIT 8")
def product_json(spark, sf_dir):
    ranked = scoring.presented(scoring.rank(_candidates(spark, sf_dir), WEIGHTS, 8)).withColumn("n", F.col("_ordinal"))
    return ranked.select(conversation.product_json(["title", "brand", "n"]).alias("told"))


_WISH = "CASE p_partkey % 4 WHEN 0 THEN 'a ' || p_brand || ' with ' || p_size || ' GB RAM and ' || p_size * 8 || 'gb storage' WHEN 1 THEN p_size || 'gb, 1.5 TB, ' || p_size || ' GB' WHEN 2 THEN 'Brand#11 or brand#23 please' ELSE p_name END"
_OFFERED = tuple(f"Brand#{n}" for n in (11, 12, 13, 23, 34))


@query("facet_parse", f"""WITH w AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_size AS z, p_brand AS b, list_contains([{', '.join(f"'{b}'" for b in _OFFERED)}], p_brand) AS known FROM part)
  SELECT id, CASE k WHEN 0 THEN CASE WHEN known THEN b END WHEN 2 THEN 'Brand#11,Brand#23' END AS brands, CASE WHEN k = 0 THEN z * 8 || ' GB' WHEN k = 1 AND z <= 24 THEN '1.5 TB' WHEN k = 1 THEN z || ' GB' END AS storage,
    CASE WHEN k = 0 OR (k = 1 AND z <= 24) THEN z || ' GB' END AS ram FROM w""")  # fmt: skip
def facet_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("f", planner.facet_phrases(F.expr(_WISH), _OFFERED))
    return rows.select(F.col("p_partkey").alias("id"), F.array_join("f.brands", ",").alias("brands"), "f.storage", F.array_join("f.ram", ",").alias("ram"))


_EVEN = " + ".join(f"{RAW[c]} * (1/7.0::DOUBLE)" for c in WEIGHTS)


@query("recommend_facets", f"WITH {CAT}, ok AS (SELECT * FROM cat WHERE price >= 901 AND price <= 1410 AND {VALID} AND brand IN ('Brand#11', 'Brand#23') AND v_ram IN (8, 12)), {CTX} SELECT id::VARCHAR AS \"dbRecordId\", title FROM (SELECT id, title, {_EVEN} AS total FROM ok, ctx ORDER BY total DESC, id LIMIT 8)")
def recommend_facets(spark, sf_dir):
    from functools import partial

    from .recommend import recommend as run

    wish = "brand#11 or Brand#23, 8 GB or 12gb, between 901 and 910"
    found = run(adapter.catalogue(spark, sf_dir), wish, parse=partial(planner.parse_request, brands=_OFFERED), weigh=lambda _: dict.fromkeys(WEIGHTS, 1 / 7), facets=True)
    return found.ranked.select("dbRecordId", "title")


@query("thread_by_id", "SELECT conv_id, turn, text FROM conversations WHERE conv_id * 100 + turn = 301")
def thread_by_id(spark, sf_dir):
    rows = adapter.messages(spark, sf_dir).withColumn("_id", F.col("thread_id") * 100 + F.col("seq"))
    return threads.by_id(rows, 301).select(F.col("thread_id").alias("conv_id"), F.col("seq").alias("turn"), F.col("content").alias("text"))


@query("turn_appended", "SELECT conv_id, n + k AS turn, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE k WHEN 0 THEN 'and the second?' ELSE 'that one' END AS content FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id = 3 GROUP BY conv_id), (SELECT unnest([0, 1]) AS k)")
def turn_appended(spark, sf_dir):
    rows = adapter.messages(spark, sf_dir).where("thread_id = 3").withColumn("thread_id", F.col("thread_id").cast("string")).withColumn("timestamp", F.current_timestamp())
    made = threads.appended_turn(rows, "3", "and the second?", "that one")
    return made.select(F.col("thread_id").cast("bigint").alias("conv_id"), F.col("seq").alias("turn"), "role", "content")


_CHIP_ROW = "concat('<tr><td>', s_suppkey, '</td><td><a href=\"/soc/', s_suppkey, '\"> ', s_name, '</a><span class=\"text-gray-small\">N', s_nationkey, '</span></td><td><div class=\"table-list-score-box\">', s_suppkey % 100, '</div></td><td><div><div>', s_suppkey * 10, '</div></div></td><td></td><td><span class=\"table-list-custom-circle\">8</span></td><td>3 GHz</td><td>', IF(s_suppkey % 2 = 0, 'G', ''), '</td></tr>')"


@query("chip_rankings", "SELECT s_nationkey AS page_id, trim(s_name) AS name, 'N' || s_nationkey AS brand, (s_suppkey % 100)::VARCHAR AS rating, (s_suppkey * 10)::VARCHAR AS antutu, NULL::VARCHAR AS geekbench, CASE WHEN s_suppkey % 2 = 0 THEN 'G' END AS gpu, '/soc/' || s_suppkey AS href FROM supplier")
def chip_rankings(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("page_id")).agg(F.array_join(F.collect_list(F.expr(_CHIP_ROW)), "").alias("rows"))  # a nation's few suppliers
    pages = rows.select("page_id", F.concat(F.lit('<table class="table-list sortable"><tbody>'), "rows", F.lit("</tbody></table>")).alias("html"))
    return chips.rankings(pages).select("page_id", "name", "brand", "rating", "antutu", "geekbench", "gpu", "href")


_CHIP_PAGE = "concat('<h1 class=\"title-h1\">', s_name, '</h1><div class=\"card\"><i id=\"antutu\"></i><b class=\"score-bar-result-number\">', s_suppkey * 10, '</b><table class=\"specs-table\"><tbody><tr><td class=\"cell-h\">CPU</td><td class=\"cell-s\">', s_suppkey, '</td></tr></tbody></table></div>', IF(s_suppkey % 2 = 0, '<div class=\"card\"><h3 class=\"title-h2\">Graphics</h3><table class=\"specs-table\"><tbody><tr><td class=\"cell-h\">name</td><td class=\"cell-s\">G &amp; H</td></tr></tbody></table></div>', ''), '<div class=\"card\"><i id=\"phones\"></i><table class=\"table-list\"><tbody><tr><td><a href=\"/p\">P', s_nationkey, '</a></td><td>7</td></tr></tbody></table></div>')"


@query("chip_details", "SELECT s_suppkey::BIGINT AS page_id, trim(s_name) AS title, (s_suppkey * 10)::VARCHAR AS total, s_suppkey::VARCHAR AS cpu, CASE WHEN s_suppkey % 2 = 0 THEN 'G & H' END AS graphics, 'P' || s_nationkey AS phone FROM supplier")
def chip_details(spark, sf_dir):
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("page_id"), F.expr(_CHIP_PAGE).alias("html"))
    found = chips.details(pages)
    return found.select("page_id", "title", "antutu.total", F.col("antutu.breakdown")["CPU"].alias("cpu"), F.col("sections")["Graphics"]["name"].alias("graphics"), F.col("smartphones")[0]["name"].alias("phone"))


@query("resolved_links", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://shop.test/a/x' || page_id WHEN 1 THEN 'https://shop.test/q?p=' || page_id WHEN 2 THEN 'https://shop.test/up/' || page_id ELSE 'http://other.test/' || page_id END AS link FROM pages")
def resolved_links(spark, sf_dir):
    href = "CASE page_id % 4 WHEN 0 THEN concat('x', page_id) WHEN 1 THEN concat('/q?p=', page_id) WHEN 2 THEN concat('../up/', page_id) ELSE concat('http://other.test/', page_id) END"
    return table(spark, sf_dir, "pages").select("page_id", text.resolved(F.lit("https://shop.test/a/b"), F.expr(href)).alias("link"))


@query("page_links", """SELECT page_id, array_to_string([regexp_extract(url, '^(https?://[^/?#]+)', 1) || h FOR h IN regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)], ' ') AS links FROM pages""")
def page_links(spark, sf_dir):
    """Links of pages, which start at their hosts' roots, extracted where the pages lie and resolved in columns."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html"))
    found = html.records(rows.select(F.struct("page_id", "url").alias("page"), "html"), listings.outline, "links array<struct<href: string, text: string>>", id_col="page")
    flat = found.select(F.col("page_id.page_id").alias("id"), F.col("page_id.url").alias("url"), "links")
    return flat.select(F.col("id").alias("page_id"), F.array_join(F.transform("links", lambda a: text.resolved(F.col("url"), a["href"])), " ").alias("links"))


@query("catalogue_array", f"WITH {CAT} SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS place, id::VARCHAR AS id, title, price, v_rear AS rear, v_cpu AS cpu, p_size || CASE WHEN p_size % 5 = 0 THEN ' TB' ELSE 'GB' END AS storage FROM cat")
def catalogue_array(spark, sf_dir):
    """The catalogue written in order, an array a task, and read by splits; the numbers are places over all arrays."""
    path = places.scratch(spark, "catalogue")
    source.export(adapter.catalogue(spark, sf_dir).orderBy("_ordinal").drop("_ordinal"), path, layout="array")
    rows = source.numbered(source.read_catalogue(spark, path))
    rear = F.filter("normalizedSpecs.extracted.camera.rearCamera", lambda c: c["position"] == "main")
    cpu = F.col("normalizedSpecs.extracted.technical.benchmark.antutu.breakdown")["CPU"]
    best = numbers.largest(F.transform("normalizedSpecs.extracted.camera.rearCamera", lambda c: c["megapixel"]))
    return rows.select("place", F.col("_id").alias("id"), "title", "price", F.when(F.size(rear) > 0, best).alias("rear"), text.number_prefix(cpu).alias("cpu"), F.col("normalizedSpecs.specs")["memory"]["storage"].alias("storage"))


@query("typed_validation", f"WITH {CAT} SELECT id, concat_ws(',', CASE WHEN v_capacity IS NULL OR id % 5 = 0 THEN 'batteryEndurance' END, {', '.join(f"CASE WHEN {test}{' OR id % 3 = 0' if c == 'cpuPerformance' else ''} THEN '{c}' END" for c, test in _FAILED.items() if c != 'batteryEndurance')}) AS failed, CASE WHEN id % 7 <> 0 THEN price END AS price FROM cat")
def typed_validation(spark, sf_dir):
    """Records as JSON lines in which some CPU scores are numbers, and some capacities and prices texts: all are missing."""
    path = places.scratch(spark, "records")
    adapter.mixed_json(spark, sf_dir).write.text(path)
    found = scoring.derive(source.typed_catalogue(source.read_variants(spark, path, "lines")))
    return found.select(F.col("_id").cast("bigint").alias("id"), F.array_join(scoring.failed_categories(), ",").alias("failed"), "price")


@query("threads_after_turns", """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
  SELECT conv_id, n + CASE WHEN conv_id = 3 THEN 4 ELSE 0 END AS n_messages, CASE WHEN conv_id = 3 THEN 'those two' ELSE text END AS said FROM n JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id) USING (conv_id)""")
def threads_after_turns(spark, sf_dir):
    """Stored conversations, two turns committed to one of them, one before and one after turns are compacted."""
    store = Store(spark, places.scratch(spark, "threads"))
    store.load(adapter.messages(spark, sf_dir).withColumns({"thread_id": F.col("thread_id").cast("string"), "timestamp": F.current_timestamp(), "products": F.lit(None).cast(schemas.PRODUCTS)}))
    store.append("3", "and the second?", "that one")
    store.compact()
    store.append("3", "and both?", "those two")
    rows = store.stored_messages().withColumn("conv_id", F.col("thread_id").cast("bigint"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max_by("content", "seq").alias("said"))


_HOST = "^https?://([^/]+)"


@query("crawled_pages", f"""WITH p AS (SELECT *, regexp_extract(url, '{_HOST}', 1) AS listing FROM pages), s AS (
    SELECT listing, (row_number() OVER (PARTITION BY listing ORDER BY page_id))::INT AS page, CASE WHEN page_id % 5 = 0 THEN 'failed' WHEN page_id % 3 = 0 THEN 'empty' ELSE 'ok' END AS status, length(html)::INT AS n FROM p),
  g AS (SELECT listing, bool_or(status = 'ok') AS fine FROM s GROUP BY listing)
  SELECT listing, page, attempt::INT AS attempt, status, CASE status WHEN 'ok' THEN n WHEN 'empty' THEN 7 END AS n_chars FROM s JOIN g USING (listing), (SELECT unnest([1, 2, 3]) AS attempt) WHERE attempt = 1 OR NOT fine""")  # fmt: skip
def crawled_pages(spark, sf_dir):
    """Every page, stored under its host as a listing's, some without a text and some without a card, crawled."""
    rows = table(spark, sf_dir, "pages").withColumn("listing", F.regexp_extract("url", _HOST, 1))
    kept = F.when(F.col("page_id") % 5 != 0, F.when(F.col("page_id") % 3 == 0, F.lit("<p>none")).otherwise(F.col("html")))
    path = places.scratch(spark, "pages")
    crawl.store_pages(rows.select("listing", F.row_number().over(Window.partitionBy("listing").orderBy("page_id")).alias("page"), kept.alias("html")), path)
    spark.dataSource.register(crawl.Listings)
    found = spark.read.format("listings").option("most", str(10**6)).option("card", "article").load(path)
    return found.select("listing", "page", "attempt", "status", F.length("html").alias("n_chars"))


@query("json_export", f"WITH {CAT} SELECT id::VARCHAR AS id, title, CASE p_size % 3 WHEN 0 THEN 'unknown' ELSE 'considerable' END AS lifecycle, price FROM cat WHERE p_size % 3 < 2")
def json_export(spark, sf_dir):
    """Records of a wanted life cycle, exported as JSON by many tasks and read back."""
    path = places.scratch(spark, "export")
    source.export(source.exportable(adapter.catalogue(spark, sf_dir)), path)
    return source.read_catalogue(spark, path, "lines").select(F.col("_id").alias("id"), "title", F.col("parseHtmlSpec.meta.lifecycle").alias("lifecycle"), "price")


@query("report_written", f"WITH {CAT}, f AS ({BY_VALUE}) {_chunks('processor, value', 'FROM f')}")
def report_written(spark, sf_dir):
    """The second of two whole reports written to one folder."""
    folder, devices = places.scratch(spark, "reports"), adapter.catalogue(spark, sf_dir)
    report.write_whole(devices.limit(0), folder, chunk=_CHUNK)
    path = report.write_whole(devices, folder, chunk=_CHUNK)
    if not path.endswith(f"{report.STEM}-2"):
        raise ValueError(f"{path} isn't the second report")
    kind = "processor string, value string, failed_count bigint, first_seen bigint, chunk int, document_ids array<string>"
    return spark.read.schema(kind).json(f"{path}/by_value").select("processor", "value", "failed_count", "chunk", F.array_join("document_ids", ",").alias("document_ids"))


@query("stream_appended", "SELECT conv_id::VARCHAR AS thread_id, (n - 1)::BIGINT AS seq, content FROM (SELECT conv_id, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE n <= 4")
def stream_appended(spark, sf_dir):
    """Conversations as a stream, appended to threads that hold four messages each."""
    from ..streaming.threads import append_stream

    path = places.scratch(spark, "stream")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("thread_id"), F.timestamp_seconds(F.col("turn")).alias("arrived"), "role", F.col("text").alias("content"))
    rows.write.parquet(f"{path}/in")
    append_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/state", most=4).awaitTermination()
    return spark.read.schema("thread_id string, arrived timestamp, role string, content string, seq bigint").parquet(f"{path}/out").select("thread_id", "seq", "content")


_NEED = "CASE p_partkey % 6 WHEN 0 THEN 'A Gaming phone with a big battery' WHEN 1 THEN 'camera and selfie video' WHEN 2 THEN p_name WHEN 3 THEN 'fast, bright, long lasting, space for photos' WHEN 4 THEN ' ' ELSE 'multitask on ' || p_brand END"
_PARTS_OF = {c: "(1 + 2 * (" + " + ".join(f"contains(s, '{w}')::INT" for w in words) + "))" for c, words in planner.SIGNALS.items()}


@query("request_weights", f"WITH r AS (SELECT p_partkey AS id, lower({_NEED}) AS s FROM part) SELECT id, " + ", ".join(f"CASE WHEN trim(s) <> '' THEN {p}::DOUBLE / ({' + '.join(_PARTS_OF.values())}) END AS \"{c}\"" for c, p in _PARTS_OF.items()) + " FROM r")
def request_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("w", planner.weight_phrases(F.expr(_NEED)))
    return rows.select(F.col("p_partkey").alias("id"), *(F.col(f"w.{c}").alias(c) for c in planner.SIGNALS))
