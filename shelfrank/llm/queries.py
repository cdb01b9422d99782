"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, langid, licenses, lm, mixing, neighbours, pii, quality, shards, simhash, spelling
from .shared import crc_fold, table


#: The key of the registered queries; a deployment brings its own.
PII_KEY = "registered-query"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.summary(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2("listed", 256).alias("items_sha256"), "contaminated")


OP2_SQL = """
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents
), lens AS (SELECT DISTINCT k FROM win
), g AS (
  SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, lens WHERE len(w) >= k)
), m AS (SELECT r, s, g.k, item_id FROM g JOIN win USING (win) WHERE g.k = win.k
), hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r
), it AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""

def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id") == 1)
    found = lm.score_texts(docs, docs.where("not held_out"), keep=["held_out"])
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.assign(table(spark, sf_dir, "documents"), shards.BASE_SHARDS)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.summary(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_pii"), F.array_join(F.array_sort(F.array_distinct("pii_kinds")), ",").alias("kinds"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id") == 0)
    found = langid.identify(docs, langid.fit(docs.where("not held_out")), keep=["held_out"])
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", langid.confidence().alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id") == 0)
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id") != 0)
    found = quality.score(docs, quality.fit(docs, labels), keep=["held_out"])
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _op12_sql(rounds: int = 3) -> str:
    """Rounds of assignment and exact means, written out."""
    steps = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM kept ORDER BY h, x LIMIT 16)
)"""
    for k in range(rounds + 1):
        steps += f""", d{k} AS (SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (kept.x[i] - c{k}.x[i]) * (kept.x[i] - c{k}.x[i]))) AS d FROM kept, c{k}
), a{k} AS MATERIALIZED (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM d{k}) WHERE n = 1)"""
        if k < rounds:
            steps += f""", s{k} AS (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{k} JOIN kept USING (r), range(1, 65) AS t(i) GROUP BY c, i
), m{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{k} GROUP BY c
), c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (c))"""
    return f"""{steps}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: crc32 by its table, over the UTF-8 bytes of id and letters (up to U+00FF); near words by what is left without a letter.
OP13_SQL = """
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]{7,}')) AS run FROM documents)
  GROUP BY id, run
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)),
    lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS INTEGER)])), 4294967295) AS h FROM runs, tab
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = best.top) END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT ways.word, forms.form, k + 1 FROM ways JOIN forms ON ways.here = forms.word WHERE forms.form IS NOT NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN (SELECT word, arg_max(here, k) AS root FROM ways GROUP BY word) USING (word)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_lm_score": op3_lm_score,
    "op4_licenses": op4_licenses,
    "op5_pii": op5_pii,
    "op6_neighbours": op6_neighbours,
    "op7_shards": op7_shards,
    "op8_bpe": op8_bpe,
    "op9_langid": op9_langid,
    "op10_quality": op10_quality,
    "op11_mixing": op11_mixing,
    "op12_centroids": op12_centroids,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op12_centroids": _op12_sql(), "op13_spelling": OP13_SQL}
