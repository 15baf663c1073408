"""The thin queries ``opN_<name>`` over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import ann_srs, decontaminate, html_blocks, jaccard_join, lang_crf, line_dedup, quality_fm, secret_scan, source_mix, url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short_repeats=True)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality_fm.train(docs, labels.where(remainder(5) != 0))
    return quality_fm.score_quality(docs, machine).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = lang_crf.train(docs.where(remainder(4) != 2))
    return lang_crf.predict_language(docs, field).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_srs.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_source_mix, op3_line_dedup, op4_secret_scan, op5_quality, op6_language, op7_nearest, op8_jaccard, op9_html_text, op10_decontaminate)}


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
),
met AS (
  SELECT *,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM met
"""

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
),
rated AS (
  SELECT *, CASE WHEN length(body) > 0 THEN greatest(0.05e0, 1 - 5e0 * (length(body) - length(translate(body, '#$%&*!|', ''))) / length(body)) ELSE 1e0 END AS quality,
         (CAST(('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
  FROM sized
),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rated GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sums),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight, 2e0 * source_size AS cap FROM placed),
levels AS (
  SELECT *, cap / weight AS ratio,
         (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
),
filled AS (
  SELECT source, source_size,
         CASE WHEN ratio < level THEN cap ELSE weight * (SELECT arg_min(level, ratio) FROM levels WHERE NOT ratio < level) END AS target
  FROM levels
),
drawn AS (
  SELECT r.doc_id, r.size, f.source_size, f.target, CASE WHEN f.source_size > 0 THEN CAST(floor(f.target / f.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(CAST(sum(r.size) OVER (PARTITION BY r.source ORDER BY -ln(r.u) / r.quality, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM rated r JOIN filled f ON r.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM drawn
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op2_source_mix": OP2_SQL}
