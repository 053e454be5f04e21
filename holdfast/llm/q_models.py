"""Queries of fingerprints, quality, toxicity and URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import digests, merkle, quality, toxicity
from holdfast.llm.q_text import id_remainder
from holdfast.llm.registry import query
from holdfast.llm.storage import table

#: Names that mark advertising, gambling, adult and scam hosts; blocked where no rule says otherwise.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
RULES = (
    ("com/", False), ("example.com/en/", True), ("www.example.com/en/", False), ("net/es/", True), ("net/fr/", True),
)


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings: 0 low quality, 1 good but toxic, 2 good. Documents likely rated 1 or more are kept; without a quality there is no rating."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    good = F.col("quality") == 1
    grade = F.when(F.col("quality") == 0, 0).when(good & (F.col("toxic") == 1), 1).when(good, 2)
    held_out = id_remainder(4) == 2
    model = quality.train(docs, labels.select("doc_id", grade.alias("grade")), ~held_out)
    rated = docs.withColumn("rated", quality.rating_column(model, at_least=1))
    return rated.select(
        "doc_id", held_out.alias("held_out"), "rated.expected_grade", F.col("rated.tail").alias("p_good"),
        F.coalesce(F.col("rated.tail") >= 0.5, F.lit(False)).alias("keep"),
    )


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder(3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score_column(model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


OP8_SQL = f"""
WITH rules AS (
  SELECT key, blocked, split_part(key, '/', 1) AS rule_host, substr(key, instr(key, '/')) AS rule_path
  FROM (VALUES {", ".join(f"('{key}', {blocked})" for key, blocked in RULES)}) r(key, blocked)
),
cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{digests.UPPER}', '{digests.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
fits AS (
  SELECT host, path, max_by(key, length(key)) AS rule, max_by(blocked, length(key)) AS blocked
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, p.host, p.path, f.rule,
       CASE WHEN coalesce(f.blocked, list_has_any(string_split(p.host, '.'), {list(BLOCKED_NAMES)})) THEN 'block' ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path
"""


@query("op8_url_filters", sql=OP8_SQL)
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(
        [*RULES, *((digests.NAME + name, True) for name in BLOCKED_NAMES)], "key string, blocked boolean"
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return digests.judge_urls(pages, entries).select("page_id", "host", "path", "rule", "verdict")
