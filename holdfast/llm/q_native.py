"""Queries of the operators that run as SQL expressions only: line dedup and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import line_dedup, mixing
from holdfast.llm.registry import query
from holdfast.llm.storage import table

OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS gone
  FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op3_line_dedup", sql=OP3_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS turn
  FROM documents
),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS most,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM totals
),
leveled AS (
  SELECT *, sum(weight) OVER () AS all_weight, most::DOUBLE / weight <=
    (budget - coalesce(sum(most) OVER before, 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS is_full
  FROM weighed
  WINDOW before AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
rest AS (
  SELECT *, (budget - (sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ())::DOUBLE) AS left_words,
         (all_weight - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER ())::DOUBLE AS left_weight
  FROM leveled
),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN most::DOUBLE ELSE left_words / nullif(left_weight, 0) * weight END AS target
  FROM rest
),
placed AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s
),
parts AS (
  SELECT *, (sum(blocks) OVER sofar - blocks)::DOUBLE / sum(blocks) OVER () AS lo,
         (sum(blocks) OVER sofar)::DOUBLE / sum(blocks) OVER () AS hi
  FROM (SELECT source, ceil(floor(target) / 1024)::BIGINT AS blocks FROM targets)
  WHERE blocks > 0
  WINDOW sofar AS (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)
),
points AS (
  SELECT id AS slot, fmod((id + 1)::DOUBLE * 0.6180339887498949::DOUBLE, 1::DOUBLE) AS point
  FROM range((SELECT coalesce(sum(blocks), 0)::BIGINT FROM parts)) AS r(id)
),
slots AS (
  SELECT source, blocks, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM points JOIN parts ON point >= lo AND point < hi
),
spans AS (
  SELECT p.doc_id, p.source, p.turn, p.size, p.start, t.source_size, t.target, pass,
         p.start + pass * t.source_size AS begins,
         least(p.start + pass * t.source_size + p.size, floor(t.target)::BIGINT) AS ends
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) AS v(pass)
),
pieces AS (
  SELECT doc_id, source, turn, size, start,
         unnest(generate_series((begins // 1024)::BIGINT, ((ends - 1) // 1024)::BIGINT)) AS rank
  FROM spans WHERE begins < ends
),
dealt AS (
  SELECT p.doc_id, p.source, p.size, p.start,
         min(coalesce(s.slot, 4611686018427387904 + p.rank)) AS first_slot,
         max(coalesce(s.slot, 4611686018427387904 + p.rank)) AS last_slot
  FROM pieces p
  LEFT JOIN slots s ON p.source IS NOT DISTINCT FROM s.source AND p.rank = s.rank AND s.rank < s.blocks
  GROUP BY ALL
),
taken AS (
  SELECT doc_id, source, size, start, source_size, target, sum(greatest(0, ends - begins))::BIGINT AS taken
  FROM spans GROUP BY ALL
)
SELECT t.doc_id, t.size, t.source_size, t.target, t.taken, d.first_slot::BIGINT AS first_slot,
       d.last_slot::BIGINT AS last_slot
FROM taken t LEFT JOIN dealt d
  ON t.doc_id = d.doc_id AND t.source IS NOT DISTINCT FROM d.source AND t.size = d.size AND t.start = d.start
"""


@query("op9_mixing", sql=OP9_SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.taken_words(*mixing.mix(docs))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")
