"""Queries of the near-duplicate join of vectors, ranked search and the dataset manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import merkle_log, subspace, treap
from holdfast.llm.registry import query
from holdfast.llm.storage import table

OP11_SQL = r"""
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
linked AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN linked l ON r.v = l.u)
SELECT e.vec_id, (SELECT count(*) FROM linked l WHERE l.u = e.vec_id) AS n_links,
       min(r.v) AS component_id, e.vec_id = min(r.v) AS kept
FROM embeddings e JOIN reach r ON r.u = e.vec_id GROUP BY e.vec_id
"""


@query("op11_subspace_join", sql=OP11_SQL)
def op11_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


OP12_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, t.term, count(*) AS tf FROM documents, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t(term)
  GROUP BY doc_id, t.term
),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM sizes),
item_terms AS (
  SELECT item_id, t.term, count(*) AS times FROM benchmark, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t(term)
  GROUP BY item_id, t.term
),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM doc_terms, totals GROUP BY term
),
scores AS (
  SELECT i.item_id, d.doc_id,
         sum(i.times * w.w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * s.n * all_docs) // all_terms))))::BIGINT AS score
  FROM item_terms i JOIN doc_terms d USING (term) JOIN sizes s USING (doc_id) JOIN weights w USING (term), totals
  GROUP BY i.item_id, d.doc_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op12_ranked_search", sql=OP12_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=20)


OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
                              lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
        FROM range(256) r(i))
),
fields AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS b,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                         lambda x, c: xor(x >> 8, t[(xor(x, c) & 255) + 1])), 4294967295) % 7 = 0 AS bad
  FROM documents, crc_table
),
hashed AS (
  SELECT doc_id, lang, bad,
         sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || b) AS leaf,
         sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || b) AS wrong
  FROM fields
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM hashed
),
nodes AS (
  SELECT tree, 0 AS k, place AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY tree, k, i // 2
),
subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS k, tree AS i, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM tops WHERE n > 1 GROUP BY k, i // 2
),
walk AS (
  SELECT doc_id, tree, place, leaf, 0 AS phase, 0 AS k, place AS i, '' AS proof,
         CASE WHEN coalesce(bad, false) THEN wrong ELSE leaf END AS h,
         (SELECT max(n) FROM nodes x WHERE x.tree = l.tree AND x.k = 0) AS n
  FROM leaves l
  UNION ALL
  SELECT w.doc_id, w.tree, w.place, w.leaf, CASE WHEN w.n = 1 THEN 1 ELSE w.phase END,
         CASE WHEN w.n = 1 THEN 0 ELSE w.k + 1 END, CASE WHEN w.n = 1 THEN w.tree ELSE w.i // 2 END,
         CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || coalesce(x.h, y.h, '') END,
         CASE WHEN w.n = 1 THEN w.h WHEN w.i % 2 = 1 THEN sha256(coalesce(x.h, y.h) || w.h)
              ELSE sha256(w.h || coalesce(x.h, y.h, '')) END,
         CASE WHEN w.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (w.n + 1) // 2 END
  FROM walk w
  LEFT JOIN nodes x ON w.phase = 0 AND x.tree = w.tree AND x.k = w.k AND x.i = xor(w.i, 1)
  LEFT JOIN tops y ON w.phase = 1 AND y.k = w.k AND y.i = xor(w.i, 1)
  WHERE w.n > 1 OR w.phase = 0
)
SELECT w.doc_id, w.leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(w.proof) AS proof_sha256,
       w.h AS folded_root, w.h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM walk w JOIN subroots s USING (tree) WHERE w.phase = 1 AND w.n = 1
"""


@query("op13_merkle_manifest", sql=OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = "crc32(CAST(CAST(doc_id AS string) AS binary)) % 7 = 0"
    found = merkle_log.manifest(docs, tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
