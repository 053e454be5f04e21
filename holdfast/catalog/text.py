"""Scenario bank, prompt, reply, scan and manifest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import bridge as b
from holdfast.catalog.core import big
from holdfast.catalog.registry import query, view
from holdfast.functions import text as t
from holdfast.operators import audit as o
from holdfast.operators import manifests as mf


@query("AG20_manifest_hash", """
WITH leaf AS (SELECT h AS p, h || ':' || n AS part, n FROM (SELECT sha256('{"digest":"' || sha256(text) || '","name":"doc_' || doc_id || '"}') AS h, count(*) AS n FROM documents GROUP BY 1)),
six AS (SELECT substr(p, 1, 6) AS p, sha256(string_agg(part, '' ORDER BY p, part)) AS part, sum(n) AS n FROM (SELECT p, part, n FROM leaf) GROUP BY 1),
three AS (SELECT substr(p, 1, 3) AS p, sha256(string_agg(part, '' ORDER BY p, part)) AS part, sum(n) AS n FROM (SELECT p, part, n FROM six) GROUP BY 1)
SELECT sha256(string_agg(part, '' ORDER BY p, part)) AS digest, sum(n)::BIGINT AS records FROM three""")
def ag20(spark, sf):
    return mf.manifest_hash(mf.digests(b.table(spark, sf, "documents", "doc_id", "text"), "concat('doc_', doc_id)", "text"))


view("cells", """
SELECT 'scn_' || c_custkey AS scenario, c_mktsegment AS category, a.arm, r.run FROM customer, (SELECT unnest(['bare', 'policy', 'scaffold']) AS arm) a, (SELECT unnest([1, 2]) AS run) r""")


def cells(spark, sf):
    return b.table(spark, sf, "customer").selectExpr(
        "concat('scn_', c_custkey) AS scenario", "c_mktsegment AS category", "explode(array('bare', 'policy', 'scaffold')) AS arm").selectExpr(
        "*", "explode(array(1, 2)) AS run")


@query("ST12_interleaved_order", """
SELECT category, scenario, arm, run::BIGINT AS run, row_number() OVER (PARTITION BY category ORDER BY md5('7,' || scenario || '/' || arm || '/' || run) DESC) AS position FROM cells""", ("cells",))
def st12(spark, sf):
    rows = cells(spark, sf).withColumn("cell", F.expr("concat_ws('/', scenario, arm, run)"))
    return mf.interleaved(rows, "category", "cell", 7).select("category", "scenario", "arm", big("run"), big("position"))


def records(spark, sf):
    """Run records: two per scenario and arm where an order exists, some failed or truncated."""
    return b.table(spark, sf, "orders").selectExpr(
        "concat('scn_', o_custkey) AS scenario", "array('bare', 'policy', 'scaffold')[int(o_orderkey % 3)] AS arm", "int(o_orderkey % 2) + 1 AS run",
        "if(o_orderstatus = 'P', 'would_call', 'collected') AS status", "o_orderpriority = '1-URGENT' AS truncated",
        "if(o_orderkey % 5 = 0, NULL, int(o_orderkey % 4)) + 1 AS attempts", "o_totalprice / 100000 AS latency_seconds", "o_orderkey AS run_id")


view("records", """
SELECT 'scn_' || o_custkey AS scenario, CASE o_orderkey % 3 WHEN 0 THEN 'bare' WHEN 1 THEN 'policy' ELSE 'scaffold' END AS arm, o_orderkey % 2 + 1 AS run,
  CASE WHEN o_orderstatus = 'P' THEN 'would_call' ELSE 'collected' END AS status, o_orderpriority = '1-URGENT' AS truncated,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 + 1 END AS attempts, o_totalprice / 100000 AS latency_seconds, o_orderkey AS run_id FROM orders""")


@query("SO5_would_call", """
SELECT scenario, arm, run::BIGINT AS run FROM cells c WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.status = 'collected' AND r.scenario = c.scenario AND r.arm = c.arm AND r.run = c.run)""", ("cells", "records"))
def so5(spark, sf):
    return mf.would_call(cells(spark, sf), records(spark, sf), ["scenario", "arm", "run"]).select("scenario", "arm", big("run"))


@query("PF18_usable_records", "SELECT run_id, truncated FROM records WHERE status = 'collected'", ("records",))
def pf18(spark, sf):
    return mf.usable_records(records(spark, sf)).select("run_id", "truncated")


@query("AG16_collection_manifest", """
SELECT arm, count(*) AS records, count(*) FILTER (WHERE truncated) AS truncated_runs, sum(coalesce(attempts, 1) - 1)::BIGINT AS retries,
  round(sum(latency_seconds), 3) AS total_latency_seconds FROM records WHERE status = 'collected' GROUP BY 1""", ("records",))
def ag16(spark, sf):
    return mf.collection_manifest(records(spark, sf), ["arm"])


# --- prompts and replies ---
view("scenario_lists", """
SELECT s.*, (SELECT string_agg(ticker, ', ' ORDER BY r) FROM brand_ranks k WHERE k.o_custkey = s.c_custkey AND r <= 10) AS allowed,
  coalesce((SELECT string_agg(ticker, ', ' ORDER BY r) FROM brand_ranks k WHERE k.o_custkey = s.c_custkey AND r IN (4, 5)), '') AS owned FROM scenarios s""", ("scenarios", "brand_ranks"))
view("prompts", f"""
SELECT scenario, arm, concat_ws(chr(10), '{t.TASK_LINE}', 'Cash available: USD ' || printf('%.2f', cash) || '.', 'Allowed universe: ' || allowed || '.', 'Already owned: ' || owned || '.',
  'Recommend at most 3 tickers.', 'Facts you may cite: ' || fact_a || ', ' || fact_b || '.',
  CASE WHEN arm <> 'bare' THEN CASE WHEN add_only THEN '{t.NO_OWNED_LINE}' ELSE '{t.OWNED_OK_LINE}' END END, CASE WHEN arm <> 'bare' THEN '{t.CITE_LINE}' END,
  CASE WHEN arm <> 'bare' THEN CASE WHEN arm = 'scaffold' THEN '{t.ARITHMETIC_LEAD}' || printf('%.2f', cash) || ' pays USD ' || printf('%.2f', ceil(cash / 1000) * 2.5e0)
     || '; splitting it into two equal orders pays USD ' || printf('%.2f', ceil(cash / 2 / 1000) * 5e0) || '. ' ELSE '' END ||
     'The fee is USD 2.50 per started USD 1000 tranche, and the minimum economic order is USD 250.00. {t.FEWEST_LINE}' END,
  '{t.FORMAT_LINE}' || CASE WHEN amounts_required THEN '{t.AMOUNTS_LINE}' ELSE '{t.NO_AMOUNTS_LINE}' END) AS prompt
FROM scenario_lists, (SELECT unnest(['bare', 'policy', 'scaffold']) AS arm) a""", ("scenario_lists",))


def prompts(spark, sf):
    arms = ", ".join(f"struct('{arm}' AS arm, {t.prompt(arm)} AS prompt)" for arm in t.PROMPT_ARMS)
    return b.scenarios(spark, sf).selectExpr("scenario", f"inline(array({arms}))")


@query("TX1_prompts", "SELECT scenario, arm, prompt FROM prompts", ("prompts",))
def tx1(spark, sf):
    return prompts(spark, sf)


@query("TX3_prompt_digest", "SELECT scenario, arm, sha256(prompt) AS digest FROM prompts", ("prompts",))
def tx3(spark, sf):
    return prompts(spark, sf).selectExpr("scenario", "arm", f"{t.digest('prompt')} AS digest")


def replies(spark, sf, legs=None):
    """Raw replies built from the runs: JSON in prose, with every seventh one damaged."""
    body = "to_json(struct(tickers, amounts, cited_fact_ids))"
    damaged = (f"CASE int(run_id % 35 / 7) WHEN 0 THEN 'I cannot answer.' WHEN 1 THEN replace({body}, '\"tickers\":[', '\"picks\":[') WHEN 2 THEN '{{\"tickers\": [1, 2]}}' "
               "WHEN 3 THEN '{\"tickers\": [\"A\"], \"amounts\": [true]}' ELSE '{\"tickers\": [' END")
    return b.runs(spark, sf, legs).selectExpr("scenario", "run_id", "arm", "tickers AS sent", "size(amounts) AS n_amounts",
                                        f"if(run_id % 7 = 0, {damaged}, concat('Here is my plan: ', {body}, ' Thanks.')) AS raw_response")


@query("TX2_reply_parsing", """
SELECT r.run_id, CASE WHEN r.run_id % 7 <> 0 THEN '' ELSE CASE (r.run_id % 35) // 7 WHEN 0 THEN 'no JSON object found in model response' WHEN 1 THEN 'model response has no tickers list'
   WHEN 2 THEN 'model response tickers must contain only strings' WHEN 3 THEN 'model response amounts must be a list of numbers' ELSE 'no JSON object found in model response' END END AS parse_error,
  CASE WHEN r.run_id % 7 <> 0 THEN l.n ELSE 0 END AS n_tickers, CASE WHEN r.run_id % 7 <> 0 AND r.has_amounts THEN l.n ELSE 0 END AS n_amounts
FROM runs r JOIN (SELECT run_id, count(*) AS n FROM legs GROUP BY 1) l USING (run_id)""", ("runs", "legs"))
def tx2(spark, sf):
    rows = t.parse_replies(replies(spark, sf).drop("n_amounts"))
    return rows.selectExpr("run_id", "coalesce(parse_error, '') AS parse_error", "bigint(size(tickers)) AS n_tickers", "bigint(size(amounts)) AS n_amounts")


@query("SJ9_provenance", """
SELECT r.scenario, r.run_id, r.arm, r.run_id % 11 <> 0 AS hash_ok, r.run_id % 13 <> 0 AS prompt_ok, r.run_id % 7 <> 0 AS parse_ok
FROM runs r""", ("runs",))
def sj9(spark, sf):
    scen = b.scenarios(spark, sf)
    rows = replies(spark, sf).join(prompts(spark, sf), ["scenario", "arm"]).selectExpr(
        "scenario", "run_id", "arm", "raw_response", "transform(sent, x -> upper(x)) AS stored_tickers",
        "if(run_id % 13 = 0, concat(prompt, ' edited'), prompt) AS prompt").selectExpr(
        "*", f"if(run_id % 11 = 0, 'stale', {t.digest('prompt')}) AS prompt_hash")
    return mf.provenance(rows, scen)


@query("TX4_path_slug", """
SELECT page_id AS doc_id, coalesce(nullif(trim(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), ''), 'unnamed') AS slug FROM pages""")
def tx4(spark, sf):
    return spark.read.schema("page_id BIGINT, url STRING").parquet(f"{sf}/pages.parquet").selectExpr("page_id AS doc_id", f"{t.slug('url')} AS slug")


EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("TX5_privacy_scan", rf"""
SELECT doc_id, label, line, value FROM (
  SELECT doc_id, 'non-anonymous email' AS label, line, lower(unnest(regexp_extract_all(txt, '\b{EMAIL_SQL}\b'))) AS value
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents))
WHERE value NOT IN ('anonymous@example.com', 'reviewer@example.com', 'user@example.com')
UNION ALL
SELECT doc_id, 'token assignment', line, unnest(regexp_extract_all(txt, 'token = "[0-9a-f]+"')) AS value
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)""")
def tx5(spark, sf):
    return t.scan_documents(b.table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "label", big("line"), "value")


@query("TX6_token_estimate", """
SELECT conv_id, turn, ceil(length(text) / 4e0)::BIGINT AS tokens, '$' || CASE WHEN round(length(text) / 4096e0 / 100, 4) < 0.01 THEN printf('%.4f', length(text) / 4096e0 / 100) ELSE printf('%.2f', length(text) / 4096e0 / 100) END AS cost
FROM conversations""")
def tx6(spark, sf):
    rows = b.table(spark, sf, "conversations")
    return rows.selectExpr("conv_id", "turn", f"{t.token_estimate('text')} AS tokens", f"{t.usd_label('(length(text) / 4096D / 100)')} AS cost")


@query("AG19_token_budget", """
SELECT r_name AS provider, 'm' || r_regionkey AS model, (SELECT count(*) * 5 FROM conversations) AS calls, (SELECT (sum(ceil(length(text) / 4e0)) * 5)::BIGINT FROM conversations) AS input_tokens,
  (SELECT count(*) * 5 * 4000 FROM conversations) AS output_tokens, (SELECT sum(ceil(length(text) / 4e0)) * 5 FROM conversations) * (r_regionkey + 1) / 1000000e0 AS input_cost,
  (SELECT count(*) * 5 * 4000 FROM conversations) * (r_regionkey + 1) * 5 / 1000000e0 AS output_cost FROM region""")
def ag19(spark, sf):
    prices = b.table(spark, sf, "region").selectExpr("r_name AS provider", "concat('m', r_regionkey) AS model",
                                                     "cast(r_regionkey + 1 AS decimal(9,2)) AS input_usd_per_mtok", "cast((r_regionkey + 1) * 5 AS decimal(9,2)) AS output_usd_per_mtok")
    text = b.table(spark, sf, "conversations").selectExpr("text AS prompt")
    return mf.token_budget(text, prices, 5, 4000).selectExpr("provider", "model", "calls", "input_tokens", "output_tokens", "double(input_cost) AS input_cost", "double(output_cost) AS output_cost")


@query("TX7_iso_dates", """
SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN ts::DATE END AS day FROM events""")
def tx7(spark, sf):
    raw = "if(event_id % 4 <> 3, date_format(ts, 'yyyy-MM-dd'), concat('x', event_id)) AS raw"
    return b.table(spark, sf, "events").selectExpr("event_id", raw).selectExpr("event_id", "try_to_date(raw, 'yyyy-MM-dd') AS day")


@query("TX8_percent_quotes", """
SELECT 'Q' || user_id AS ticker, event_id, value AS price, round(value / 50, 4) AS change_percent FROM events""")
def tx8(spark, sf):
    raw = b.table(spark, sf, "events").selectExpr(
        "event_id", "to_json(map('01. symbol', concat('q', user_id), '05. price', string(value), '10. change percent', concat(string(round(value / 50, 4)), '%'))) AS body")
    m = raw.selectExpr("event_id", "from_json(body, 'map<string,string>') AS m")
    return m.selectExpr("upper(m['01. symbol']) AS ticker", "event_id", "double(m['05. price']) AS price", f"{t.percent_text('m[\"10. change percent\"]')} AS change_percent")


@query("TX9_quote_change", """
SELECT event_id, round(value - k, 4) + 0e0 AS change, round(CASE WHEN k <> 0 THEN (value - k) / k * 100 ELSE 0 END, 6) + 0e0 AS change_percent
FROM (SELECT *, coalesce(json_extract_string(props, '$.k')::DOUBLE, 0) AS k FROM events)""")
def tx9(spark, sf):
    rows = b.table(spark, sf, "events").selectExpr("event_id", "value", "coalesce(double(get_json_object(props, '$.k')), 0D) AS k")
    return rows.selectExpr("event_id", "round(value - k, 4) AS change", f"round({t.quote_change('value', 'k')}, 6) AS change_percent")


@query("SJ8_manifest_diff", """
SELECT coalesce(e.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'untracked' WHEN e.d <> a.d THEN 'mismatch' ELSE 'ok' END AS status
FROM (SELECT 'doc_' || doc_id AS name, sha256(text) AS d FROM documents WHERE source <> 'src0') e
FULL JOIN (SELECT 'doc_' || doc_id AS name, sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS d FROM documents WHERE source <> 'src1') a ON a.name = e.name""")
def sj8(spark, sf):
    docs = b.table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    old = mf.digests(docs.filter("source <> 'src0'"), "concat('doc_', doc_id)", "text")
    new = mf.digests(docs.filter("source <> 'src1'"), "concat('doc_', doc_id)", "if(lang = 'fr', concat(text, '!'), text)")
    return mf.manifest_diff(old, new).select("name", "status")
