"""File, sink, ledger and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import bridge as b
from holdfast.catalog.audit import reports
from holdfast.catalog.core import big, plans, rnd
from holdfast.catalog.markets import returns
from holdfast.catalog.registry import query, view
from holdfast.catalog.text import records, replies
from holdfast.functions import fees as fee
from holdfast.functions import money
from holdfast.functions import scoring
from holdfast.grouping import cut_lineage, reuse, shared_folder
from holdfast.operators import ledger
from holdfast.operators import manifests as mf
from holdfast.operators import valuation as v
from holdfast.sources import broker, documents, files, matrix, sinks, snapshots
from holdfast.streaming import jobs, stateful


def raw_broker(spark, sf):
    """Broker-style text rows: thousands commas, dollar signs, blanks and bad numbers."""
    return b.positions(spark, sf).selectExpr(
        "portfolio_id", "if(int(substr(ticker, 2)) % 50 = 0, ' ', concat(' ', lower(ticker))) AS Symbol", "name AS Description",
        "if(int(substr(ticker, 2)) % 41 = 0, 'n/a', concat(string(int(shares)), ',000')) AS `Total Quantity`", "'1' AS `Available Quantity`",
        "if(shares > 40, NULL, concat('$', format_number(cost, 4))) AS `Avg Price`", "if(shares > 30, '', string(price)) AS Price")


@query("IO1_broker_ingest", """
SELECT portfolio_id, ticker, shares * 1000 AS shares, CASE WHEN s > 40 THEN 0 ELSE cost END AS cost, CASE WHEN s > 30 THEN CASE WHEN s > 40 THEN 0 ELSE cost END ELSE price END AS price,
  CASE WHEN substr(ticker, 2)::INTEGER % 41 = 0 THEN 'invalid value' END AS reject
FROM (SELECT portfolio_id, ticker, CASE WHEN substr(ticker, 2)::INTEGER % 41 = 0 THEN NULL ELSE shares END AS shares, cost, price, shares AS s FROM positions WHERE substr(ticker, 2)::INTEGER % 50 <> 0) t""", ("positions",))
def io1(spark, sf):
    folder = shared_folder(spark)
    raw_broker(spark, sf).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    rows = broker.read_broker_csv(spark, folder, ("portfolio_id",))
    return rows.selectExpr("bigint(portfolio_id) AS portfolio_id", "ticker", "double(shares) AS shares", "double(cost) AS cost", "double(price) AS price", "reject")


@query("IO2_upload_gate", """
SELECT portfolio_id AS source_file, count(*) AS positions, count(*) FILTER (WHERE substr(ticker, 2)::INTEGER % 41 = 0) AS rejects,
  count(*) FILTER (WHERE substr(ticker, 2)::INTEGER % 41 = 0) = 0 AS accepted,
  CASE WHEN count(*) FILTER (WHERE substr(ticker, 2)::INTEGER % 41 = 0) = 0 THEN count(*) ELSE 0 END AS landed FROM positions WHERE substr(ticker, 2)::INTEGER % 50 <> 0 GROUP BY 1""", ("positions",))
def io2(spark, sf):
    rows = broker.normalize_rows(raw_broker(spark, sf).withColumnRenamed("portfolio_id", "source_file"), ("source_file",))
    folder = shared_folder(spark)
    broker.land_uploads(rows, folder)
    landed = spark.read.parquet(folder).groupBy("source_file").agg(F.count(F.lit(1)).alias("landed"))
    return broker.passing_files(rows).join(landed, "source_file", "left").na.fill(0, ["landed"])


# Uploads: one file per customer group, order status and year; years are written one after the other in this order.
TURN = "(year(o_orderdate) * 3) % 7"


@query("IO3_newest_source", f"""
SELECT portfolio_id, kind, name, count(*) AS lines, round(sum(o_totalprice), 2) AS volume FROM (
  SELECT *, dense_rank() OVER (PARTITION BY portfolio_id ORDER BY k, turn DESC) AS place FROM (
    SELECT o_custkey % 25 AS portfolio_id, CASE o_orderstatus WHEN 'O' THEN 'inbox' WHEN 'F' THEN 'private' ELSE 'fixture' END AS kind, o_totalprice,
      CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 4 END AS k, CASE WHEN {TURN} = 6 THEN 'manual-portfolio.csv' ELSE 'upload-' || year(o_orderdate) || '.csv' END AS name, {TURN} AS turn FROM orders)
  WHERE name <> 'manual-portfolio.csv') WHERE place = 1 GROUP BY 1, 2, 3""")
def io3(spark, sf):
    """Real files, chosen by the modification time in the folder listing and read back."""
    folder = shared_folder(spark)
    rows = b.table(spark, sf, "orders").selectExpr(
        "o_custkey % 25 AS portfolio_id", "CASE o_orderstatus WHEN 'O' THEN 'inbox' WHEN 'F' THEN 'private' ELSE 'fixture' END AS kind",
        f"if({TURN} = 6, 'manual-portfolio.csv', concat('upload-', year(o_orderdate), '.csv')) AS name", f"{TURN} AS turn", "string(o_orderkey) AS ticker", "o_totalprice AS price")
    for turn in range(7):
        part = rows.filter(f"turn = {turn}").drop("turn").repartition("portfolio_id", "kind")
        part.write.mode("append").partitionBy("portfolio_id", "kind", "name").csv(folder)
    chosen = broker.newest_source(broker.inbox_sources(spark, folder), include_manual=False).selectExpr("bigint(portfolio_id) AS portfolio_id", "kind", "name")
    held = spark.read.schema("ticker STRING, price DOUBLE, portfolio_id BIGINT, kind STRING, name STRING").csv(folder)
    return held.join(chosen, ["portfolio_id", "kind", "name"]).groupBy("portfolio_id", "kind", "name").agg(
        F.expr("count(*) AS lines"), F.expr("round(sum(price), 2) AS volume"))


BRANDS = [f"Brand#{i}" for i in range(1, 26)]
WIDE = ", ".join(f"max(CASE WHEN ticker = '{x}' THEN printf('%.10f', ret) END) AS \"{x}\"" for x in sorted(BRANDS))


@query("IO5_return_matrix", f"SELECT study, date, {WIDE} FROM rets GROUP BY 1, 2", ("rets",))
def io5(spark, sf):
    folder = shared_folder(spark)
    matrix.write_matrix(returns(spark, sf), folder)
    return spark.read.csv(folder, header=True).withColumn("date", F.to_date("date"))


@query("IO4_matrix_unpivot", "SELECT study, date, upper(ticker) AS ticker, printf('%.10f', ret)::DOUBLE AS ret FROM rets", ("rets",))
def io4(spark, sf):
    folder = shared_folder(spark)
    matrix.write_matrix(returns(spark, sf), folder)
    return matrix.read_matrix(spark, folder).withColumn("date", F.to_date("date"))


def snapshot_folder(spark, sf):
    folder = shared_folder(spark)
    scored = b.fundamentals(spark, sf)
    snapshots.record_snapshot(scored.withColumn("live_price", F.lit(1.0)), b.fx_rates(spark, sf), "20240101_000000", folder)
    snapshots.record_snapshot(scored, b.fx_rates(spark, sf), "20240201_000000", folder)
    return folder


@query("IO6_snapshot_write", """
SELECT c.captured_utc, count(*) AS tickers, (SELECT count(*) FROM fx WHERE base IN (SELECT financial_currency FROM scalars WHERE financial_currency <> trading_currency)) AS fx_pairs
FROM scalars, (VALUES ('20240101_000000'), ('20240201_000000')) c(captured_utc) GROUP BY 1""", ("scalars", "fx"))
def io6(spark, sf):
    folder = snapshot_folder(spark, sf)
    count = lambda part, name: spark.read.parquet(f"{folder}/{part}").groupBy(F.expr("string(captured_utc) AS captured_utc")).agg(F.count(F.lit(1)).alias(name))
    return count("fundamentals", "tickers").join(count("fx", "fx_pairs"), "captured_utc")


@query("IO7_snapshot_replay", "SELECT ticker, '20240201_000000' AS captured_utc, round(live_price, 6) AS live_price FROM scalars", ("scalars",))
def io7(spark, sf):
    rows, _ = snapshots.load_snapshot(spark, snapshot_folder(spark, sf))
    return rows.select("ticker", "captured_utc", rnd("live_price"))


@query("UD2_snapshot_provider", "SELECT ticker, round(composite_score, 6) AS composite_score, moat_class FROM scored", ("scored",))
def ud2(spark, sf):
    """A replayed snapshot in place of the live fundamentals and rates."""
    rows, fx = snapshots.load_snapshot(spark, snapshot_folder(spark, sf))
    scored = scoring.score_fundamentals(scoring.with_fx_rate(rows.drop("captured_utc"), fx.drop("captured_utc")))
    return scored.select("ticker", rnd("composite_score"), "moat_class")


@query("UD4_injected_quotes", """
SELECT p.portfolio_id, p.ticker, round(s.live_price, 4) AS price, round(p.shares::DECIMAL(14, 4) * round(s.live_price, 4)::DECIMAL(16, 4), 2)::DOUBLE AS market_value,
  CASE WHEN bool_or(s.ticker IS NOT NULL) OVER (PARTITION BY p.portfolio_id) THEN 'live' ELSE 'stored' END AS price_source
FROM positions p JOIN scalars s USING (ticker)""", ("positions", "scalars"))
def ud4(spark, sf):
    """Any table of quotes serves as the lookup; here the fundamentals' prices."""
    quotes = b.fundamentals(spark, sf).selectExpr("ticker", "live_price AS price", "cast(NULL AS double) AS change_percent")
    return v.value_positions(v.overlay_quotes(b.positions(spark, sf), quotes)).select(
        "portfolio_id", "ticker", rnd("price", 4), rnd("market_value", 2), "price_source")


def suites(spark, sf):
    """One suite document per scenario, with its runs nested by advisor (bounded per order)."""
    scen = b.scenarios(spark, sf)
    runs = b.runs(spark, sf).selectExpr("scenario AS s", "run_id", "advisor", "tickers", "amounts", "cited_fact_ids")
    return runs.join(scen, F.expr("s = scenario")).selectExpr(
        "to_json(struct('1' AS version, array(struct(scenario AS name, category, cash, allowed_tickers, owned_tickers, "
        "if(add_only, NULL, policy_tickers) AS policy_tickers, if(add_only, NULL, add_only) AS add_only, "
        "map(advisor, array(struct(string(run_id) AS run_id, tickers, if(size(amounts) = 0, NULL, amounts) AS amounts))) AS recommendations)) AS scenarios)) AS value")


@query("IO8_scenario_suite", """
SELECT r.scenario, r.advisor, r.run_id::VARCHAR AS run_id, l.n AS n_tickers, CASE WHEN r.has_amounts THEN l.n ELSE 0 END AS n_amounts, s.add_only, 3::BIGINT AS max_recommendations,
  CASE WHEN s.add_only THEN 0 ELSE s.policy_size END AS n_policy
FROM runs r JOIN scenarios s USING (scenario) JOIN (SELECT run_id, count(*) AS n FROM legs GROUP BY 1) l ON l.run_id = r.run_id""", ("runs", "scenarios", "legs"))
def io8(spark, sf):
    """Suites are written as files, one document a line, and read back."""
    folder = shared_folder(spark)
    suites(spark, sf).write.text(folder)
    scen, runs = documents.read_suite(spark, folder, lines=True)
    limits = scen.selectExpr("scenario", "add_only", "bigint(max_recommendations) AS max_recommendations", "bigint(size(policy_tickers)) AS n_policy").distinct()
    return runs.selectExpr("scenario", "advisor", "run_id", "bigint(size(tickers)) AS n_tickers", "bigint(size(amounts)) AS n_amounts").join(limits, "scenario")


@query("IO9_run_record_tree", """
SELECT provider, arm, scenario, run_index::BIGINT AS run_index, count(*) AS records, count(*) FILTER (WHERE n % 50 <> 0) AS consistent FROM (
  SELECT 'p' || run_id % 2 AS provider, arm, 'bank_' || hash_of AS scenario, run AS run_index, run_id AS n FROM (SELECT *, substr(scenario, 5)::BIGINT % 20 AS hash_of FROM records)) GROUP BY ALL""", ("records",))
def io9(spark, sf):
    """A tree of provider, model, arm and scenario__runN.json; every fiftieth record says another model than its path."""
    folder = shared_folder(spark)
    rows = records(spark, sf).selectExpr(
        "concat('p', run_id % 2) AS provider", "if(run_id % 50 = 0, 'other', 'model-1') AS model", "arm", "concat('bank_', bigint(substr(scenario, 5)) % 20) AS scenario",
        "run AS run_index", "status", "truncated", "attempts")
    doc = "to_json(struct(provider, model, arm, scenario, run_index, status, truncated, attempts)) AS value"
    placed = rows.selectExpr("provider", "'model-1' AS model", "arm", "concat(scenario, '__run', run_index, '.json') AS file", doc)
    placed.repartition("provider", "arm", "file").write.partitionBy("provider", "model", "arm", "file").text(folder)
    read = documents.read_run_records(spark, folder, lines=True)
    same = " AND ".join(f"path_{x} = {y}" for x, y in (("provider", "provider"), ("model", "model"), ("arm", "arm"), ("scenario", "scenario"), ("run", "run_index")))
    return read.groupBy("provider", "arm", "scenario", F.expr("bigint(run_index) AS run_index")).agg(
        F.expr("count(*) AS records"), F.expr(f"count_if({same}) AS consistent"))


def payloads(spark, sf):
    entry = ("named_struct('end', string(period_end), 'val', if(accession % 9 = 0, NULL, value), 'filed', string(filed), 'form', form, "
             "'fy', fiscal_year, 'fp', if(accession % 2 = 0, 'FY', ''), 'accn', string(accession))")
    return b.facts(spark, sf).selectExpr(
        "entity", f"to_json(named_struct('facts', map('us-gaap', map(tag, named_struct('units', map('USD', array({entry}))))))) AS payload")


@query("IO10_company_facts", """
SELECT entity, 'us-gaap' AS taxonomy, tag, 'USD' AS unit, value, period_end, filed, form, fiscal_year::BIGINT AS fiscal_year,
  CASE WHEN accession % 2 = 0 THEN 'FY' END AS fiscal_period, accession::VARCHAR AS accession FROM facts WHERE accession % 9 <> 0""", ("facts",))
def io10(spark, sf):
    rows = documents.company_facts(payloads(spark, sf))
    return rows.select("entity", "taxonomy", "tag", "unit", "value", "period_end", "filed", "form", big("fiscal_year"), "fiscal_period", "accession")


@query("IO11_statement_series", """
SELECT 'P' || l_partkey AS ticker, string_agg(printf('%.4f', round(e, 4)), '|' ORDER BY fiscal_year) FILTER (WHERE e IS NOT NULL) AS ebit,
  string_agg(printf('%.4f', round(t, 4)), '|' ORDER BY fiscal_year) FILTER (WHERE t IS NOT NULL) AS tax, string_agg(printf('%.4f', round(c, 4)), '|' ORDER BY fiscal_year) FILTER (WHERE c IS NOT NULL) AS capital
FROM (SELECT *, coalesce(CASE WHEN line_count > 3 THEN ebit END, CASE WHEN line_count > 1 THEN operating_income END) AS e, tax_rate * 1000 / nullif(diluted_shares, 0) AS t,
   coalesce(CASE WHEN line_count > 4 THEN invested_capital END, CASE WHEN revenue + fcf - 40000 > 0 THEN revenue + fcf - 40000 END) AS c FROM statements) GROUP BY 1""", ("statements",))
def io11(spark, sf):
    rows = b.statements(spark, sf).selectExpr("*", "concat('P', l_partkey) AS ticker", "if(line_count > 3, ebit, NULL) AS e1", "if(line_count > 1, operating_income, NULL) AS e2",
                                              "tax_rate * 1000 AS tax", "if(line_count > 4, invested_capital, NULL) AS explicit", "40000D AS cash_held")
    keys = b.statements(spark, sf).selectExpr("concat('P', l_partkey) AS ticker").distinct()
    parts = [documents.field_series(rows, "ticker", "fiscal_year", "ebit", "e1", "e2"),
             documents.tax_rate_series(rows, "ticker", "fiscal_year", "diluted_shares", "tax").withColumnRenamed("tax_rate_series", "tax"),
             documents.invested_capital_series(rows, "ticker", "fiscal_year", "explicit", "revenue", "fcf", "cash_held").withColumnRenamed("invested_capital_series", "capital")]
    for p in parts:
        keys = keys.join(p, "ticker", "left")
    show = lambda c, d: f"array_join(transform({c}, x -> format_string('%.{d}f', {money.half_away('x', d)})), '|') AS {c}"
    return keys.selectExpr("ticker", show("ebit", 4), show("tax", 4), show("capital", 4))


@query("IO12_metric_matrix", """
SELECT 'P' || l_partkey AS ticker, string_agg(printf('%.2f', round(CASE WHEN l_partkey % 3 = 0 THEN operating_income ELSE revenue END, 2)), '|' ORDER BY fiscal_year) AS series FROM statements GROUP BY 1""", ("statements",))
def io12(spark, sf):
    rows = b.statements(spark, sf).selectExpr("concat('P', l_partkey) AS ticker", "l_partkey % 3 = 0 AS odd", "fiscal_year", "revenue", "operating_income")
    cells = rows.selectExpr("ticker", "fiscal_year", "inline(array(struct(if(odd, 'Other Revenue', 'Total Revenue') AS label, revenue AS v), struct('Operating Revenue' AS label, operating_income AS v)))")
    wide = cells.groupBy("ticker", "label").pivot("fiscal_year").agg(F.first("v"))
    t = documents.matrix_series(wide, "ticker", ("Total Revenue", "Operating Revenue"), "series")
    return t.selectExpr("ticker", f"array_join(transform(series, x -> format_string('%.2f', {money.half_away('x', 2)})), '|') AS series")


@query("IO13_metric_payload", """
SELECT 'P' || p_partkey AS ticker, p_retailprice AS live_price, round(coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size END, p_size + 1) / 100e0, 6) AS return_on_equity,
  CASE WHEN p_size % 4 = 0 THEN p_size + 2e0 ELSE p_size END::DOUBLE AS forward_pe, round(1e0 / p_size, 6) AS free_cash_flow,
  round(100 / pow(1 + p_size / 100e0, 5), 6) AS oldest_revenue FROM part""")
def io13(spark, sf):
    raw = b.table(spark, sf, "part").selectExpr(
        "concat('P', p_partkey) AS ticker", "string(p_retailprice) AS price",
        "to_json(map('roeTTM', if(p_size % 3 <> 0, string(p_size), 'n/a'), 'roe5Y', string(p_size + 1), 'forwardPE', if(p_size % 4 = 0, '0', string(p_size)), "
        "'peTTM', string(p_size + 2), 'pfcfShareTTM', string(p_size), 'revenueGrowth5Y', string(p_size))) AS metric")
    return documents.metric_fundamentals(raw).selectExpr("ticker", "live_price", "round(return_on_equity, 6) AS return_on_equity", "forward_pe",
                                                         "round(free_cash_flow, 6) AS free_cash_flow", "round(revenue_series[0], 6) AS oldest_revenue")


@query("IO14_holdings_export", "SELECT portfolio_id, ticker, replace(name || ',' || theme, ',', ' ') AS name, shares, round(cost, 4) AS cost_basis_per_share, price AS current_price FROM positions", ("positions",))
def io14(spark, sf):
    rows = b.positions(spark, sf).withColumn("name", F.concat_ws(",", "name", "theme"))
    keyed = rows.withColumn("ticker", F.concat_ws("|", "portfolio_id", "ticker"))
    folder = shared_folder(spark)
    broker.write_holdings_csv(keyed, folder)
    out = spark.read.csv(folder, header=True)
    return out.selectExpr("bigint(split_part(ticker, '|', 1)) AS portfolio_id", "split_part(ticker, '|', 2) AS ticker", "name", "double(shares) AS shares",
                          "round(double(cost_basis_per_share), 4) AS cost_basis_per_share", "double(current_price) AS current_price")


@query("IO15_report_payload", """
SELECT '{"ticker":"' || s.ticker || '","composite_score":' || round(composite_score, 4) || ',"moat_points":' || round(moat_points, 4) || ',"diluted_shares_series":[' || e.xs || ']}' AS report
FROM scored s JOIN (SELECT 'P' || l_partkey AS ticker, string_agg(diluted_shares::VARCHAR, ',' ORDER BY fiscal_year) AS xs FROM statements GROUP BY 1) e USING (ticker)""", ("scored", "statements"))
def io15(spark, sf):
    folder = shared_folder(spark)
    sinks.write_report(b.scored_tickers(spark, sf).select("ticker", "composite_score", "moat_points", "diluted_shares_series"), folder, 4)
    return spark.read.text(folder).withColumnRenamed("value", "report")


@query("IO16_decision_log", """
SELECT portfolio_id, 'policy-1' AS policy_version, round(cash, 2) AS cash, orders::BIGINT AS order_count, round(deployed, 2) AS total_order_amount FROM deploy_plans""", ("deploy_plans",))
def io16(spark, sf):
    folder = shared_folder(spark)
    sinks.append_decisions(sinks.decision_log(plans(spark, sf), "policy-1", "bridge", "offline"), folder)
    log = spark.read.parquet(folder)
    return log.selectExpr("portfolio_id", "policy_version", "double(cash) AS cash", "bigint(order_count) AS order_count", "double(total_order_amount) AS total_order_amount")


@query("TK4_latest_decisions", "SELECT portfolio_id, round(cash, 2) AS cash FROM portfolios ORDER BY portfolio_id % 7 DESC, portfolio_id LIMIT 10", ("portfolios",))
def tk4(spark, sf):
    log = sinks.decision_log(plans(spark, sf), "policy-1", "bridge", "offline").withColumn("created_at", F.expr("portfolio_id % 7"))
    return sinks.latest_decisions(log, 10).selectExpr("portfolio_id", "double(cash) AS cash")


@query("IO17_quote_rows", "SELECT ticker, price, round(change_percent, 4) AS change_percent, recorded_at FROM quotes", ("quotes",))
def io17(spark, sf):
    lower = b.quotes(spark, sf).withColumn("ticker", F.lower("ticker"))
    folder = shared_folder(spark)
    sinks.append_quotes(lower, folder)
    return spark.read.parquet(folder).selectExpr("ticker", "double(price) AS price", "double(change_percent) AS change_percent", "recorded_at")


def audit_folder(spark, sf):
    folder = shared_folder(spark)
    sinks.write_audit(reports(spark, sf), mf.collection_manifest(records(spark, sf), ["arm"]), folder)
    return folder


@query("IO18_audit_summary", "SELECT scenario, advisor, runs, valid_runs FROM reports", ("reports",))
def io18(spark, sf):
    return spark.read.json(f"{audit_folder(spark, sf)}/audit_summary").selectExpr("scenario", "advisor", "runs", "valid_runs")


@query("IO18_run_manifest", """
SELECT arm, count(*) AS records, count(*) FILTER (WHERE truncated) AS truncated_runs, sum(coalesce(attempts, 1) - 1)::BIGINT AS retries,
  round(sum(latency_seconds), 3) AS total_latency_seconds FROM records WHERE status = 'collected' GROUP BY 1""", ("records",))
def io18m(spark, sf):
    return spark.read.json(f"{audit_folder(spark, sf)}/run_manifest")


def shelved(rows, folder):
    """Texts as files of 200 documents, by ascending doc_id."""
    rows.repartition("shelf").sortWithinPartitions("shelf", "doc_id").select("shelf", "text").write.mode("append").partitionBy("shelf").text(folder)


@query("IO19_digest_manifest", """
WITH shelf AS (SELECT doc_id // 200 AS shelf, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS digest,
                 sha256(string_agg(coalesce(text, '') || '!' || chr(10), '' ORDER BY doc_id)) AS altered FROM documents GROUP BY 1)
SELECT 'shelf=' || shelf AS name, digest AS expected, CASE WHEN shelf % 5 = 1 THEN altered WHEN shelf % 5 <> 0 THEN digest END AS actual,
  CASE shelf % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'mismatch' ELSE 'ok' END AS status FROM shelf
UNION ALL SELECT 'shelf=' || shelf + 1000000, NULL, digest, 'untracked' FROM shelf WHERE shelf % 5 = 2""")
def io19(spark, sf):
    """Files are hashed and listed; a later tree lacks some of them, has changed ones and new ones."""
    folder, name = shared_folder(spark), "substring_index(relative, '/', 1)"
    rows = b.table(spark, sf, "documents", "doc_id", "text").withColumn("shelf", F.expr("doc_id div 200"))
    shelved(rows, f"{folder}/before")
    files.write_manifest(files.file_digests(spark, f"{folder}/before", "*.txt", name), f"{folder}/manifest")
    later = rows.filter("shelf % 5 <> 0").withColumn("text", F.expr("if(shelf % 5 = 1, concat(coalesce(text, ''), '!'), text)"))
    shelved(later, f"{folder}/after")
    shelved(rows.filter("shelf % 5 = 2").withColumn("shelf", F.expr("shelf + 1000000")), f"{folder}/after")
    return files.verify_tree(spark, f"{folder}/after", f"{folder}/manifest", "*.txt", name).select("name", "expected", "actual", "status")


# --- ledger and streams ---
view("ordered_trades", """
SELECT portfolio_id, ticker, transaction_type AS side, shares, price_per_share AS price, row_number() OVER (PARTITION BY portfolio_id, ticker ORDER BY executed_at, trade_ref) AS step FROM transactions""", ("transactions",))


@query("SS2_position_ledger", """
SELECT portfolio_id, ticker, held AS shares, round(cost, 8) AS average_cost, ok AS accepted, bad AS rejected FROM (
WITH RECURSIVE fold AS (
  SELECT DISTINCT portfolio_id, ticker, 0::BIGINT AS step, 0e0 AS held, 0e0 AS cost, 0::BIGINT AS ok, 0::BIGINT AS bad FROM ordered_trades
  UNION ALL
  SELECT f.portfolio_id, f.ticker, t.step, CASE WHEN side = 'BUY' THEN held + shares WHEN shares <= held THEN held - shares ELSE held END,
    CASE WHEN side = 'BUY' THEN (held * cost + shares * price) / (held + shares) WHEN shares = held THEN 0 ELSE cost END,
    ok + CASE WHEN side = 'BUY' OR shares <= held THEN 1 ELSE 0 END, bad + CASE WHEN side = 'BUY' OR shares <= held THEN 0 ELSE 1 END
  FROM fold f JOIN ordered_trades t ON t.portfolio_id = f.portfolio_id AND t.ticker = f.ticker AND t.step = f.step + 1)
SELECT *, row_number() OVER (PARTITION BY portfolio_id, ticker ORDER BY step DESC) AS newest FROM fold) WHERE newest = 1""", ("ordered_trades",))
def ss2(spark, sf):
    return ledger.positions_from_trades(b.transactions(spark, sf)).select("portfolio_id", "ticker", "shares", rnd("average_cost", 8), "accepted", "rejected")


CASH_LEDGER = """
SELECT portfolio_id, trade_ref, accepted, round(cash, 2) AS cash_after FROM (
WITH RECURSIVE ordered AS (
  SELECT portfolio_id, trade_ref, ticker, transaction_type AS side, shares, price_per_share AS price, shares * price_per_share AS gross, fees, cash * 100 AS opening,
    row_number() OVER (PARTITION BY portfolio_id ORDER BY executed_at, trade_ref) AS step FROM transactions JOIN portfolios USING (portfolio_id)),
fold AS (
  SELECT DISTINCT portfolio_id, 0::BIGINT AS step, NULL::VARCHAR AS trade_ref, NULL::BOOLEAN AS accepted, opening AS cash, MAP {}::MAP(VARCHAR, DOUBLE) AS book FROM ordered
  UNION ALL
  SELECT portfolio_id, step, trade_ref, ok, CASE WHEN NOT ok THEN cash WHEN side = 'BUY' THEN cash - (gross + fees) ELSE cash + (gross - fees) END,
    CASE WHEN ok THEN map_concat(book, MAP {ticker: held + CASE WHEN side = 'BUY' THEN shares ELSE -shares END}) ELSE book END
  FROM (SELECT *, CASE WHEN shares <= 0 OR price <= 0 THEN false WHEN side = 'BUY' THEN cash >= gross + fees ELSE shares <= held AND fees <= gross END AS ok
    FROM (SELECT t.*, f.cash, f.book, coalesce(f.book[t.ticker], 0) AS held FROM fold f JOIN ordered t ON t.portfolio_id = f.portfolio_id AND t.step = f.step + 1)))
SELECT * FROM fold WHERE step > 0)"""


@query("SS2_cash_ledger", CASH_LEDGER, ("transactions", "portfolios"))
def ss2c(spark, sf):
    opening = b.portfolios(spark, sf).selectExpr("portfolio_id", "cash * 100 AS cash")
    return ledger.cash_checked_trades(b.transactions(spark, sf), opening, True).select("portfolio_id", "trade_ref", "accepted", rnd("cash_after", 2))


@query("SS2_ledger_stream", CASH_LEDGER, ("transactions", "portfolios"))
def ss2s(spark, sf):
    """Trades arrive in three deliveries, each up to three days late, and are still judged in order."""
    folder = _work(spark, "ledger")
    opening = b.portfolios(spark, sf).selectExpr("portfolio_id", "cash * 100 AS cash")
    trades = b.transactions(spark, sf).withColumn("executed_at", F.col("executed_at").cast("timestamp"))
    trades = trades.withColumn("arrives", F.expr("datediff(executed_at, DATE'1970-01-01') + pmod(xxhash64(trade_ref), 4)"))
    trades = reuse(trades)
    first, last, newest = trades.agg(F.min("arrives"), F.max("arrives"), F.max("executed_at").cast("string")).head()
    schema = trades.drop("arrives").schema
    late = 0
    for turn in range(4):  # the last delivery is a mark that lets the trades still waiting go
        if turn < 3:
            part = trades.filter(f"(arrives - {first}) * 3 div {last - first + 1} = {turn}").drop("arrives")
            part.write.parquet(f"{folder}/in/delivery{turn}")
        jobs.write_mark(spark, schema, f"{folder}/marks", "executed_at", f"{int(newest[:4]) + 1}-12-31" if turn == 3 else None)
        arrived = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        late += stateful.run_cash_ledger(jobs.with_marks(arrived, f"{folder}/marks"), opening, f"{folder}/out", f"{folder}/checkpoint", "5 days", True)
    trades.unpersist()
    judged = spark.read.schema(stateful.VERDICT).option("recursiveFileLookup", True).parquet(f"{folder}/out")
    return judged.filter(f"{late} = 0").select("portfolio_id", "trade_ref", "accepted", rnd("cash_after", 2))


@query("SS4_daily_trades", """
SELECT portfolio_id, date_trunc('day', executed_at)::TIMESTAMP AS day, sum(fees)::DOUBLE AS fees, round(sum(total_amount), 2) AS volume, count(*) AS trades FROM transactions GROUP BY 1, 2""", ("transactions",))
def ss4(spark, sf):
    return jobs.daily_trades(b.transactions(spark, sf)).select("portfolio_id", "day", "fees", rnd("volume", 2), "trades")


def _work(spark, name):
    return f"{shared_folder(spark)}/{name}"


def quote_stream(spark, sf):
    raw = jobs.file_stream(spark, sf, "events.parquet", b.SCHEMAS["events"].replace("TIMESTAMP_NTZ", "TIMESTAMP"))
    return raw.selectExpr("concat('Q', user_id) AS ticker", "value AS price", "if(event_type <> 'error', value / 100, NULL) AS change_percent", "ts AS recorded_at", "event_id AS quote_id")


@query("SS1_quote_cache_stream", """
SELECT ticker, price, change_percent, quote_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY recorded_at DESC, quote_id DESC) AS rn FROM quotes)
WHERE rn = 1 AND recorded_at >= (SELECT max(recorded_at) FROM quotes) - INTERVAL 12 HOUR""", ("quotes",))
def ss1(spark, sf):
    folder = _work(spark, "quotes")
    stateful.run_quote_cache(quote_stream(spark, sf), f"{folder}/out", f"{folder}/checkpoint", max_age_minutes=720)
    return stateful.cached_quotes(spark, f"{folder}/out").select("ticker", "price", "change_percent", "quote_id")


@query("SS3_record_audit_stream", """
SELECT arm, count(*) AS runs, count(*) FILTER (WHERE valid AND run_id % 7 <> 0) AS valid, count(*) FILTER (WHERE run_id % 7 = 0) AS unparsed FROM verdicts GROUP BY 1""", ("verdicts",))
def ss3(spark, sf):
    folder, legs = _work(spark, "runs"), cut_lineage(b.order_legs(spark, sf))
    replies(spark, sf, legs).selectExpr("concat('provider', run_id % 2) AS provider", "'model' AS model", "scenario", "run_id", "arm", "raw_response", "timestamp'2024-01-01 00:00:00' AS arrived_at").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("provider STRING, model STRING, scenario STRING, run_id BIGINT, arm STRING, raw_response STRING, arrived_at TIMESTAMP").parquet(f"{folder}/in")
    jobs.run_record_audit(stream, b.scenarios(spark, sf, legs), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("arm").agg(F.expr("sum(runs) AS runs"), F.expr("sum(valid) AS valid"), F.expr("sum(unparsed) AS unparsed"))


@query("SS4_daily_trade_stream", """
SELECT l_suppkey AS supplier_id, date_trunc('day', l_shipdate)::TIMESTAMP AS day, sum(ceil(l_extendedprice / 1000) * 2.5)::DOUBLE AS fees, round(sum(l_extendedprice), 2) AS volume, count(*) AS trades, 0::BIGINT AS late_rows
FROM lineitem GROUP BY 1, 2""")
def ss4s(spark, sf):
    """Every day comes from the stream: a mark after the last trade closes the days that are still open."""
    folder = _work(spark, "trades")
    raw = jobs.file_stream(spark, sf, "lineitem.parquet", b.SCHEMAS["lineitem"].replace("TIMESTAMP_NTZ", "TIMESTAMP"))
    trades = raw.selectExpr("l_suppkey AS portfolio_id", "l_extendedprice AS total_amount", f"{fee.order_fee('l_extendedprice')} AS fees", "l_shipdate AS executed_at")
    last = b.table(spark, sf, "lineitem").agg(F.expr("string(max(l_shipdate) + interval 30 days)")).head()[0]
    late = 0
    for at in (None, last):
        jobs.write_mark(spark, trades.schema, f"{folder}/marks", "executed_at", at)
        late += jobs.run_daily_trades(jobs.with_marks(trades, f"{folder}/marks"), f"{folder}/out", f"{folder}/checkpoint")
    closed = spark.read.schema("portfolio_id BIGINT, day TIMESTAMP, fees DOUBLE, volume DOUBLE, trades BIGINT").parquet(f"{folder}/out")
    return closed.selectExpr("portfolio_id AS supplier_id", "cast(day AS timestamp_ntz) AS day", "fees", "round(volume, 2) AS volume", "trades", f"{late}L AS late_rows")
