"""Valuation, weights, scoring and deployment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import bridge as b
from holdfast.catalog.registry import _VIEWS, query, view, with_views
from holdfast.functions import fees as fee
from holdfast.functions import money
from holdfast.functions import series as s
from holdfast.grouping import ranked_per_group, reuse, top_per_group
from holdfast.operators import valuation as v
from holdfast.plans import deployment as d


def rnd(name, places=6):
    return F.expr(f"round(double({name}), {places}) AS {name}")


def big(name):
    return F.expr(f"bigint({name}) AS {name}")


def analyses(spark, sf, scored=None):
    return v.analyze_holdings(b.positions(spark, sf), b.scored_tickers(spark, sf) if scored is None else scored)


def scored_holdings(spark, sf):
    return v.score_holdings(b.positions(spark, sf), b.scored_tickers(spark, sf))


def weighted(spark, sf):
    return v.with_weights(v.value_positions(b.positions(spark, sf)))


view("valued", """
SELECT *, shares * price AS market_value, shares * cost AS cost_basis, shares * price - shares * cost AS gain,
       CASE WHEN shares * cost > 0 THEN (shares * price - shares * cost) / (shares * cost) * 100 ELSE 0 END AS gain_pct
FROM positions""", ("positions",))
view("weighted", """
SELECT v.*, t.total AS portfolio_value, CASE WHEN t.total > 0 THEN market_value / t.total * 100 ELSE 0 END AS weight_pct
FROM valued v JOIN (SELECT portfolio_id, sum(market_value) AS total FROM valued GROUP BY 1) t USING (portfolio_id)""", ("valued",))


@query("PF1_position_valuation", """
SELECT portfolio_id, ticker, round(market_value, 4) AS market_value, round(cost_basis, 4) AS cost_basis,
       round(gain, 4) + 0e0 AS gain, round(gain_pct, 6) + 0e0 AS gain_pct FROM valued""", ("valued",))
def pf1(spark, sf):
    return v.value_positions(b.positions(spark, sf)).select(
        "portfolio_id", "ticker", rnd("market_value", 4), rnd("cost_basis", 4), rnd("gain", 4), rnd("gain_pct"))


view("part_quotes", """
SELECT 'P' || user_id AS ticker, value AS quote, CASE WHEN event_type <> 'error' THEN value / 100 END AS change_percent
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")


@query("PF2_live_price_overlay", """
SELECT p.portfolio_id, p.ticker, round(coalesce(q.quote, p.price), 4) AS price, round(q.change_percent, 6) AS change_percent,
       CASE WHEN bool_or(q.quote IS NOT NULL) OVER (PARTITION BY p.portfolio_id) THEN 'live' ELSE 'stored' END AS price_source,
       round(p.shares * coalesce(q.quote, p.price), 4) AS market_value
FROM positions p LEFT JOIN part_quotes q USING (ticker)""", ("positions", "part_quotes"))
def pf2(spark, sf):
    latest = top_per_group(b.quotes(spark, sf), ["ticker"],
                           [F.col("recorded_at").desc(), F.col("quote_id").desc()], 1)
    latest = latest.withColumn("ticker", F.regexp_replace("ticker", "^Q", "P"))
    return v.value_positions(v.overlay_quotes(b.positions(spark, sf), latest)).select(
        "portfolio_id", "ticker", rnd("price", 4), rnd("change_percent"), "price_source", rnd("market_value", 4))


@query("PF3_position_weight", "SELECT portfolio_id, ticker, round(weight_pct, 6) AS weight_pct FROM weighted", ("weighted",))
def pf3(spark, sf):
    return weighted(spark, sf).select("portfolio_id", "ticker", rnd("weight_pct"))


@query("PF11_order_fee", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       (CASE WHEN l_extendedprice - 20000 <= 0 THEN 0 ELSE ceil((l_extendedprice - 20000) / 1000) * 2.5 END)::DOUBLE AS fee
FROM lineitem""")
def pf11(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.expr(fee.order_fee("(l_extendedprice - 20000)")).alias("fee"))


@query("PF12_economic_floor", """
SELECT c_custkey, round(2.5e0 / ((1 + c_nationkey % 4) / 100e0), 6) AS floor,
       c_acctbal >= round(2.5e0 / ((1 + c_nationkey % 4) / 100e0), 6) AS can_order FROM customer""")
def pf12(spark, sf):
    floor = F.round(F.expr(fee.economic_floor("2.5D", "((c_nationkey % 4 + 1) / 100D)")), 6)
    return b.table(spark, sf, "customer").select(
        "c_custkey", floor.alias("floor"), (F.col("c_acctbal") >= floor).alias("can_order"))


@query("PF13_currency_guard", """
SELECT portfolio_id, count(DISTINCT ccy) = 1 AS single_currency,
       CASE WHEN count(DISTINCT ccy) = 1 THEN round(sum(market_value), 2) END AS guarded_total
FROM (SELECT v.portfolio_id, v.market_value, coalesce(s.trading_currency, 'N0') AS ccy
      FROM valued v JOIN scalars s USING (ticker)) GROUP BY 1""", ("valued", "scalars"))
def pf13(spark, sf):
    ccy = b.fundamentals(spark, sf).select("ticker", F.coalesce("trading_currency", F.lit("N0")).alias("currency"))
    rows = v.value_positions(b.positions(spark, sf)).join(ccy, "ticker")
    return rows.groupBy("portfolio_id").agg(
        F.expr(money.one_currency("currency")).alias("single_currency"),
        F.expr(money.guarded_sum("market_value", "currency")).alias("guarded_total"),
    ).select("portfolio_id", "single_currency", rnd("guarded_total", 2))


@query("PF13_by_currency", """
SELECT v.portfolio_id, coalesce(s.trading_currency, 'N0') AS currency, round(sum(v.market_value), 2) AS total
FROM valued v JOIN scalars s USING (ticker) GROUP BY 1, 2""", ("valued", "scalars"))
def pf13b(spark, sf):
    ccy = b.fundamentals(spark, sf).select("ticker", F.coalesce("trading_currency", F.lit("N0")).alias("currency"))
    rows = v.value_positions(b.positions(spark, sf)).join(ccy, "ticker")
    return rows.groupBy("portfolio_id", "currency").agg(F.sum("market_value").alias("total")).select(
        "portfolio_id", "currency", rnd("total", 2))


@query("PF14_currency_conversion", """
SELECT portfolio_id, currency, (round(cash::DECIMAL(18, 2) * coalesce(rate, 1)::DECIMAL(9, 2), 8))::DOUBLE AS converted
FROM portfolios LEFT JOIN fx ON base = currency""", ("portfolios", "fx"))
def pf14(spark, sf):
    fx = b.fx_rates(spark, sf).select(F.col("base").alias("currency"), "rate")
    rows = b.portfolios(spark, sf).join(fx, "currency", "left")
    return rows.select("portfolio_id", "currency",
                       F.expr(money.convert("cash", "coalesce(rate, 1D)")).cast("double").alias("converted"))


@query("PF15_money_display", """
SELECT portfolio_id, CASE WHEN portfolio_id % 3 = 0 THEN 'USD' WHEN portfolio_id % 3 = 1 THEN 'BRL' ELSE 'EUR' END AS currency,
       CASE WHEN portfolio_id % 3 = 0 THEN '$' WHEN portfolio_id % 3 = 1 THEN 'R$' ELSE '€' END || ' ' || format('{:,.2f}', cash) AS shown
FROM portfolios""", ("portfolios",))
def pf15(spark, sf):
    rows = b.portfolios(spark, sf).selectExpr("portfolio_id", "cash", "array('USD', 'BRL', 'EUR')[int(portfolio_id % 3)] AS currency")
    return rows.selectExpr("portfolio_id", "currency", f"{money.display('cash', 'currency')} AS shown")


@query("PF16_purchase_eligibility", """
SELECT portfolio_id, ticker, weight_pct <= 100e0 / position_count * 1.3e0 AS eligible FROM analyses""", ("analyses",))
def pf16(spark, sf):
    return analyses(spark, sf).select("portfolio_id", "ticker", d.within_weight_limit().alias("eligible"))


@query("PF17_theme_saturation", """
SELECT portfolio_id, theme, round(sum(weight_pct), 6) AS theme_weight, sum(weight_pct) >= 20 AS saturated
FROM analyses GROUP BY 1, 2""", ("analyses",))
def pf17(spark, sf):
    return v.theme_weights(analyses(spark, sf)).select(
        "portfolio_id", "theme", rnd("theme_weight"), (F.col("theme_weight") >= d.THEME_CAP_PCT).alias("saturated"))


@query("PF20_portfolio_header", """
SELECT portfolio_id, count(*) AS position_count, arg_min(ticker, (-market_value, ticker)) AS largest,
       round(max(CASE WHEN shares > 10 THEN weight_pct ELSE market_value / CASE WHEN portfolio_value = 0 THEN 1 ELSE portfolio_value END * 100 END), 6) AS largest_weight
FROM weighted GROUP BY 1""", ("weighted",))
def pf20(spark, sf):
    c = F.col
    given = F.when(c("shares") > 10, c("weight_pct"))
    whole = F.when(c("portfolio_value") == 0, F.lit(1.0)).otherwise(c("portfolio_value").cast("double"))
    shown = F.coalesce(given, c("market_value").cast("double") / whole * 100)
    return weighted(spark, sf).withColumn("shown", shown).groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("position_count"),
        F.min(F.struct((-v.size_order()).alias("k"), c("ticker"))).alias("top"),
        F.max("shown").alias("largest_weight"),
    ).select("portfolio_id", "position_count", c("top.ticker").alias("largest"), rnd("largest_weight"))


@query("SJ1_theme_lookup", """
SELECT p.portfolio_id, p.ticker, coalesce(d.theme, 'Other') AS theme, coalesce(d.fin, FALSE) AS is_financial
FROM positions p LEFT JOIN (SELECT 'widget' AS kind, 'Theme_W' AS theme, TRUE AS fin UNION ALL SELECT 'ring', 'Theme_R', FALSE) d
  ON split_part(p.name, ' ', 2) = d.kind""", ("positions",))
def sj1(spark, sf):
    kinds = b.table(spark, sf, "part", "p_name").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("ticker")).distinct()
    dimension = kinds.filter(F.col("ticker").isin("widget", "ring")).select(
        "ticker", F.when(F.col("ticker") == "widget", "Theme_W").otherwise("Theme_R").alias("theme"),
        (F.col("ticker") == "widget").alias("is_financial"))
    rows = b.positions(spark, sf).select(
        "portfolio_id", F.col("ticker").alias("held"), F.split_part("name", F.lit(" "), F.lit(2)).alias("ticker"))
    return v.with_theme(rows, dimension).select("portfolio_id", F.col("held").alias("ticker"), "theme", "is_financial")


@query("SJ3_fx_lookup", """
SELECT s.ticker, s.financial_currency, s.trading_currency,
       round(CASE WHEN s.financial_currency <> s.trading_currency THEN f.rate ELSE 1.0 END::DOUBLE, 6) AS fx_rate,
       coalesce(s.financial_currency <> s.trading_currency, FALSE) AND f.rate IS NULL AS fx_missing
FROM scalars s LEFT JOIN fx f ON f.base = s.financial_currency AND f.quote = s.trading_currency""", ("scalars", "fx"))
def sj3(spark, sf):
    from holdfast.functions import scoring
    rows = scoring.with_fx_rate(b.fundamentals(spark, sf), b.fx_rates(spark, sf))
    return rows.select("ticker", "financial_currency", "trading_currency", rnd("fx_rate"), "fx_missing")


@query("SJ3_required_fx_pairs", """
SELECT financial_currency AS base, trading_currency AS quote, count(*) AS tickers FROM scalars
WHERE financial_currency <> trading_currency GROUP BY 1, 2""", ("scalars",))
def sj3b(spark, sf):
    from holdfast.sources.snapshots import required_fx_pairs
    return required_fx_pairs(b.fundamentals(spark, sf))


@query("AG1_portfolio_totals", """
SELECT p.portfolio_id, round(coalesce(t.mv, 0), 2) AS market_value, round(coalesce(t.cb, 0), 4) AS cost_basis,
       round(coalesce(t.mv - t.cb, 0), 4) + 0e0 AS gain, round(CASE WHEN t.cb > 0 THEN (t.mv - t.cb) / t.cb * 100 ELSE 0 END, 6) + 0e0 AS gain_pct,
       round(coalesce(t.mv, 0) + p.cash, 2) AS total_value, coalesce(t.n, 0) AS position_count
FROM portfolios p LEFT JOIN (SELECT portfolio_id, sum(market_value) AS mv, sum(cost_basis) AS cb, count(*) AS n FROM valued GROUP BY 1) t
USING (portfolio_id)""", ("portfolios", "valued"))
def ag1(spark, sf):
    t = v.portfolio_totals(v.value_positions(b.positions(spark, sf)), b.portfolios(spark, sf))
    return t.select("portfolio_id", rnd("market_value", 2), rnd("cost_basis", 4), rnd("gain", 4), rnd("gain_pct"),
                    rnd("total_value", 2), big("position_count"))


@query("AG2_theme_weights", "SELECT portfolio_id, theme, round(sum(weight_pct), 6) AS theme_weight FROM weighted GROUP BY 1, 2", ("weighted",))
def ag2(spark, sf):
    return v.theme_weights(weighted(spark, sf)).select("portfolio_id", "theme", rnd("theme_weight"))


@query("AG3_concentration", """
SELECT portfolio_id, round(sum(weight_pct) FILTER (WHERE rn <= 5), 6) AS top_weight,
       arg_min(ticker, (-market_value, ticker)) AS largest, arg_min(ticker, (market_value, ticker)) AS smallest
FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY market_value DESC, ticker) AS rn FROM weighted) GROUP BY 1""", ("weighted",))
def ag3(spark, sf):
    return v.concentration(weighted(spark, sf)).select("portfolio_id", rnd("top_weight"), "largest", "smallest")


SCORE_COLS = ["roic", "roe", "margin_cv", "revenue_cagr", "eps_cagr", "fcf_cagr", "shares_change", "fcf_yield", "peg",
              "moat_points", "compounding_points", "valuation_points", "composite_score"]


def _scored(name, cols, extra=()):
    sql = "SELECT ticker, " + ", ".join([f"round({c}, 6) + 0e0 AS {c}" for c in cols] + list(extra)) + " FROM scored"

    def run(spark, sf):
        return b.scored_tickers(spark, sf).select("ticker", *[rnd(c) for c in cols], *extra)

    query(name, sql, ("scored",))(run)


_scored("SC2_series_cagr", ["revenue_cagr", "eps_cagr", "fcf_cagr"])
_scored("SC3_margin_variation", ["margin_cv"])
_scored("SC4_roic_history", ["roic"])
_scored("SC6_fraction_at_least", ["pricing_power"])
_scored("SC7_share_change", ["shares_change"])
_scored("SC8_peg", ["peg"])
_scored("SC9_fcf_yield", ["fcf_yield"])
_scored("SC10_moat_class", ["roic", "roe"], ("moat_class",))
_scored("SC11_compounding_class", ["fcf_cagr", "eps_cagr"], ("compounding_class",))
_scored("SC12_moat_points", ["moat_points"])
_scored("SC13_compounding_points", ["compounding_points"])
_scored("SC14_valuation_points", ["valuation_points"])


@query("SC1_clamp", "SELECT l_partkey, fiscal_year, round(least(100, greatest(0, (revenue - 100000) / 1000)), 6) AS clamped FROM statements", ("statements",))
def sc1(spark, sf):
    return b.statements(spark, sf).select("l_partkey", "fiscal_year", F.round(F.expr(s.clamp("(revenue - 100000) / 1000")), 6).alias("clamped"))


@query("SC5_margin_series", """
SELECT 'P' || l_partkey AS ticker, age::BIGINT AS age, round(operating_income / revenue, 6) AS margin FROM aligned_years""", ("aligned_years",))
def sc5(spark, sf):
    f = b.fundamentals(spark, sf)
    rows = f.select("ticker", F.posexplode(F.expr(s.margin_history("revenue_series", "operating_income_series"))).alias("i", "margin"))
    return rows.select("ticker", (F.col("i") + 1).cast("long").alias("age"), rnd("margin"))


@query("SC15_position_analysis", "SELECT portfolio_id, ticker, " + ", ".join(
    f"round({c}, 6) + 0e0 AS {c}" for c in ["market_value", "weight_pct", "pnl_pct", "price_gap_pct", *SCORE_COLS])
    + ", moat_class, compounding_class FROM analyses", ("analyses",))
def sc15(spark, sf):
    """Portfolio values are joined to the holdings while those are narrow."""
    scored = b.scored_tickers(spark, sf)
    valued = b.holdings(spark, sf).join(v.portfolio_values(b.positions(spark, sf), scored), "portfolio_id")
    return v.analyze_holdings(b.positions(spark, sf, valued), scored).select(
        "portfolio_id", "ticker", *[rnd(c) for c in ["market_value", "weight_pct", "pnl_pct", "price_gap_pct", *SCORE_COLS]],
        "moat_class", "compounding_class")


@query("SC16_implied_series", """
SELECT ticker, step::BIGINT AS step, round(live_price / pow(1 + coalesce(revenue_cagr, 0), 5 - step), 6) AS value,
       round(100 - step * 0.4, 6)::DOUBLE AS steady_shares
FROM scored, range(6) r(step) WHERE live_price > 0 AND coalesce(revenue_cagr, 0) > -0.95""", ("scored",))
def sc16(spark, sf):
    rows = b.scored_tickers(spark, sf).selectExpr(
        "ticker", f"{s.implied_series('revenue_cagr', 'live_price')} AS v", f"{s.steady_share_series()} AS h")
    return rows.selectExpr("ticker", "h", "posexplode(v) AS (step, value)").selectExpr(
        "ticker", "bigint(step) AS step", "round(value, 6) AS value", "round(h[step], 6) AS steady_shares")


@query("SC17_percent_metric", """
SELECT p_partkey, round(coalesce(CASE WHEN p_size % 9 <> 0 THEN p_size END, CASE WHEN p_size % 2 = 0 THEN p_retailprice END) / 100e0, 6) AS metric
FROM part""")
def sc17(spark, sf):
    metric = s.first_percent("if(p_size % 9 <> 0, p_size, NULL)", "if(p_size % 2 = 0, p_retailprice, NULL)")
    return b.table(spark, sf, "part").selectExpr("p_partkey", f"round({metric}, 6) AS metric")


@query("PF10_numeric_coercion", """
SELECT doc_id, CASE WHEN isfinite(n) THEN n END AS number, n IS NULL OR NOT isfinite(n) AS rejected
FROM (SELECT doc_id, try_cast(CASE doc_id % 5 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN lang
      ELSE ' ' || n_chars || '.5 ' END AS DOUBLE) AS n FROM documents)""")
def pf10(spark, sf):
    text = ("CASE doc_id % 5 WHEN 0 THEN string(n_chars) WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN lang "
            "ELSE concat(' ', n_chars, '.5 ') END AS raw")
    rows = b.table(spark, sf, "documents", "doc_id", "lang", "n_chars").selectExpr("doc_id", text)
    return rows.selectExpr("doc_id", f"{s.finite('raw')} AS number", f"{s.finite('raw')} IS NULL AS rejected")


@query("WN14_ranked_positions", """
SELECT portfolio_id, ticker, round(composite_score, 6) AS composite_score,
       row_number() OVER (PARTITION BY portfolio_id ORDER BY composite_score DESC, ticker) AS rank FROM analyses""", ("analyses",))
def wn14(spark, sf):
    rows = analyses(spark, sf).select("portfolio_id", "ticker", "composite_score")
    ranked = ranked_per_group(rows, ["portfolio_id"], [F.col("composite_score").desc(), F.col("ticker")])
    return ranked.select("portfolio_id", "ticker", rnd("composite_score"), big("rank"))


@query("TK1_top_six", """
SELECT portfolio_id, ticker, round(composite_score, 6) AS composite_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY composite_score DESC, ticker) AS rank
  FROM analyses WHERE weight_pct <= 100e0 / position_count * 1.3e0) WHERE rank <= 6""", ("analyses",))
def tk1(spark, sf):
    return d.top_candidates(analyses(spark, sf)).select("portfolio_id", "ticker", rnd("composite_score"), big("rank"))


view("cash_rules", """
SELECT portfolio_id, cash, CASE WHEN cash < 3000 THEN 2 ELSE least(6, floor(cash / 1000)) END AS max_picks,
       CASE WHEN cash <= 0 THEN 0 ELSE ceil(cash / 1000) * 2.5 END AS single_fee FROM portfolios""", ("portfolios",))
view("theme_open", """
SELECT a.portfolio_id, a.ticker, a.theme, a.composite_score AS score, a.live_price,
       row_number() OVER (PARTITION BY a.portfolio_id, a.theme ORDER BY a.composite_score DESC, a.ticker) AS in_theme
FROM analyses a JOIN (SELECT portfolio_id, theme, sum(weight_pct) AS tw FROM analyses GROUP BY 1, 2) t
  ON t.portfolio_id = a.portfolio_id AND t.theme = a.theme AND t.tw < 20
WHERE a.weight_pct <= 100e0 / a.position_count * 1.3e0""", ("analyses",))
view("picks", """
SELECT p.*, count(*) OVER (PARTITION BY portfolio_id) AS n FROM (
  SELECT o.*, row_number() OVER (PARTITION BY o.portfolio_id ORDER BY score DESC, ticker) AS leg, c.cash, c.max_picks, c.single_fee
  FROM theme_open o JOIN cash_rules c USING (portfolio_id) WHERE in_theme = 1) p WHERE leg <= max_picks""", ("theme_open", "cash_rules"))
view("units_a", """
SELECT *, ceil(cash / 1000) AS tr, CASE WHEN sum(score) OVER w > 0 THEN score / sum(score) OVER w * ceil(cash / 1000)
       ELSE ceil(cash / 1000) / count(*) OVER w END AS target
FROM picks WHERE n >= 3 AND cash >= 3000 AND leg <= least(ceil(cash / 1000), 6) WINDOW w AS (PARTITION BY portfolio_id)""", ("picks",))
view("units_b", """
SELECT *, target - floor(target) AS frac, greatest(1, floor(target)) AS units0,
       tr - sum(greatest(1, floor(target))) OVER (PARTITION BY portfolio_id) AS gap FROM units_a""", ("units_a",))
view("units_c", """
SELECT *, 1000 * (CASE WHEN gap > 0 THEN units0 + CASE WHEN row_number() OVER (PARTITION BY portfolio_id ORDER BY frac DESC, leg) = 1 THEN gap ELSE 0 END
   WHEN gap < 0 THEN units0 - least(units0 - 1, greatest(0, -gap - coalesce(sum(units0 - 1) OVER (
        PARTITION BY portfolio_id ORDER BY frac, leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
   ELSE units0 END) AS amount0 FROM units_b""", ("units_b",))
view("units_d", """
SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY CASE WHEN amount0 - over_by >= 250 THEN amount0 ELSE -1 END DESC, leg) AS pref
FROM (SELECT *, sum(amount0) OVER (PARTITION BY portfolio_id) - cash AS over_by FROM units_c)""", ("units_c",))
view("large_orders", """
SELECT portfolio_id, leg, ticker, live_price, amount, single_fee, min(amount) OVER w >= 250
       AND sum(ceil(amount / 1000) * 2.5) OVER w <= single_fee AS ok
FROM (SELECT *, CASE WHEN over_by > 0 AND pref = 1 THEN amount0 - over_by ELSE amount0 END AS amount FROM units_d)
WINDOW w AS (PARTITION BY portfolio_id)""", ("units_d",))
view("pair_split", """
SELECT a.portfolio_id, a.cash * (a.score / nullif(a.score + b.score, 0)) AS first_amount, a.cash, a.single_fee
FROM picks a JOIN picks b ON a.portfolio_id = b.portfolio_id AND a.leg = 1 AND b.leg = 2 WHERE a.cash >= 500""", ("picks",))
view("pair_ok", """
SELECT * FROM pair_split WHERE first_amount >= 250 AND cash - first_amount >= 250
  AND ceil(first_amount / 1000) * 2.5 + ceil((cash - first_amount) / 1000) * 2.5 <= single_fee""", ("pair_split",))
view("deploy_orders", """
SELECT portfolio_id, leg, ticker, amount, live_price FROM large_orders WHERE ok
UNION ALL
SELECT p.portfolio_id, p.leg, p.ticker, CASE WHEN p.leg = 1 THEN s.first_amount ELSE s.cash - s.first_amount END, p.live_price
FROM picks p JOIN pair_ok s USING (portfolio_id)
WHERE p.leg <= 2 AND p.portfolio_id NOT IN (SELECT portfolio_id FROM large_orders WHERE ok)
UNION ALL
SELECT portfolio_id, leg, ticker, cash, live_price FROM picks
WHERE leg = 1 AND cash >= 250 AND portfolio_id NOT IN (SELECT portfolio_id FROM large_orders WHERE ok)
  AND portfolio_id NOT IN (SELECT portfolio_id FROM pair_ok)""", ("large_orders", "pair_ok", "picks"))
view("deploy_plans", """
SELECT c.portfolio_id, c.cash, coalesce(o.deployed, 0) AS deployed, coalesce(o.fee, 0) AS total_fee, coalesce(o.orders, 0) AS orders,
       coalesce(k.n, 0) AS candidates,
       CASE WHEN c.portfolio_id NOT IN (SELECT portfolio_id FROM analyses) THEN 'no_positions' WHEN c.cash < 250 THEN 'below_floor' ELSE 'planned' END AS status
FROM cash_rules c LEFT JOIN (SELECT portfolio_id, sum(amount) AS deployed, sum(ceil(amount / 1000) * 2.5) AS fee, count(*) AS orders
                             FROM deploy_orders GROUP BY 1) o USING (portfolio_id)
LEFT JOIN (SELECT portfolio_id, count(*) AS n FROM picks GROUP BY 1) k USING (portfolio_id)""", ("cash_rules", "deploy_orders", "picks", "analyses"))


def plans(spark, sf):
    return d.plan_deployment(analyses(spark, sf), b.portfolios(spark, sf))


@query("SC24_deployment_orders", """
SELECT portfolio_id, leg::BIGINT AS leg, ticker, round(amount, 4) AS amount, round(amount / live_price, 6) AS shares,
       (ceil(amount / 1000) * 2.5)::DOUBLE AS fee FROM deploy_orders""", ("deploy_orders",))
def sc24(spark, sf):
    return d.orders_of(plans(spark, sf)).select("portfolio_id", big("leg"), "ticker", rnd("amount", 4), rnd("shares"), "fee")


@query("SC24_deployment_plans", """
SELECT portfolio_id, round(deployed, 2) AS deployed, total_fee::DOUBLE AS total_fee, orders, candidates, status FROM deploy_plans""", ("deploy_plans",))
def sc24p(spark, sf):
    return plans(spark, sf).select("portfolio_id", rnd("deployed", 2), "total_fee", F.size("orders").cast("long").alias("orders"),
                                   big("candidates"), "status")


@query("SC24_excluded", """
SELECT portfolio_id, ticker, 'overweight' AS reason FROM analyses WHERE weight_pct > 100e0 / position_count * 1.3e0
UNION ALL
SELECT e.portfolio_id, e.ticker, 'theme' FROM analyses e JOIN cash_rules c USING (portfolio_id)
LEFT JOIN picks stop ON stop.portfolio_id = e.portfolio_id AND stop.leg = c.max_picks
LEFT JOIN picks p ON p.portfolio_id = e.portfolio_id AND p.ticker = e.ticker
WHERE e.weight_pct <= 100e0 / e.position_count * 1.3e0 AND p.ticker IS NULL
  AND (stop.ticker IS NULL OR e.composite_score > stop.score OR (e.composite_score = stop.score AND e.ticker < stop.ticker))""", ("analyses", "cash_rules", "picks"))
def sc24x(spark, sf):
    # Read by five branches, so it is made once, without the columns that none of them needs.
    a = reuse(analyses(spark, sf).select(
        "portfolio_id", "ticker", "theme", "weight_pct", "position_count", "composite_score", "live_price"))
    heavy = d.overweight(a).select("portfolio_id", "ticker", F.lit("overweight").alias("reason"))
    blocked = d.blocked_by_theme(a, b.portfolios(spark, sf)).withColumn("reason", F.lit("theme"))
    return heavy.unionByName(blocked)


@query("WN8_theme_picks", """
SELECT portfolio_id, leg AS pick, ticker, theme FROM picks""", ("picks",))
def wn8(spark, sf):
    rows = d.purchase_candidates(analyses(spark, sf)).join(b.portfolios(spark, sf).select("portfolio_id", "cash"), "portfolio_id")
    return rows.filter(f"pick <= {fee.max_orders('cash')}").select("portfolio_id", big("pick"), "ticker", "theme")


@query("SC19_max_orders", "SELECT portfolio_id, max_picks::BIGINT AS max_orders FROM cash_rules", ("cash_rules",))
def sc19(spark, sf):
    return b.portfolios(spark, sf).select("portfolio_id", F.expr(fee.max_orders("cash")).cast("long").alias("max_orders"))


@query("SC20_score_split", """
SELECT portfolio_id, round(first_amount, 4) AS first_amount, round(cash - first_amount, 4) AS second_amount FROM pair_split""", ("pair_split",))
def sc20(spark, sf):
    c = F.col
    two = d.purchase_candidates(analyses(spark, sf)).filter("pick <= 2").groupBy("portfolio_id").agg(
        F.max(F.when(c("pick") == 1, c("score"))).alias("a"), F.max(F.when(c("pick") == 2, c("score"))).alias("b"))
    rows = two.join(b.portfolios(spark, sf), "portfolio_id").filter(c("b").isNotNull() & (c("cash") >= 500))
    first = F.expr(fee.score_split("a", "b", "cash"))
    return rows.select("portfolio_id", F.round(first, 4).alias("first_amount"), F.round(c("cash") - first, 4).alias("second_amount"))


@query("SC21_tranche_units", """
SELECT portfolio_id, leg::BIGINT AS leg, round(amount, 4) AS amount FROM (
  SELECT portfolio_id, leg, amount, min(amount) OVER (PARTITION BY portfolio_id) AS low FROM large_orders) WHERE low >= 250""", ("large_orders",))
def sc21(spark, sf):
    c = F.col
    picks = d.purchase_candidates(analyses(spark, sf)).groupBy("portfolio_id").agg(
        F.sort_array(F.collect_list(F.struct("pick", "score"))).alias("p"))
    rows = picks.join(b.portfolios(spark, sf), "portfolio_id").withColumn("p", F.slice("p", 1, F.expr(fee.max_orders("cash"))))
    rows = rows.filter((F.size("p") >= 3) & (c("cash") >= 3000))
    legs = rows.select("portfolio_id", F.posexplode(F.expr(fee.tranche_amounts("p.score", "cash"))).alias("i", "amount"))
    return legs.select("portfolio_id", (c("i") + 1).cast("long").alias("leg"), rnd("amount", 4))


@query("SC22_fee_neutral_split", """
SELECT portfolio_id, coalesce(ceil(first_amount / 1000) * 2.5 + ceil((cash - first_amount) / 1000) * 2.5 <= single_fee, FALSE) AS fee_neutral
FROM pair_split""", ("pair_split",))
def sc22(spark, sf):
    rows = sc20(spark, sf).join(b.portfolios(spark, sf), "portfolio_id")
    split = fee.total_order_fee("array(first_amount, second_amount)")
    return rows.selectExpr("portfolio_id", f"coalesce({split} <= {fee.order_fee('cash')}, false) AS fee_neutral")


@query("SC23_order_count", "SELECT status, orders, count(*) AS portfolios, round(sum(deployed), 2) AS deployed FROM deploy_plans GROUP BY 1, 2", ("deploy_plans",))
def sc23(spark, sf):
    rows = plans(spark, sf).withColumn("orders", F.size("orders").cast("long"))
    return rows.groupBy("status", "orders").agg(F.count(F.lit(1)).alias("portfolios"), F.round(F.sum("deployed"), 2).alias("deployed"))


@query("SC25_deployment_bound", """
SELECT portfolio_id, CASE WHEN cash >= 250 AND candidates >= 1 THEN cash ELSE 0 END::DOUBLE AS bound FROM deploy_plans""", ("deploy_plans",))
def sc25(spark, sf):
    return plans(spark, sf).select("portfolio_id", F.expr(fee.deployable_bound("cash", "candidates")).alias("bound"))


CASH_GRID = (0.25, 0.5, 1.0, 2.0)


def _on_cash_grid(sql):
    """The same SQL with every portfolio repeated for each cash level."""
    levels = ", ".join(f"({i}, {f!r}::DOUBLE)" for i, f in enumerate(CASH_GRID))
    for name, cash in (("positions", ""), ("portfolios", ", cash * f AS cash")):
        text = _VIEWS[name][1]
        grid = f"SELECT v.* REPLACE (portfolio_id * 10 + lvl AS portfolio_id{cash}) FROM ({text}) v, (VALUES {levels}) g(lvl, f)"
        sql = sql.replace(f"{name} AS ({text})", f"{name} AS ({grid})")
    return sql


@query("SC26_planner_gap", _on_cash_grid(with_views(("deploy_plans",), """
SELECT status, round(max(greatest(0, CASE WHEN cash >= 250 AND candidates >= 1 THEN cash ELSE 0 END - deployed)), 4) + 0e0 AS max_deployment_gap,
       max(total_fee - CASE WHEN deployed <= 0 THEN 0 ELSE ceil(round(deployed, 6) / 1000) * 2.5 END)::DOUBLE AS max_fee_premium, count(*) AS plans
FROM deploy_plans GROUP BY 1""")))
def sc26(spark, sf):
    levels = ", ".join(f"{f!r}D" for f in CASH_GRID)
    grid = b.portfolios(spark, sf).selectExpr("portfolio_id", f"explode(transform(array({levels}), f -> cash * f)) AS cash")
    p = d.plan_deployment(analyses(spark, sf), grid).withColumn("deployed", F.round("deployed", 6))
    return d.planner_gap(p).groupBy("status").agg(
        F.round(F.max("deployment_gap"), 4).alias("max_deployment_gap"), F.max("fee_premium").alias("max_fee_premium"),
        F.count(F.lit(1)).alias("plans"))


@query("SC33_rebalance_suggestions", """
SELECT portfolio_id, ticker, round(weight_pct, 6) AS current_weight, round(t, 6) AS target_weight,
       CASE WHEN weight_pct - t < 0 THEN 'BUY' ELSE 'SELL' END AS action, round(abs((t / 100)::DECIMAL(18, 14) * portfolio_value::DECIMAL(18, 4) - market_value::DECIMAL(18, 4)), 4)::DOUBLE AS amount, round(abs(weight_pct - t), 6) AS deviation,
       'Weight deviation: ' || printf('%+.1f', round(weight_pct - t, 1)) || '% from target' AS reason
FROM (SELECT *, 100e0 / count(*) OVER (PARTITION BY portfolio_id) AS t FROM weighted) WHERE abs(weight_pct - t) > 5""", ("weighted",))
def sc33(spark, sf):
    return v.rebalance_suggestions(weighted(spark, sf)).select(
        "portfolio_id", "ticker", rnd("current_weight"), rnd("target_weight"), "action", F.round("amount", 4).cast("double").alias("amount"), rnd("deviation"), "reason")


@query("TK9_positions_by_value", """
SELECT portfolio_id, ticker, round(market_value, 4) AS market_value, row_number() OVER (PARTITION BY portfolio_id ORDER BY market_value DESC, ticker) AS place
FROM valued""", ("valued",))
def tk9(spark, sf):
    rows = v.value_positions(b.positions(spark, sf)).select("portfolio_id", "ticker", "market_value", v.size_order().alias("size"))
    ranked = ranked_per_group(rows, ["portfolio_id"], [F.col("size").desc(), F.col("ticker")], "place")
    return ranked.select("portfolio_id", "ticker", rnd("market_value", 4), big("place"))
