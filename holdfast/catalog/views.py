"""Shared SQL views: the bridge tables restated for the checks."""

from __future__ import annotations

from holdfast.catalog.registry import view

view("positions", """
SELECT h.o_custkey AS portfolio_id, 'P' || h.l_partkey AS ticker, p_name AS name, p_brand AS theme,
       p_type = 'PROMO' AS is_financial, shares, round(paid * 100 / shares) / 10000 AS cost, p_retailprice AS price
FROM (SELECT o_custkey, l_partkey, sum(l_quantity) AS shares,
             sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE AS paid
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey) h
JOIN part ON p_partkey = h.l_partkey""")

view("portfolios", """
SELECT c_custkey AS portfolio_id, c_name AS portfolio_name, 'N' || c_nationkey AS currency, c_acctbal AS cash
FROM customer""")

view("yearly", """
SELECT l_partkey, year(l_shipdate)::INTEGER AS fiscal_year, sum(l_extendedprice) AS rev,
       sum(l_extendedprice * (1 - l_discount)) AS disc, sum(l_quantity) AS qty, count(*) AS n, avg(l_tax) AS tax
FROM lineitem GROUP BY 1, 2""")

view("statements", """
SELECT l_partkey, fiscal_year, n AS line_count, rev AS revenue, rev * 0.30 - (rev - disc) * 2 AS ebit,
       rev * 0.25 - (rev - disc) AS operating_income, disc / qty AS eps, rev * 0.12 - (rev - disc) AS fcf,
       qty AS diluted_shares, rev - n * 30000.0 AS invested_capital, CASE WHEN n >= 2 THEN tax END AS tax_rate
FROM yearly""", ("yearly",))

view("scalars", """
SELECT p_partkey, 'P' || p_partkey AS ticker, p_name AS name, p_brand AS theme, p_type AS segment,
       p_type = 'PROMO' AS is_financial, p_retailprice AS broker_price,
       p_retailprice * (p_size + 80) / 100 AS live_price,
       p_retailprice * (p_size + 80) / 100 * u.units * 20 AS market_cap,
       CASE WHEN p_size % 9 <> 0 THEN p_size / 100.0 END::DOUBLE AS return_on_equity,
       CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_size / 60.0 END::DOUBLE AS gross_margin,
       CASE WHEN p_size % 7 <> 0 THEN p_size / 120.0 END::DOUBLE AS operating_margin,
       CASE WHEN p_size % 6 = 0 THEN 0.0 WHEN p_size % 11 <> 0 THEN p_size + 8.0 END::DOUBLE AS forward_pe,
       CASE WHEN p_size % 13 = 0 THEN 0.0 ELSE u.fcf_total END::DOUBLE AS free_cash_flow,
       CASE WHEN p_size % 17 <> 0 THEN 'N' || (p_size % 25) END AS financial_currency,
       CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size % 17 <> 0 THEN 'N' || (p_size % 25) END ELSE 'N0' END
         AS trading_currency
FROM part JOIN (SELECT l_partkey, sum(diluted_shares) AS units, sum(fcf) AS fcf_total FROM statements GROUP BY 1) u
  ON u.l_partkey = p_partkey""", ("statements",))

view("fx", """
SELECT 'N' || n_nationkey AS base, 'N0' AS quote, n_nationkey / 50.0::DOUBLE + 1 AS rate FROM nation WHERE n_nationkey > 0""")

view("aligned_years", """
SELECT s.*, row_number() OVER (PARTITION BY l_partkey ORDER BY fiscal_year DESC) AS age,
       row_number() OVER (PARTITION BY l_partkey ORDER BY fiscal_year) AS pos,
       count(*) OVER (PARTITION BY l_partkey) AS years
FROM statements s""", ("statements",))

view("tax_by_age", """
SELECT l_partkey, tax_rate AS rate, row_number() OVER (PARTITION BY l_partkey ORDER BY fiscal_year DESC) AS age
FROM statements WHERE tax_rate IS NOT NULL""", ("statements",))

view("measures", """
SELECT a.l_partkey,
       avg(CASE WHEN invested_capital > 0 THEN ebit * (1 - coalesce(t.rate, 0.21)) / invested_capital END) AS roic,
       coalesce(avg(CASE WHEN invested_capital > 0 THEN
                    CASE WHEN ebit * (1 - coalesce(t.rate, 0.21)) / invested_capital >= 0.15 THEN 1.0 ELSE 0.0 END END),
                0.0)::DOUBLE AS pricing_power,
       CASE WHEN count(*) >= 2 AND avg(operating_income / revenue) <> 0
            THEN stddev_pop(operating_income / revenue) / abs(avg(operating_income / revenue)) END AS margin_cv,
       CASE WHEN count(*) >= 2 AND min_by(revenue, fiscal_year) > 0 AND max_by(revenue, fiscal_year) > 0
            THEN pow(max_by(revenue, fiscal_year) / min_by(revenue, fiscal_year), 1e0 / (count(*) - 1)) - 1 END AS revenue_cagr,
       CASE WHEN count(*) >= 2 AND min_by(eps, fiscal_year) > 0 AND max_by(eps, fiscal_year) > 0
            THEN pow(max_by(eps, fiscal_year) / min_by(eps, fiscal_year), 1e0 / (count(*) - 1)) - 1 END AS eps_cagr,
       CASE WHEN count(*) >= 2 AND min_by(fcf, fiscal_year) > 0 AND max_by(fcf, fiscal_year) > 0
            THEN pow(max_by(fcf, fiscal_year) / min_by(fcf, fiscal_year), 1e0 / (count(*) - 1)) - 1 END AS fcf_cagr,
       CASE WHEN count(*) >= 2 THEN (max_by(diluted_shares, fiscal_year) - min_by(diluted_shares, fiscal_year))
            / min_by(diluted_shares, fiscal_year) END AS shares_change
FROM aligned_years a LEFT JOIN tax_by_age t ON t.l_partkey = a.l_partkey AND t.age = a.age
GROUP BY a.l_partkey""", ("aligned_years", "tax_by_age"))

view("with_yield", """
SELECT s.*, m.* EXCLUDE (l_partkey), s.return_on_equity AS roe,
       CASE WHEN s.financial_currency <> s.trading_currency THEN f.rate ELSE 1.0 END::DOUBLE AS fx_rate,
       CASE WHEN s.free_cash_flow <> 0 AND s.market_cap > 0 THEN s.free_cash_flow
            * CASE WHEN s.financial_currency <> s.trading_currency THEN f.rate ELSE 1.0 END::DOUBLE / s.market_cap END AS fcf_yield,
       CASE WHEN s.forward_pe <> 0 AND m.eps_cagr > 0 THEN s.forward_pe / (m.eps_cagr * 100) END AS peg
FROM scalars s JOIN measures m ON m.l_partkey = s.p_partkey
LEFT JOIN fx f ON f.base = s.financial_currency AND f.quote = s.trading_currency""", ("scalars", "measures", "fx"))

view("pointed", """
SELECT *,
  0.5 * least(100, greatest(0, coalesce(roic, roe, 0) / 0.30 * 100))
  + 0.25 * least(100, greatest(0, coalesce(nullif(gross_margin, 0), nullif(operating_margin, 0), 0) / 0.70 * 100))
  + 0.25 * CASE WHEN margin_cv IS NULL THEN 50 ELSE least(100, greatest(0, 100 - margin_cv * 400)) END AS moat_points,
  0.35 * least(100, greatest(0, coalesce(eps_cagr, 0) / 0.20 * 100))
  + 0.35 * least(100, greatest(0, coalesce(fcf_cagr, 0) / 0.20 * 100))
  + 0.20 * least(100, greatest(0, coalesce(revenue_cagr, 0) / 0.20 * 100))
  + 0.10 * CASE WHEN shares_change IS NULL THEN 50 ELSE least(100, greatest(0, 50 - shares_change * 1000)) END
    AS compounding_points,
  0.40 * CASE WHEN fcf_yield IS NULL THEN 50 ELSE least(100, greatest(0, fcf_yield / 0.06 * 100)) END
  + 0.35 * CASE WHEN nullif(forward_pe, 0) IS NULL THEN 50 ELSE least(100, greatest(0, 100 - (forward_pe - 15) * 2)) END
  + 0.25 * CASE WHEN nullif(peg, 0) IS NULL THEN 50 ELSE least(100, greatest(0, 100 - (peg - 1) * 50)) END
    AS valuation_points,
  CASE WHEN is_financial THEN CASE WHEN roe >= 0.15 THEN 'STRONG' ELSE 'MODERATE' END
       WHEN roic IS NULL THEN 'INSUFFICIENT_DATA'
       WHEN roic >= 0.15 AND margin_cv <= 0.10 THEN CASE WHEN pricing_power >= 0.70 THEN 'STRONG' ELSE 'MODERATE' END
       WHEN roic < 0.10 OR coalesce(margin_cv > 0.25, FALSE) THEN 'WEAK' ELSE 'MODERATE' END AS moat_class,
  CASE WHEN fcf_cagr IS NULL OR eps_cagr IS NULL THEN 'INSUFFICIENT_DATA'
       WHEN fcf_cagr >= 0.15 AND eps_cagr >= 0.15 THEN
            CASE WHEN coalesce(shares_change <= -0.05, FALSE) THEN 'EXCELLENT' ELSE 'STRONG' END
       WHEN fcf_cagr >= 0.10 AND eps_cagr > 0 THEN 'GOOD'
       WHEN fcf_cagr <= 0 OR eps_cagr <= 0 THEN 'POOR' ELSE 'MODERATE' END AS compounding_class
FROM with_yield""", ("with_yield",))

view("scored", """
SELECT *, 0.40 * moat_points + 0.35 * compounding_points + 0.25 * valuation_points AS composite_score
FROM pointed""", ("pointed",))

view("analyses", """
SELECT *, market_value / sum(market_value) OVER (PARTITION BY portfolio_id) * 100 AS weight_pct,
       count(*) OVER (PARTITION BY portfolio_id) AS position_count
FROM (SELECT p.portfolio_id, p.ticker, p.name, p.theme, p.is_financial, p.shares, p.cost AS average_cost,
             p.price AS broker_price, s.live_price, p.shares * s.live_price AS market_value,
             CASE WHEN p.shares * p.cost <> 0 THEN (p.shares * s.live_price - p.shares * p.cost) / (p.shares * p.cost) * 100
                  ELSE 0 END AS pnl_pct,
             (s.live_price - p.price) / nullif(p.price, 0) * 100 AS price_gap_pct,
             s.roic, s.roe, s.margin_cv, s.revenue_cagr, s.eps_cagr, s.fcf_cagr, s.shares_change, s.fcf_yield,
             s.forward_pe, s.peg, s.moat_class, s.compounding_class, s.moat_points, s.compounding_points,
             s.valuation_points, s.composite_score
      FROM positions p JOIN scored s USING (ticker))""", ("positions", "scored"))

view("transactions", """
SELECT o_custkey AS portfolio_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trade_ref,
       'P' || l_partkey AS ticker, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS transaction_type,
       l_quantity AS shares, l_extendedprice / l_quantity AS price_per_share, l_extendedprice AS total_amount,
       CASE WHEN l_extendedprice <= 0 THEN 0 ELSE ceil(l_extendedprice / 1000) * 2.5 END AS fees, l_shipdate AS executed_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

view("quotes", """
SELECT 'Q' || user_id AS ticker, value AS price, CASE WHEN event_type <> 'error' THEN value / 100 END AS change_percent,
       event_type AS feed, ts AS recorded_at, event_id AS quote_id
FROM events""")

view("facts", """
SELECT 'S' || l_suppkey AS entity, 'Tag' || l_linenumber AS tag, l_extendedprice AS value,
       o_orderdate::DATE AS period_end, l_shipdate::DATE AS filed,
       CASE l_returnflag WHEN 'A' THEN '10-K' WHEN 'N' THEN '10-Q' ELSE '20-f' END AS form,
       year(o_orderdate)::INTEGER AS fiscal_year, l_orderkey AS accession
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate""")

view("brand_lines", """
SELECT 'R' || n_regionkey AS study, p_brand AS ticker, date_trunc('month', l_shipdate)::DATE AS date,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_quantity AS qty
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey""")

view("prices", """
SELECT study, ticker, date, sum(cents)::DOUBLE / 100 / sum(qty) AS price FROM brand_lines GROUP BY 1, 2, 3""", ("brand_lines",))

view("spend_weights", """
SELECT study, ticker, sum(cents)::DOUBLE / 100 AS weight FROM brand_lines GROUP BY 1, 2""", ("brand_lines",))

view("legs", """
SELECT l_orderkey AS run_id, l_linenumber AS slot, replace(p_brand, '#', '') AS ticker,
       round(sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / 100) / 100 AS amount,
       sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS spent
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")

view("brand_ranks", """
SELECT o_custkey, ticker, row_number() OVER (PARTITION BY o_custkey ORDER BY sum(spent) DESC, ticker) AS r
FROM legs JOIN orders ON run_id = o_orderkey GROUP BY o_custkey, ticker""", ("legs",))

view("scenarios", """
SELECT 'scn_' || c_custkey AS scenario, c_custkey, c_mktsegment AS category, cash, 3 AS max_recommendations,
       c_nationkey % 2 = 0 AS add_only, c_mktsegment <> 'BUILDING' AS amounts_required, 250e0 AS min_order_amount,
       CASE WHEN c_nationkey % 3 = 0 THEN 0.9e0 END AS min_cash_deployment_fraction,
       'segment_' || c_mktsegment AS fact_a, 'nation_' || c_nationkey AS fact_b, policy_size
FROM customer
JOIN (SELECT o_custkey, round(sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / count(*) / 10000, 2) AS cash
      FROM orders GROUP BY 1) c ON c.o_custkey = c_custkey
JOIN (SELECT o_custkey, least(3, count(*)) AS policy_size FROM brand_ranks GROUP BY 1) b ON b.o_custkey = c_custkey""", ("brand_ranks",))

view("runs", """
SELECT 'scn_' || o_custkey AS scenario, o_custkey,
       CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'advisor_fast' ELSE 'advisor_slow' END AS advisor,
       CASE o_orderkey % 3 WHEN 0 THEN 'bare' WHEN 1 THEN 'policy' ELSE 'scaffold' END AS arm,
       o_orderkey AS run_id, o_orderstatus <> 'P' AS has_amounts, o_orderstatus AS status
FROM orders WHERE o_orderkey IN (SELECT run_id FROM legs) AND o_custkey IN (SELECT c_custkey FROM customer)""", ("legs",))
