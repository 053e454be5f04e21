"""Price, return, back-test and allocator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import bridge as b
from holdfast.catalog.core import big, rnd
from holdfast.catalog.registry import query, view
from holdfast.grouping import cut_lineage, reuse
from holdfast.operators import allocators as al
from holdfast.operators import backtest as bt
from holdfast.operators import resampling as rs
from holdfast.operators import returns as r
from holdfast.plans import backtest_study as study

view("aligned", """
SELECT p.* FROM prices p JOIN (
  SELECT study, date FROM prices JOIN (SELECT study, count(DISTINCT ticker) AS k FROM prices GROUP BY 1) u USING (study)
  WHERE price > 0 GROUP BY study, date, k HAVING count(DISTINCT ticker) = k) d USING (study, date)
WHERE p.study IN (SELECT study FROM (
  SELECT study, date FROM prices JOIN (SELECT study, count(DISTINCT ticker) AS k FROM prices GROUP BY 1) u USING (study)
  GROUP BY study, date, k HAVING count(DISTINCT ticker) = k) GROUP BY study HAVING count(*) >= 2)""", ("prices",))
view("rets", """
SELECT study, ticker, date, row_number() OVER (PARTITION BY study, ticker ORDER BY date) - 1 AS period, ret FROM (
  SELECT *, price / lag(price) OVER (PARTITION BY study, ticker ORDER BY date) - 1 AS ret FROM aligned) WHERE ret IS NOT NULL""", ("aligned",))
view("strategies", """
SELECT study, 'current' AS strategy, ticker, weight / sum(weight) OVER (PARTITION BY study) AS weight FROM spend_weights
UNION ALL SELECT study, 'equal', ticker, 1e0 / count(*) OVER (PARTITION BY study) FROM spend_weights
UNION ALL SELECT study, 'benchmark', ticker, 1e0 FROM spend_weights WHERE ticker = 'Brand#1'""", ("spend_weights",))
view("fixed_rets", """
SELECT study, strategy, period, sum(weight * ret) AS ret FROM rets JOIN strategies USING (study, ticker) GROUP BY 1, 2, 3""", ("rets", "strategies"))


def returns(spark, sf):
    return r.simple_returns(r.align_prices(b.brand_prices(spark, sf)))


def strategies(spark, sf):
    return study.standard_strategies(b.brand_spend(spark, sf), "Brand#1")


def fixed(spark, sf):
    return r.fixed_weight_returns(returns(spark, sf), r.normalize_weights(strategies(spark, sf)))


@query("SJ5_aligned_prices", "SELECT study, ticker, date, round(price, 8) AS price FROM aligned", ("aligned",))
def sj5(spark, sf):
    return r.align_prices(b.brand_prices(spark, sf)).select("study", "ticker", "date", rnd("price", 8))


@query("SO4_common_dates", """
SELECT study, count(DISTINCT date) AS common_dates FROM aligned GROUP BY 1""", ("aligned",))
def so4(spark, sf):
    return r.align_prices(b.brand_prices(spark, sf)).select("study", "date").distinct().groupBy("study").agg(
        F.count(F.lit(1)).alias("common_dates"))


@query("WN1_simple_returns", "SELECT study, ticker, date, period, round(ret, 6) + 0e0 AS ret FROM rets", ("rets",))
def wn1(spark, sf):
    return returns(spark, sf).select("study", "ticker", "date", big("period"), rnd("ret"))


@query("SJ10_fixed_weight_returns", "SELECT study, strategy, period, round(ret, 6) + 0e0 AS ret FROM fixed_rets", ("fixed_rets",))
def sj10(spark, sf):
    return fixed(spark, sf).select("study", "strategy", big("period"), rnd("ret"))


def _metric(name, sql_cols, cols):
    sql = f"""SELECT study, strategy, {sql_cols} FROM (
      SELECT study, strategy, count(*) AS n, product(1 + ret) AS g, avg(ret) AS m, stddev_pop(ret) AS d FROM fixed_rets GROUP BY 1, 2)"""

    def run(spark, sf):
        measured = r.performance(fixed(spark, sf), 12.0, 0.02)
        grown = measured.withColumn("log_growth", F.round(F.log1p("total_return"), 9))
        return grown.select("study", "strategy", *[c if c == "log_growth" else rnd(c) for c in cols])

    query(name, sql, ("fixed_rets",))(run)


# A growth of 1e9 has no six decimals in a double: the logarithm carries the digits.
_metric("AG6_growth", "round(ln(g), 9) + 0e0 AS log_growth, CASE WHEN g > 0 THEN round(pow(g, 12e0 / n) - 1, 6) + 0e0 END AS cagr", ["log_growth", "cagr"])
_metric("AG7_volatility", "round(CASE WHEN n < 2 THEN 0 ELSE d * sqrt(12e0) END, 6) AS volatility", ["volatility"])
_metric("AG8_sharpe", "round(CASE WHEN n < 2 OR d < 1e-12 THEN 0 ELSE (m - 0.02e0 / 12) / d * sqrt(12e0) END, 6) + 0e0 AS sharpe", ["sharpe"])


@query("AG9_covariance", """
SELECT study, ticker_a, ticker_b, round(0.8e0 * cov + CASE WHEN ticker_a = ticker_b THEN 0.2e0 * avg(CASE WHEN ticker_a = ticker_b THEN cov END) OVER (PARTITION BY study) ELSE 0 END, 6) + 0e0 AS cov
FROM (SELECT a.study, a.ticker AS ticker_a, b.ticker AS ticker_b, covar_samp(a.ret, b.ret) AS cov
      FROM rets a JOIN rets b USING (study, period) GROUP BY 1, 2, 3)""", ("rets",))
def ag9(spark, sf):
    return r.covariance(returns(spark, sf), 0.2).select("study", "ticker_a", "ticker_b", rnd("cov"))


@query("ST9_equal_weights", """
SELECT study, ticker, round(1e0 / count(*) OVER (PARTITION BY study), 6) AS weight FROM spend_weights""", ("spend_weights",))
def st9(spark, sf):
    return r.equal_weights(b.brand_spend(spark, sf).select("study", "ticker")).select("study", "ticker", rnd("weight"))


view("bt_inputs", """
SELECT r.study, s.strategy, r.period, list(r.ret ORDER BY r.ticker) AS rr, list(s.weight ORDER BY r.ticker) AS ww, max(n) AS n
FROM rets r JOIN strategies s USING (study, ticker) JOIN (SELECT study, max(period) + 1 AS n FROM rets GROUP BY 1) USING (study) GROUP BY 1, 2, 3""", ("rets", "strategies"))


def _loop(every, cost):
    return f"""
SELECT study, strategy, period, equity, cost, reb FROM (
WITH RECURSIVE walk AS (
  SELECT DISTINCT study, strategy, (-1)::BIGINT AS period, ww AS held, 1e0 AS equity, 0e0 AS cost, FALSE AS reb FROM bt_inputs
  UNION ALL
  SELECT study, strategy, period, CASE WHEN reb THEN list_transform(ww, lambda w: w * (total - fee)) ELSE grown END, total - fee, fee, reb FROM (
    SELECT *, CASE WHEN reb THEN {cost}e0 * total * 0.5 * list_sum(list_transform(range(1, len(ww) + 1), lambda i: abs(grown[i] / total - ww[i]))) ELSE 0e0 END AS fee FROM (
      SELECT *, list_sum(grown) AS total FROM (
        SELECT i.study, i.strategy, i.period, i.ww, list_transform(range(1, len(i.ww) + 1), lambda k: w.held[k] * (1 + i.rr[k])) AS grown,
               {every} > 0 AND (i.period + 1) % {max(every, 1)} = 0 AND i.period <> i.n - 1 AS reb
        FROM walk w JOIN bt_inputs i ON i.study = w.study AND i.strategy = w.strategy AND i.period = w.period + 1))))
SELECT * FROM walk WHERE period >= 0)"""


view("drift_curve", _loop(0, 0), ("bt_inputs",))
view("reset_curve", _loop(6, 0.01), ("bt_inputs",))


@query("WN2_buy_and_hold", "SELECT study, strategy, period, round(equity, 6) AS equity FROM drift_curve", ("drift_curve",))
def wn2(spark, sf):
    return bt.run_backtest(returns(spark, sf), strategies(spark, sf)).select("study", "strategy", big("period"), rnd("equity"))


@query("WN3_periodic_rebalance", """
SELECT study, strategy, period, round(equity, 6) AS equity, round(cost, 6) AS cost, reb AS rebalanced FROM reset_curve""", ("reset_curve",))
def wn3(spark, sf):
    return bt.run_backtest(returns(spark, sf), strategies(spark, sf), 6, 0.01).select(
        "study", "strategy", big("period"), rnd("equity"), rnd("cost"), "rebalanced")


@query("WN4_max_drawdown", """
SELECT study, strategy, round(least(0, min(equity / greatest(1, peak) - 1)), 6) + 0e0 AS max_drawdown FROM (
  SELECT *, max(equity) OVER (PARTITION BY study, strategy ORDER BY period) AS peak FROM drift_curve) GROUP BY 1, 2""", ("drift_curve",))
def wn4(spark, sf):
    curve = bt.run_backtest(returns(spark, sf), strategies(spark, sf))
    return r.max_drawdown(curve).select("study", "strategy", rnd("max_drawdown"))


view("roll", """
SELECT f.study, f.strategy, f.period // 3 + 1 AS window_number,
       CASE WHEN stddev_pop(g.ret) < 1e-12 THEN 0 ELSE avg(g.ret) / stddev_pop(g.ret) * sqrt(12e0) END AS sharpe
FROM fixed_rets f JOIN fixed_rets g ON g.study = f.study AND g.strategy = f.strategy AND g.period BETWEEN f.period AND f.period + 11
WHERE f.period % 3 = 0 GROUP BY f.study, f.strategy, f.period HAVING count(*) = 12""", ("fixed_rets",))


@query("WN5_rolling_comparison", """
SELECT study, count(*) AS windows, count(*) FILTER (WHERE a.sharpe > c.sharpe) AS wins_a, round(avg(CASE WHEN a.sharpe > c.sharpe THEN 1e0 ELSE 0e0 END), 6) AS win_rate_a,
       round(avg(a.sharpe), 6) AS mean_sharpe_a, round(avg(c.sharpe), 6) AS mean_sharpe_b
FROM roll a JOIN roll c USING (study, window_number) WHERE a.strategy = 'equal' AND c.strategy = 'current' GROUP BY 1""", ("roll",))
def wn5(spark, sf):
    t = r.compare_rolling(r.rolling_sharpe(fixed(spark, sf), 12, 3, 12.0), "equal", "current")
    return t.select("study", "windows", "wins_a", rnd("win_rate_a"), rnd("mean_sharpe_a"), rnd("mean_sharpe_b"))


@query("WN6_rolling_excess", """
SELECT study, window_number, round(a.sharpe - c.sharpe, 6) + 0e0 AS excess
FROM roll a JOIN roll c USING (study, window_number) WHERE a.strategy = 'equal' AND c.strategy = 'current'""", ("roll",))
def wn6(spark, sf):
    s = r.rolling_sharpe(fixed(spark, sf), 12, 3, 12.0)
    wide = s.filter("strategy IN ('equal', 'current')").groupBy("study", "window_number").agg(
        F.expr("max(if(strategy = 'equal', sharpe, NULL)) - max(if(strategy = 'current', sharpe, NULL)) AS excess"))
    return wide.select("study", big("window_number"), rnd("excess"))


@query("WN11_turnover", """
SELECT study, round(sum(abs(coalesce(e.weight, 0) - coalesce(c.weight, 0))) / 2, 6) AS turnover
FROM (SELECT * FROM strategies WHERE strategy = 'current') c FULL JOIN (SELECT * FROM strategies WHERE strategy = 'benchmark') e USING (study, ticker) GROUP BY 1""", ("strategies",))
def wn11(spark, sf):
    w = r.normalize_weights(strategies(spark, sf))
    pick = lambda name: w.filter(F.col("strategy") == name).select("study", "ticker", "weight")
    return r.turnover(pick("current"), pick("benchmark"), ["study"]).select("study", rnd("turnover"))


view("curve_metrics", """
SELECT study, strategy, max_by(equity, period) - 1 AS tr, CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 12e0 / count(*)) - 1 END AS cagr,
       CASE WHEN stddev_pop(ret) < 1e-12 THEN 0 ELSE avg(ret) / stddev_pop(ret) * sqrt(12e0) END AS sh, least(0, min(equity / greatest(1, peak) - 1)) AS dd
FROM (SELECT *, equity / coalesce(lag(equity) OVER w, 1) - 1 AS ret, max(equity) OVER w AS peak FROM drift_curve WINDOW w AS (PARTITION BY study, strategy ORDER BY period))
GROUP BY 1, 2""", ("drift_curve",))


@query("SJ13_comparison", """
SELECT study, round(a.tr - c.tr, 6) + 0e0 AS excess_total_return, round(a.cagr - c.cagr, 6) + 0e0 AS excess_cagr, round(a.sh - c.sh, 6) + 0e0 AS sharpe_delta,
       round(a.dd - c.dd, 6) + 0e0 AS max_drawdown_delta
FROM (SELECT * FROM curve_metrics WHERE strategy = 'current') a JOIN (SELECT * FROM curve_metrics WHERE strategy = 'equal') c USING (study)""", ("curve_metrics",))
def sj13(spark, sf):
    m = bt.summarize(bt.run_backtest(returns(spark, sf), strategies(spark, sf)), 12.0)
    t = bt.compare(m, "current", "equal")
    return t.select("study", rnd("excess_total_return"), rnd("excess_cagr"), rnd("sharpe_delta"), rnd("max_drawdown_delta"))


def schedule(rets):
    return al.weight_schedule(rets, lookback=36, min_observations=12, every=6, shrinkage=0.8)


@query("WN12_weight_schedule")
def wn12(spark, sf):
    return schedule(returns(spark, sf)).select("study", "strategy", big("period"), "ticker", rnd("weight"))


@query("WN12_training_covariance", """
SELECT d.study, d.at AS period, a.ticker AS ticker_a, b.ticker AS ticker_b, round(covar_samp(a.ret, b.ret), 9) AS cov
FROM (SELECT DISTINCT study, period AS at FROM rets WHERE period % 6 = 0 AND period >= 12) d
JOIN rets a ON a.study = d.study AND a.period < d.at AND a.period >= d.at - 36
JOIN rets b ON b.study = a.study AND b.period = a.period GROUP BY ALL""", ("rets",))
def wn12c(spark, sf):
    rets = cut_lineage(returns(spark, sf))
    windows = al.rebalance_periods(rets, 6).filter("at >= 12").selectExpr("study", "at", "greatest(at - 36, 0) AS first")
    return r.window_covariances(rets, windows).select("study", big("at").alias("period"), "ticker_a", "ticker_b", rnd("cov", 9))


@query("WN13_walk_forward")
def wn13(spark, sf):
    rets = cut_lineage(returns(spark, sf))
    return bt.run_walk_forward(rets, cut_lineage(schedule(rets)), 0.01).select(
        "study", "strategy", big("period"), rnd("equity"), rnd("cost"), "rebalanced")


def _allocator(name, solver):
    @query(name)
    def run(spark, sf):
        rets = returns(spark, sf)
        one = al.training_matrices(rets, 36, 12, 6, 0.8)
        return al.solve_weights(one, {solver: al.SOLVERS[solver]}).select(
            "study", big("period"), "ticker", rnd("weight"))


_allocator("ST7_min_variance", "min_variance")
_allocator("ST8_risk_parity", "risk_parity")


@query("UD1_custom_allocator", """
SELECT study, ticker, period, round(inv / sum(inv) OVER (PARTITION BY study, period), 6) AS weight FROM (
  SELECT d.study, d.at AS period, ticker, 1 / (0.8e0 * var_samp(ret) + 0.2e0 * avg(var_samp(ret)) OVER (PARTITION BY d.study, d.at)) AS inv
  FROM (SELECT DISTINCT study, period AS at FROM rets WHERE period % 6 = 0 AND period >= 12) d
  JOIN rets r ON r.study = d.study AND r.period < d.at AND r.period >= d.at - 36 GROUP BY d.study, d.at, ticker)""", ("rets",))
def ud1(spark, sf):
    def inverse_variance(sigma):
        import numpy as np
        inv = 1 / np.diag(sigma)
        return inv / inv.sum()

    matrices = al.training_matrices(returns(spark, sf), 36, 12, 6, 0.2)
    return al.solve_weights(matrices, {"inverse_variance": inverse_variance}).select(
        "study", "ticker", big("period"), rnd("weight"))


@query("ST10_backtest_study")
def st10(spark, sf):
    metrics, _ = study.price_backtest_study(
        cut_lineage(returns(spark, sf)), b.brand_spend(spark, sf), "Brand#1", 12.0, rebalance_every=6, cost_rate=0.01,
        lookback=36, min_observations=12, every=6, shrinkage=0.8)
    return metrics.select("study", "strategy", "periods", "rebalances", *[
        rnd(c) for c in ["total_return", "cagr", "volatility", "sharpe", "max_drawdown", "total_cost"]])


@query("ST10_study_comparisons")
def st10c(spark, sf):
    _, comparisons = study.price_backtest_study(
        cut_lineage(returns(spark, sf)), b.brand_spend(spark, sf), "Brand#1", 12.0, rebalance_every=6, cost_rate=0.01,
        lookback=36, min_observations=12, every=6, shrinkage=0.8)
    return comparisons.select("study", "strategy", "benchmark", *[
        rnd(c) for c in ["excess_total_return", "excess_cagr", "sharpe_delta", "max_drawdown_delta"]])


BOOTSTRAP_SQL = """
SELECT study, samples, round(point_estimate, 6) + 0e0 AS point_estimate, round(ci_low, 6) + 0e0 AS ci_low, round(ci_high, 6) + 0e0 AS ci_high, round(prob_a_better, 6) AS prob_a_better FROM (
WITH pair AS (SELECT study, period, max(CASE WHEN strategy = 'equal' THEN ret END) AS ra, max(CASE WHEN strategy = 'current' THEN ret END) AS rb,
                     count(*) OVER (PARTITION BY study) AS n FROM fixed_rets WHERE strategy <> 'benchmark' GROUP BY 1, 2),
 sizes AS (SELECT DISTINCT study, n FROM pair),
 starts AS (SELECT study, n, s.sample, k.blk, ('0x' || substr(md5(concat_ws(',', 12345, study, s.sample, k.blk)), 1, 8))::BIGINT % n AS start
            FROM sizes, range(2000) s(sample), range(400) k(blk) WHERE k.blk < ceil(n / 6e0)),
 diffs AS (SELECT s.study, s.sample,
    CASE WHEN stddev_pop(ra) < 1e-12 THEN 0 ELSE avg(ra) / stddev_pop(ra) * sqrt(12e0) END - CASE WHEN stddev_pop(rb) < 1e-12 THEN 0 ELSE avg(rb) / stddev_pop(rb) * sqrt(12e0) END AS diff
    FROM starts s, range(6) o(step) JOIN pair p ON p.study = s.study AND p.period = (s.start + o.step) % s.n WHERE s.blk * 6 + o.step < s.n GROUP BY 1, 2)
SELECT study, any_value(samples) AS samples, any_value(lo) AS ci_low, any_value(hi) AS ci_high, any_value(pb) AS prob_a_better,
   CASE WHEN stddev_pop(ra) < 1e-12 THEN 0 ELSE avg(ra) / stddev_pop(ra) * sqrt(12e0) END - CASE WHEN stddev_pop(rb) < 1e-12 THEN 0 ELSE avg(rb) / stddev_pop(rb) * sqrt(12e0) END AS point_estimate
FROM pair JOIN (SELECT study, count(*) AS samples, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi, avg(CASE WHEN diff > 0 THEN 1e0 ELSE 0e0 END) AS pb FROM diffs GROUP BY 1) USING (study)
GROUP BY study)"""


@query("ST4_block_bootstrap", BOOTSTRAP_SQL, ("fixed_rets",))
def st4(spark, sf):
    t = rs.block_bootstrap_sharpe(reuse(fixed(spark, sf)), "equal", "current", block=6, samples=2000, periods_per_year=12.0)
    return t.select("study", "samples", rnd("point_estimate"), rnd("ci_low"), rnd("ci_high"), rnd("prob_a_better"))


@query("ST11_robustness_study", f"""
SELECT study, windows, wins_a, samples, point_estimate, ci_low, ci_high, prob_a_better FROM (
  SELECT study, count(*) AS windows, count(*) FILTER (WHERE a.sharpe > c.sharpe) AS wins_a FROM roll a JOIN roll c USING (study, window_number)
  WHERE a.strategy = 'equal' AND c.strategy = 'current' GROUP BY 1) JOIN ({BOOTSTRAP_SQL}) USING (study)""", ("roll", "fixed_rets"))
def st11(spark, sf):
    rolling, bootstrap = study.robustness_study(returns(spark, sf), b.brand_spend(spark, sf), 12, 3, 6, 2000, 12.0)
    return rolling.join(bootstrap, "study").select(
        "study", "windows", "wins_a", "samples", *[rnd(c) for c in ["point_estimate", "ci_low", "ci_high", "prob_a_better"]])
