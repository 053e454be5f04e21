"""Recommendation audit queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast import bridge as b
from holdfast.catalog.core import big, rnd
from holdfast.catalog.registry import query, view
from holdfast.functions import audit as a
from holdfast.grouping import cut_lineage
from holdfast.operators import audit as o


def verdicts(spark, sf):
    return o.run_verdicts(b.runs(spark, sf), b.scenarios(spark, sf))


def joined(col):
    return F.array_join(col, "|")


view("picks_of_run", """
SELECT run_id, upper(ticker) AS ticker, row_number() OVER (PARTITION BY run_id ORDER BY min(slot), ticker) AS pos
FROM legs GROUP BY run_id, ticker""", ("legs",))
view("run_facts", """
SELECT r.run_id, 'segment_' || c_mktsegment AS fact, r.scenario FROM runs r JOIN customer ON c_custkey = r.o_custkey WHERE status IN ('O', 'F')
UNION ALL SELECT run_id, 'status_' || status, scenario FROM runs, range(2) WHERE status = 'F'""", ("runs",))
view("run_amounts", """
SELECT r.run_id, r.scenario, r.has_amounts, l.n_raw, l.n_dist, l.used, l.fees, s.cash, s.amounts_required, s.min_order_amount,
       s.min_cash_deployment_fraction AS fraction, CASE WHEN l.used <= 0 THEN 0 ELSE ceil(l.used / 1000) * 2.5 END AS one_fee
FROM runs r JOIN scenarios s ON s.scenario = r.scenario
JOIN (SELECT run_id, count(*) AS n_raw, count(DISTINCT ticker) AS n_dist, sum(amount) AS used,
             sum(CASE WHEN amount <= 0 THEN 0 ELSE ceil(amount / 1000) * 2.5 END) AS fees FROM legs GROUP BY 1) l ON l.run_id = r.run_id""", ("runs", "scenarios", "legs"))
# ``place`` orders the codes of a run: by rule, then pick by pick, then in the order of the tests.
view("violations", """
SELECT run_id, 'too_many_recommendations' AS violation, 0 AS place FROM picks_of_run GROUP BY run_id HAVING count(*) > 3
UNION ALL
SELECT p.run_id, CASE x.kind WHEN 1 THEN 'ticker_not_allowed:' WHEN 2 THEN 'already_owned:' WHEN 3 THEN 'restricted_ticker:' ELSE 'concentration_breach:' END || p.ticker, 10000 + p.pos * 10 + x.kind
FROM picks_of_run p JOIN runs r ON r.run_id = p.run_id JOIN scenarios s ON s.scenario = r.scenario
JOIN brand_ranks k ON k.o_custkey = r.o_custkey AND upper(k.ticker) = p.ticker
JOIN (SELECT unnest([1, 2, 3, 4]) AS kind) x
  ON (x.kind = 1 AND k.r > 10) OR (x.kind = 2 AND k.r IN (4, 5) AND s.add_only) OR (x.kind = 3 AND k.r = 9) OR (x.kind = 4 AND k.r = 10)
UNION ALL SELECT run_id, 'amounts_required', 20000 FROM run_amounts WHERE NOT has_amounts AND amounts_required
UNION ALL SELECT run_id, 'amount_count_mismatch', 20000 FROM run_amounts WHERE has_amounts AND n_raw <> n_dist
UNION ALL SELECT run_id, 'cash_exceeded', 20000 FROM run_amounts WHERE has_amounts AND n_raw = n_dist AND used > cash + 0.01
UNION ALL SELECT run_id, 'cash_underdeployed', 20001 FROM run_amounts WHERE has_amounts AND n_raw = n_dist AND fraction IS NOT NULL
  AND cash >= min_order_amount AND used + 0.01 < cash * fraction
UNION ALL SELECT l.run_id, CASE WHEN l.amount <= 0 THEN 'non_positive_order:' ELSE 'below_min_order:' END || upper(l.ticker), 20002 + p.pos
  FROM legs l JOIN run_amounts m USING (run_id) JOIN picks_of_run p ON p.run_id = l.run_id AND p.ticker = upper(l.ticker)
  WHERE m.has_amounts AND n_raw = n_dist AND l.amount < min_order_amount
UNION ALL SELECT run_id, 'unnecessary_split_fee', 29999 FROM run_amounts WHERE has_amounts AND n_raw = n_dist AND fees > one_fee
UNION ALL SELECT f.run_id, 'unsupported_fact:' || f.fact, 30000 + CASE WHEN f.fact LIKE 'status%' THEN 1 ELSE 0 END FROM run_facts f JOIN scenarios s USING (scenario) WHERE f.fact NOT IN (s.fact_a, s.fact_b)""",
     ("picks_of_run", "runs", "scenarios", "brand_ranks", "run_amounts", "legs", "run_facts"))
view("agreement", """
SELECT r.run_id, r.scenario, s.policy_size AS k, count(*) FILTER (WHERE p.pos <= s.policy_size AND k.r <= s.policy_size) AS overlap,
       count(*) FILTER (WHERE p.pos <= s.policy_size) AS top_size
FROM runs r JOIN scenarios s USING (scenario) JOIN picks_of_run p USING (run_id)
JOIN brand_ranks k ON k.o_custkey = r.o_custkey AND upper(k.ticker) = p.ticker GROUP BY ALL""", ("runs", "scenarios", "picks_of_run", "brand_ranks"))
view("verdicts", """
SELECT r.scenario, r.advisor, r.arm, r.run_id, coalesce(v.n, 0) = 0 AS valid, v.codes, g.overlap, g.overlap / g.k::DOUBLE AS agreement,
       g.overlap / (g.top_size + g.k - g.overlap)::DOUBLE AS policy_jaccard,
       CASE WHEN r.has_amounts THEN m.used END AS cash_used, CASE WHEN r.has_amounts THEN m.fees END AS fee
FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n, string_agg(violation, '|' ORDER BY place) AS codes FROM violations GROUP BY 1) v USING (run_id)
JOIN agreement g USING (run_id) JOIN run_amounts m USING (run_id)""", ("runs", "violations", "agreement", "run_amounts"))


@query("PF4_normalized_tickers", """
SELECT run_id, string_agg(ticker, '|' ORDER BY pos) AS picks FROM picks_of_run JOIN runs USING (run_id) GROUP BY 1""", ("picks_of_run", "runs"))
def pf4(spark, sf):
    return b.runs(spark, sf).select("run_id", F.array_join(F.expr(a.normalize_tickers("tickers")), "|").alias("picks"))


@query("SC37_run_verdicts", "SELECT scenario, run_id, valid, coalesce(codes, '') AS violations FROM verdicts", ("verdicts",))
def sc37(spark, sf):
    return verdicts(spark, sf).select("scenario", "run_id", "valid", joined("violations").alias("violations"))


def _rule(name, rule_names, pattern):
    sql = f"""SELECT r.run_id, coalesce(v.codes, '') AS codes FROM runs r LEFT JOIN (
        SELECT run_id, string_agg(violation, '|' ORDER BY place) AS codes FROM violations
        WHERE regexp_matches(violation, '^({pattern})') GROUP BY 1) v USING (run_id)"""

    def run(spark, sf):
        rules = {k: a.RULES[k] for k in rule_names}
        return o.run_verdicts(b.runs(spark, sf), b.scenarios(spark, sf), rules).select("run_id", joined("violations").alias("codes"))

    query(name, sql, ("runs", "violations"))(run)


_rule("SC34_membership_rules", ["too_many", "tickers"],
      "too_many|ticker_not|already|restricted|concentration")
_rule("SC35_amount_rules", ["amounts"], "amount|cash_|non_|below|unnecessary")
_rule("SC36_fact_rules", ["facts"], "unsupported")


@query("SC38_policy_comparison", """
SELECT run_id, overlap::BIGINT AS overlap_at_k, round(agreement, 6) AS agreement_at_k, round(policy_jaccard, 6) AS policy_jaccard FROM verdicts""", ("verdicts",))
def sc38(spark, sf):
    return verdicts(spark, sf).select("run_id", big("overlap_at_k"), rnd("agreement_at_k"), rnd("policy_jaccard"))


@query("SO1_policy_jaccard", "SELECT scenario, round(avg(policy_jaccard), 6) AS mean_jaccard FROM verdicts GROUP BY 1", ("verdicts",))
def so1(spark, sf):
    return verdicts(spark, sf).groupBy("scenario").agg(F.round(F.avg("policy_jaccard"), 6).alias("mean_jaccard"))


@query("SO2_missing_and_extra", """
SELECT r.run_id,
  coalesce((SELECT string_agg(upper(k.ticker), '|' ORDER BY k.r) FROM brand_ranks k WHERE k.o_custkey = r.o_custkey AND k.r <= s.policy_size
     AND upper(k.ticker) NOT IN (SELECT ticker FROM picks_of_run p WHERE p.run_id = r.run_id AND p.pos <= s.policy_size)), '') AS missing_policy,
  coalesce((SELECT string_agg(p.ticker, '|' ORDER BY p.pos) FROM picks_of_run p WHERE p.run_id = r.run_id AND p.pos <= s.policy_size
     AND p.ticker NOT IN (SELECT upper(k.ticker) FROM brand_ranks k WHERE k.o_custkey = r.o_custkey AND k.r <= s.policy_size)), '') AS extra_tickers
FROM runs r JOIN scenarios s USING (scenario)""", ("runs", "scenarios", "picks_of_run", "brand_ranks"))
def so2(spark, sf):
    return verdicts(spark, sf).select("run_id", joined("missing_policy").alias("missing_policy"), joined("extra_tickers").alias("extra_tickers"))


view("run_pairs", """
SELECT a.scenario, a.advisor, a.run_id AS left_run, b.run_id AS right_run FROM runs a JOIN runs b
  ON a.scenario = b.scenario AND a.advisor = b.advisor AND a.run_id < b.run_id""", ("runs",))
view("set_stability", """
SELECT r.scenario, r.advisor, count(*) AS runs, coalesce(any_value(j.m), 1.0)::DOUBLE AS set_stability FROM runs r LEFT JOIN (
  SELECT q.scenario, q.advisor, avg(coalesce(i.n, 0)::DOUBLE / (x.n + y.n - coalesce(i.n, 0))) AS m
  FROM run_pairs q
  JOIN (SELECT run_id, count(*) AS n FROM picks_of_run GROUP BY 1) x ON x.run_id = left_run
  JOIN (SELECT run_id, count(*) AS n FROM picks_of_run GROUP BY 1) y ON y.run_id = right_run
  LEFT JOIN (SELECT left_run, right_run, count(*) AS n FROM run_pairs JOIN picks_of_run a ON a.run_id = left_run
             JOIN picks_of_run b ON b.run_id = right_run AND a.ticker = b.ticker GROUP BY 1, 2) i USING (left_run, right_run)
  GROUP BY 1, 2) j USING (scenario, advisor) GROUP BY 1, 2""", ("runs", "run_pairs", "picks_of_run"))
view("alloc", """
SELECT l.run_id, r.scenario, r.advisor, upper(l.ticker) AS ticker, sum(l.amount / m.used) AS weight
FROM legs l JOIN runs r USING (run_id) JOIN run_amounts m USING (run_id) WHERE r.has_amounts AND m.used > 0 GROUP BY ALL""", ("legs", "runs", "run_amounts"))
view("amount_stability", """
SELECT s.scenario, s.advisor, s.n AS sized_runs, CASE WHEN s.n >= 2 THEN 1 - d.m END AS amount_stability
FROM (SELECT scenario, advisor, count(DISTINCT run_id) AS n FROM alloc GROUP BY 1, 2) s
LEFT JOIN (SELECT scenario, advisor, avg(tv) AS m FROM (
   SELECT q.scenario, q.advisor, left_run, right_run, (SELECT 0.5 * sum(abs(w)) FROM (
       SELECT ticker, sum(CASE WHEN run_id = left_run THEN weight ELSE -weight END) AS w FROM alloc z
       WHERE z.run_id IN (left_run, right_run) GROUP BY ticker)) AS tv
   FROM run_pairs q WHERE left_run IN (SELECT run_id FROM alloc) AND right_run IN (SELECT run_id FROM alloc)) GROUP BY 1, 2) d USING (scenario, advisor)""", ("alloc", "run_pairs"))


@query("SJ6_run_pairs_summary", """
SELECT scenario, advisor, count(*) AS runs, count(*) * (count(*) - 1) // 2 AS pairs FROM runs GROUP BY 1, 2""", ("runs",))
def sj6(spark, sf):
    n = F.count(F.lit(1))
    return b.runs(spark, sf).groupBy("scenario", "advisor").agg(n.alias("runs"), (n * (n - 1) / 2).cast("long").alias("pairs"))


@query("SC41_set_stability", "SELECT scenario, advisor, runs, round(set_stability, 6) AS set_stability FROM set_stability", ("set_stability",))
def sc41(spark, sf):
    return o.set_stability(b.runs(spark, sf)).select("scenario", "advisor", "runs", rnd("set_stability"))


@query("SC39_allocation_weights", "SELECT run_id, ticker, round(weight, 6) AS weight FROM alloc", ("alloc",))
def sc39(spark, sf):
    return o.allocation_weights(b.runs(spark, sf)).select("run_id", "ticker", rnd("weight"))


@query("SC40_amount_stability", "SELECT scenario, advisor, sized_runs, round(amount_stability, 6) + 0e0 AS amount_stability FROM amount_stability", ("amount_stability",))
def sc40(spark, sf):
    return o.amount_stability(b.runs(spark, sf)).select("scenario", "advisor", "sized_runs", rnd("amount_stability"))


view("reports", """
SELECT v.scenario, v.advisor, s.runs, sum(CASE WHEN valid THEN 1 ELSE 0 END)::BIGINT AS valid_runs, avg(overlap) AS mean_overlap, avg(agreement) AS mean_agreement,
       avg(policy_jaccard) AS mean_policy_jaccard, sum(CASE WHEN agreement = 1 AND NOT valid THEN 1 ELSE 0 END)::BIGINT AS agreed_but_invalid_runs,
       avg(cash_used) AS mean_cash_used, avg(fee) AS mean_fee, s.set_stability, t.amount_stability
FROM verdicts v JOIN set_stability s USING (scenario, advisor) LEFT JOIN amount_stability t USING (scenario, advisor)
GROUP BY v.scenario, v.advisor, s.runs, s.set_stability, t.amount_stability""", ("verdicts", "set_stability", "amount_stability"))
REPORT = ["mean_overlap", "mean_agreement", "mean_policy_jaccard", "mean_cash_used", "mean_fee", "set_stability", "amount_stability", "valid_rate"]


def reports(spark, sf):
    # Runs and scenarios read one table of orders with their legs: the lines are joined and grouped once.
    legs = cut_lineage(b.order_legs(spark, sf))
    runs = b.runs(spark, sf, legs)
    return o.run_set_reports(o.run_verdicts(runs, b.scenarios(spark, sf, legs)), runs)


@query("AG10_run_set_reports", "SELECT scenario, advisor, runs, valid_runs, agreed_but_invalid_runs, " + ", ".join(
    f"round({c}, {7 if c in ('mean_cash_used', 'mean_fee') else 6}) + 0e0 AS {c}" for c in REPORT) + " FROM (SELECT *, valid_runs / runs::DOUBLE AS valid_rate FROM reports)", ("reports",))
def ag10(spark, sf):
    return reports(spark, sf).select("scenario", "advisor", "runs", "valid_runs", "agreed_but_invalid_runs",
                                     *[rnd(c, 7 if c in ("mean_cash_used", "mean_fee") else 6) for c in REPORT])


@query("AG11_violation_counts", "SELECT scenario, advisor, violation, count(*) AS n FROM violations JOIN runs USING (run_id) GROUP BY ALL", ("violations", "runs"))
def ag11(spark, sf):
    return o.violation_counts(verdicts(spark, sf))


view("classes", """
SELECT *, split_part(violation, ':', 1) AS prefix, CASE split_part(violation, ':', 1) WHEN 'ticker_not_allowed' THEN 'out_of_universe' WHEN 'already_owned' THEN 'already_owned_violation'
  WHEN 'amounts_required' THEN 'malformed_amounts' WHEN 'amount_count_mismatch' THEN 'malformed_amounts' WHEN 'cash_exceeded' THEN 'cash_overrun'
  WHEN 'cash_underdeployed' THEN 'cash_underdeployment' WHEN 'below_min_order' THEN 'below_floor_order' WHEN 'unnecessary_split_fee' THEN 'fee_worsening_split'
  WHEN 'unsupported_fact' THEN 'ungrounded_fact' WHEN 'too_many_recommendations' THEN 'too_many_recommendations' WHEN 'concentration_breach' THEN 'concentration_breach'
  WHEN 'non_positive_order' THEN 'non_positive_order' ELSE violation END AS failure_class FROM violations""", ("violations",))


@query("AG12_prefix_totals", "SELECT prefix, failure_class, count(*) AS n FROM classes GROUP BY 1, 2", ("classes",))
def ag12(spark, sf):
    return o.prefix_totals(o.violation_counts(verdicts(spark, sf)))


@query("SC42_failure_class", "SELECT violation, failure_class, count(*) AS n FROM classes GROUP BY 1, 2", ("classes",))
def sc42(spark, sf):
    rows = o.violation_rows(verdicts(spark, sf)).select("violation", F.expr(a.violation_class("violation")).alias("failure_class"))
    return rows.groupBy("violation", "failure_class").agg(F.count(F.lit(1)).alias("n"))


@query("AG13_advisor_aggregates", """
SELECT advisor, count(*) AS scenarios, sum(runs)::BIGINT AS runs, round(sum(valid_runs) / sum(runs), 6) AS validity_rate,
       round(avg(mean_agreement), 6) AS mean_agreement, round(avg(set_stability), 6) AS mean_set_stability,
       round(avg(amount_stability), 6) AS mean_amount_stability, round(sum(agreed_but_invalid_runs) / sum(runs), 6) AS false_positive_rate
FROM reports GROUP BY 1""", ("reports",))
def ag13(spark, sf):
    t = o.advisor_aggregates(reports(spark, sf))
    return t.select("advisor", "scenarios", "runs", *[rnd(c) for c in ["validity_rate", "mean_agreement", "mean_set_stability", "mean_amount_stability", "false_positive_rate"]])


@query("AG14_macro_summary", """
SELECT advisor, count(*) AS run_sets, round(avg(valid_runs / runs::DOUBLE), 6) AS mean_valid_rate, round(avg(mean_agreement), 6) AS mean_agreement,
       round(avg(set_stability), 6) AS mean_stability, round(avg(amount_stability), 6) AS mean_amount_stability
FROM reports GROUP BY ROLLUP (advisor)""", ("reports",))
def ag14(spark, sf):
    t = o.macro_summary(reports(spark, sf))
    return t.select("advisor", "run_sets", *[rnd(c) for c in ["mean_valid_rate", "mean_agreement", "mean_stability", "mean_amount_stability"]])


@query("AG15_arm_validity", """
SELECT advisor, arm, sum(CASE WHEN valid THEN 1 ELSE 0 END)::BIGINT AS valid, count(*) AS runs, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS rate,
       CASE arm WHEN 'bare' THEN 0 WHEN 'policy' THEN 1 WHEN 'scaffold' THEN 2 ELSE 9 END::BIGINT AS arm_order
FROM verdicts GROUP BY CUBE (advisor, arm)""", ("verdicts",))
def ag15(spark, sf):
    t = o.arm_validity(verdicts(spark, sf))
    return t.select("advisor", "arm", "valid", "runs", rnd("rate"), F.coalesce(o.arm_rank(F.col("arm")), F.lit(9)).cast("long").alias("arm_order"))


@query("PF19_rate_band", """
SELECT scenario, CASE WHEN r >= 0.9 THEN 'ok' WHEN r >= 0.7 THEN 'warn' ELSE 'bad' END AS band
FROM (SELECT scenario, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS r FROM verdicts GROUP BY 1)""", ("verdicts",))
def pf19(spark, sf):
    t = verdicts(spark, sf).groupBy("scenario").agg(F.avg(F.col("valid").cast("double")).alias("r"))
    return t.select("scenario", o.rate_band(F.col("r")).alias("band"))


@query("AG17_arm_stability", """
SELECT arm, count(*) AS repetitions, round(avg(r), 4) AS mean_rate, min(r) AS min_rate, max(r) AS max_rate, round(stddev_pop(r), 4) AS stdev_rate
FROM (SELECT arm, run_index, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 4) AS r
  FROM (SELECT *, row_number() OVER (PARTITION BY scenario, arm ORDER BY run_id) AS run_index FROM verdicts) GROUP BY 1, 2) GROUP BY 1""", ("verdicts",))
def ag17(spark, sf):
    nth = F.row_number().over(Window.partitionBy("scenario", "arm").orderBy("run_id"))
    rows = verdicts(spark, sf).select("scenario", "arm", "run_id", "valid").withColumn("run_index", nth)
    rates = rows.groupBy("arm", "run_index").agg(F.round(F.avg(F.col("valid").cast("double")), 4).alias("valid_rate"))
    return o.arm_stability(rates)


@query("AG18_category_counts", "SELECT category, count(*) AS n FROM scenarios GROUP BY 1", ("scenarios",))
def ag18(spark, sf):
    return b.scenarios(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("AG21_distinct_tickers", """
SELECT scenario, advisor, string_agg(DISTINCT ticker, '|' ORDER BY ticker) AS unique_tickers FROM runs JOIN picks_of_run USING (run_id) GROUP BY 1, 2""", ("runs", "picks_of_run"))
def ag21(spark, sf):
    return o.distinct_picks(b.runs(spark, sf)).select("scenario", "advisor", F.array_join("unique_tickers", "|").alias("unique_tickers"))


@query("ST5_clustered_bootstrap", None)
def st5(spark, sf):
    from holdfast.operators.resampling import clustered_validity_interval
    per_scenario = verdicts(spark, sf).groupBy("arm", "scenario").agg(
        F.sum(F.col("valid").cast("long")).alias("valid"), F.count(F.lit(1)).alias("runs"))
    return clustered_validity_interval(per_scenario, "arm", "scenario")


@query("UD3_extra_rule", """
SELECT scenario, run_id, coalesce(codes, '') || CASE WHEN n > 5 THEN CASE WHEN codes IS NULL THEN '' ELSE '|' END || 'zz_wide_basket' ELSE '' END AS violations
FROM verdicts JOIN (SELECT run_id, count(*) AS n FROM picks_of_run GROUP BY 1) USING (run_id)""", ("verdicts", "picks_of_run"))
def ud3(spark, sf):
    rules = {**a.RULES, "wide_basket": lambda: a.flag("size(picks) > 5", "zz_wide_basket")}
    return o.run_verdicts(b.runs(spark, sf), b.scenarios(spark, sf), rules).select("scenario", "run_id", joined("violations").alias("violations"))
