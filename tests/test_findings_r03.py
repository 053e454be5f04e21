import itertools
import re

import duckdb
import pandas as pd
import pytest

from holdfast import bridge, catalog
from holdfast.functions import money
from holdfast.functions import text as t
from holdfast.operators import audit as au
from holdfast.operators import review as rv
from holdfast.operators import valuation as v
from holdfast.sources import documents
from holdfast.streaming import stateful as st


class Cell:
    """A state variable that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "exists":
                return bool(self.held)
            if name == "get":
                return self.held if self.many else self.held[0]
            self.held = [] if name == "clear" else self.held + [args[0]] if name == "appendValue" else [args[0]]

        return call


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def _cell(self, many):
        cell = Cell(self.calls)
        cell.many = many
        return cell

    def getValueState(self, *_):
        return self._cell(False)

    def getListState(self, *_):
        return self._cell(True)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def getCurrentWatermarkInMs(self):
        return 10**6


def test_f1_a_group_of_portfolios_settles_in_a_few_state_calls():
    handle, ledger = Handle(), st.CashLedger(True)
    ledger.init(handle)
    owners = [1, 2, 3] * 200
    ledger.handleInitialState((0,), pd.DataFrame({"portfolio_id": [1, 2], "cash": [1e6, 50.0]}), Clock())
    rows = pd.DataFrame(
        {"portfolio_id": owners, "micros": range(600), "trade_ref": [f"t{i}" for i in range(600)], "ticker": ["A", "B"] * 300,
         "transaction_type": "BUY", "shares": 1.0, "price_per_share": 10.0, "fees": 2.5}
    )
    list(ledger.handleInputRows((0,), iter([rows]), Clock()))
    out = pd.concat(ledger.handleExpiredTimer((0,), Clock(), None))
    assert len(out) == 600 and len(handle.calls) < 20 and handle.timers == [1]
    assert out.groupby("portfolio_id").accepted.sum().to_dict() == {1: 200, 2: 4, 3: 0}


def one(spark, expr):
    return spark.range(1).selectExpr(f"{expr} AS v").head().v


@pytest.mark.parametrize("x", [0.0, -0.0, -0.001, 0.285, 0.125, 0.375, 9.995, 999.995, -1234567.125, 1e17, float("inf"), float("nan")])
def test_f2_amounts_are_shown_by_their_exact_value(spark, x):
    shown = spark.createDataFrame([(x,)], "x double").selectExpr(f"{money.display('x', repr('USD'))} AS v").head().v
    assert shown == f"$ {x:,.2f}"


def test_f11_amounts_in_prompts_are_exact(spark):
    assert one(spark, t.usd("0.285D")) == "0.28" and one(spark, t.usd("0.125D")) == "0.12" and one(spark, t.usd("double(NULL)")) is None
    assert one(spark, money.half_away("2377.595D", 2)) == 2377.59 and one(spark, money.half_away("-0.5D", 0)) == -1.0


def test_f13_cost_of_a_token_is_exact(spark):
    assert one(spark, t.usd_label("(1536 / 4096D / 100)")) == "$0.0037"


def test_f14_token_assignments_are_found(spark):
    docs = spark.createDataFrame([(1, 'first\nthe token = "0af3" here')], "doc_id long, text string")
    assert [tuple(r) for r in t.scan_documents(docs).collect()] == [(1, "token assignment", 2, 'token = "0af3"')]


def test_f5_positions_equal_as_decimals_are_ordered_by_their_doubles(spark):
    assert 3.0 * 0.1 > 1.0 * 0.3
    held = spark.createDataFrame([(1, "A", 1.0, 0.3, 0.1), (1, "B", 3.0, 0.1, 0.1)], "portfolio_id long, ticker string, shares double, price double, cost double")
    r = v.concentration(v.with_weights(v.value_positions(held))).head()
    assert (r.largest, r.smallest) == ("B", "A")


def test_f15_rankings_under_weights_take_one_narrow_shuffle(spark):
    rows = [(p, f"T{t}", float(t % 3), float(t), float(7 - t)) for p in (1, 2) for t in range(6)]
    held = spark.createDataFrame(rows, "portfolio_id long, ticker string, moat_points double, compounding_points double, valuation_points double")
    for study in (rv.rank_under_weights, rv.weight_ablation, rv.weight_sensitivity):
        plan = study(held)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, study
    got = {r.ticker: r.place for r in rv.rank_under_weights(held).filter("portfolio_id = 1 AND label = 'moat_only'").collect()}
    assert got == {"T2": 1, "T5": 2, "T1": 3, "T4": 4, "T0": 5, "T3": 6}
    lost = {r.label: (r.spearman, r.churn) for r in rv.weight_ablation(held).filter("portfolio_id = 2").collect()}
    assert lost["baseline_40_35_25"] == (1.0, 0)
    tops = rv.weight_sensitivity(held).collect()
    assert len(tops) == 2 * len(rv.perturbed_sets()) and all(len(r.top.split("|")) == 2 for r in tops)


def test_f20_path_parts_of_records_come_from_the_end_of_the_path(spark, tmp_path):
    deep = tmp_path / "a__run1.json" / "b" / "c"
    for name in ("p1/m1/bare/s__x__run2.json", "provider=p1/model=m1/arm=bare/file=s__x__run2.json/part-0.txt"):
        path = deep / name
        path.parent.mkdir(parents=True)
        path.write_text('{"provider": "p1"}\n')
    read = documents.read_run_records(spark, str(deep), lines=True)
    assert "regexp_extract(_metadata" not in read._jdf.queryExecution().analyzed().toString()
    got = read.select("provider", "path_provider", "path_model", "path_arm", "path_scenario", "path_run").collect()
    assert [tuple(r) for r in got] == [("p1", "p1", "m1", "bare", "s__x", 2)] * 2


def test_f23_worst_premium_is_grouped_after_the_rows_are_dealt(spark):
    plan = catalog.QUERIES["TK6_worst_premium"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("Exchange ") and "Generate " not in plan


def test_f28_sets_of_picks_are_made_once_for_set_stability(spark):
    rows = [(f"s{s}", "a", r, [f"T{(r * s + k) % 7}" for k in range(1 + r % 3)]) for s in range(9) for r in range(s + 1)]
    runs = spark.createDataFrame(rows, "scenario string, advisor string, run_id long, tickers array<string>")
    result = au.set_stability(runs, block=4)
    assert "InMemoryTableScan" in result._jdf.queryExecution().executedPlan().toString()
    got = {r.scenario: r.set_stability for r in result.collect()}
    for s in range(9):
        picks = [set(t) for name, _, _, t in rows if name == f"s{s}"]
        pairs = [len(x & y) / len(x | y) for i, x in enumerate(picks) for y in picks[:i]]
        assert got[f"s{s}"] == pytest.approx(sum(pairs) / len(pairs) if pairs else 1.0)


def test_f22_scored_rows_are_not_shuffled_by_portfolio_when_values_are_known(spark):
    held = spark.createDataFrame(
        [(1, "A", "a", "t", False, 2.0, 3.0, 4.0), (1, "B", "b", "t", False, 1.0, 1.0, 8.0)],
        "portfolio_id long, ticker string, name string, theme string, is_financial boolean, shares double, cost double, price double")
    scores = ("roic", "roe", "margin_cv", "revenue_cagr", "eps_cagr", "fcf_cagr", "shares_change", "fcf_yield", "forward_pe", "peg", "moat_points",
              "compounding_points", "valuation_points", "composite_score")
    scored = spark.createDataFrame([("A", 6.0), ("B", 4.0)], "ticker string, live_price double").selectExpr(
        "*", *[f"1D AS {c}" for c in scores], "'x' AS moat_class", "'y' AS compounding_class")
    values = v.portfolio_values(held, scored)
    assert [tuple(r) for r in values.collect()] == [(1, 16.0, 2)]
    known = held.join(values.localCheckpoint(), "portfolio_id").localCheckpoint()
    got = v.analyze_holdings(known, scored)
    assert "hashpartitioning(portfolio_id" not in got._jdf.queryExecution().executedPlan().toString()
    want = v.analyze_holdings(held, scored)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    assert {r.ticker: r.weight_pct for r in got.collect()} == {"A": 75.0, "B": 25.0}


def test_f7_series_are_rounded_in_doubles_as_the_sql_does(spark, tmp_path):
    file = str(tmp_path / "lineitem.parquet")
    lines = [(277, 93317.25, 0.03, 0.01, 23.0), (629, 65806.26, 0.0, 0.06, 48.0), (6914, 91338.3, 0.1, 0.07, 41.0), (17883, 37057.7, 0.0, 0.05, 21.0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT l.* REPLACE (t.a::BIGINT AS l_partkey, t.b AS l_extendedprice, t.c AS l_discount, t.d AS l_tax, t.e AS l_quantity) "
                f"FROM (VALUES {', '.join(f'({a * 3}, {b}e0, {c}e0, {d}e0, {e}e0)' for a, b, c, d, e in lines)}) t(a, b, c, d, e), "
                "(FROM '/root/testdata/sf0.001/lineitem.parquet' LIMIT 1) l")
    con.execute(f"COPY lineitem TO '{file}' (FORMAT parquet)")
    assert spark.read.parquet(file).schema.simpleString() == spark.read.schema(bridge.SCHEMAS["lineitem"]).parquet(file).schema.simpleString()
    got = catalog.QUERIES["IO12_metric_matrix"](spark, str(tmp_path)).select("ticker", "series").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.ORACLES["IO12_metric_matrix"]).fetchall())


def plan_and_rows(spark, name, sf="/root/testdata/sf0.001"):
    """A query's plan, its rows and those of its SQL."""
    df = catalog.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for table in ("customer", "orders", "lineitem", "part", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cur = con.execute(catalog.ORACLES[name])
    wanted = sorted(cur.fetchall())
    return df._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, df.select(*[d[0] for d in cur.description]).collect())), wanted


def test_f24_candidates_are_listed_without_prices_or_weights(spark):
    rows = [(1, "A", "x", 60.0), (1, "Z", "y", 40.0), (2, "Z", "y", 100.0)]
    held = spark.createDataFrame(rows, "portfolio_id long, ticker string, theme string, weight_pct double")
    items = [("A", "a", "x", 90.0, 1.0), ("B", "b", "y", 80.0, 1.0), ("C", "c", "x", 70.0, 1.0)]
    listing = spark.createDataFrame(items, "ticker string, name string, theme string, composite_score double, valuation_points double")
    alone, weighed = rv.screen(held.select("portfolio_id", "ticker"), listing, 2), rv.screen(held, listing, 2)
    assert alone.columns == ["portfolio_id", "positions", "screened"]
    assert sorted(alone.collect()) == sorted(weighed.select(alone.columns).collect())
    assert {r.portfolio_id: [x.ticker for x in r.screened] for r in alone.collect()} == {1: ["B", "C"], 2: ["A", "B"]}
    plan, got, wanted = plan_and_rows(spark, "TK2_screening_rank")
    assert "weight_pct" not in plan and got == wanted


def test_f31_holdings_and_candidates_share_unpriced_holdings(spark):
    plan, got, wanted = plan_and_rows(spark, "SO6_holdings_and_candidates")
    assert "total_value" not in plan and "InMemoryTableScan" in plan
    key = lambda r: (r[0], r[1], float(r[2]), r[4])
    assert sorted(map(key, got)) == sorted(map(key, wanted))


def test_f33_exclusions_read_analyses_that_are_made_once(spark):
    plan, got, wanted = plan_and_rows(spark, "SC24_excluded")
    assert "InMemoryTableScan" in plan and "pnl_pct" not in plan and got == wanted


def test_f21_the_review_keeps_narrow_holdings_and_makes_scores_once(spark):
    plan, got, wanted = plan_and_rows(spark, "SC31_portfolio_review")
    kept = [re.sub(r"#\d+L?", "", columns).split(", ") for columns in re.findall(r"InMemoryRelation \[(.*?)\]", plan)]
    narrow = ["portfolio_id", "ticker", "theme", "weight_pct", "position_count", "composite_score", "valuation_points"]
    assert narrow in kept and any(c[0] == "ticker" for c in kept) and got == wanted


def audited_run(folder, totals, lines):
    """Tables of one customer: orders worth ``totals``, the last of them a run with ``lines`` (slot, price), each of its own brand."""
    tables = {
        "nation": "SELECT 1::INTEGER AS n_nationkey, 'N' AS n_name, 0::INTEGER AS n_regionkey",
        "customer": "SELECT 1::BIGINT AS c_custkey, 'c' AS c_name, 1::INTEGER AS c_nationkey, 0e0 AS c_acctbal, 'BUILDING' AS c_mktsegment",
        "part": "SELECT i::BIGINT AS p_partkey, 'Brand#' || i AS p_brand FROM range(10) t(i)",
        "orders": "SELECT k::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 'O' AS o_orderstatus, v::DOUBLE AS o_totalprice, '1-URGENT' AS o_orderpriority "
                  f"FROM (VALUES {', '.join(f'({k}, {v})' for k, v in enumerate(totals, 1))}) t(k, v)",
        "lineitem": f"SELECT {len(totals)}::BIGINT AS l_orderkey, s::BIGINT AS l_partkey, s::INTEGER AS l_linenumber, v::DOUBLE AS l_extendedprice "
                    f"FROM (VALUES {', '.join(map(str, lines))}) t(s, v)",
    }
    folder.mkdir()
    for name, sql in tables.items():
        duckdb.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_f8_amount_rules_use_the_mean_cash_of_the_sql(spark, tmp_path):
    # The mean is the double below 5005.025: cash is 5005.02, so 5005.04 is more than a cent above it.
    _, got, wanted = plan_and_rows(spark, "SC35_amount_rules", audited_run(tmp_path / "t", [500502.5, 500502.5], [(1, 500504.0)]))
    assert got == wanted == [(2, "cash_exceeded")]


def test_f8_codes_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    # In doubles these amounts add up to 2000 or to a little more, which starts a third tranche.
    assert {a + b + c for a, b, c in itertools.permutations((361.95, 836.85, 801.2))} == {2000.0, 2000.0000000000002}
    for n, lines in enumerate(itertools.permutations([(1, 36195.0), (2, 83685.0), (3, 80120.0)])):
        folder = audited_run(tmp_path / str(n), [300000.0], lines)
        assert [tuple(r) for r in catalog.QUERIES["SC35_amount_rules"](spark, folder).collect()] == [(1, "unnecessary_split_fee")]


def test_f4_violations_are_counted_with_the_mean_cash_of_the_sql(spark, tmp_path):
    _, got, wanted = plan_and_rows(spark, "AG11_violation_counts", audited_run(tmp_path / "t", [500502.5, 500502.5], [(1, 500504.0)]))
    assert got == wanted and ("scn_1", "advisor_fast", "cash_exceeded", 1) in got
