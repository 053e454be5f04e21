import pathlib

import duckdb
import pytest

from holdfast import bridge, catalog
from holdfast.operators import audit as au
from holdfast.streaming import jobs

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan_and_rows(spark, name, sf=SF):
    """A query's plan, its rows and those of its SQL."""
    df = catalog.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for table in ("customer", "orders", "lineitem", "part", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cur = con.execute(catalog.ORACLES[name])
    wanted = sorted(cur.fetchall(), key=repr)
    return plan_of(df), sorted(map(tuple, df.select(*[d[0] for d in cur.description]).collect()), key=repr), wanted


def test_f6_lines_are_dealt_by_order_once_and_runs_are_not_dealt_by_customer(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(bridge.order_legs(spark, SF))
        # Lines and parts by part, lines by order, orders and customers by customer, orders by order.
        assert plan.count("Exchange ") == 6
        kept = bridge.order_legs(spark, SF).localCheckpoint()
        for made in (bridge.runs(spark, SF, kept), bridge.scenarios(spark, SF, kept)):
            assert "lineitem" not in plan_of(made) and "part.parquet" not in plan_of(made)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for make in (bridge.runs, bridge.scenarios):
        assert sorted(make(spark, SF, kept).collect()) == sorted(make(spark, SF).collect())
    _, got, wanted = plan_and_rows(spark, "IO18_audit_summary")
    assert got == wanted


def test_f8_weights_of_a_run_are_made_inside_its_row(spark):
    rows = [("s", "a", 1, ["x", " X", "y", None], [1.0, 2.0, 4.0, 1.0]), ("s", "a", 2, ["y", "z"], [3.0, 1.0]), ("s", "a", 3, ["y"], [5.0]),
            ("s", "a", 4, ["y"], [0.0]), ("s", "a", 5, [], [])]
    runs = spark.createDataFrame(rows, "scenario string, advisor string, run_id long, tickers array<string>, amounts array<double>")
    weights = au.allocation_weights(runs)
    assert "Exchange" not in plan_of(weights)
    got = {(r.run_id, r.ticker): r.weight for r in weights.collect()}
    assert got == {(1, "X"): 0.375, (1, "Y"): 0.5, (1, None): 0.125, (2, "Y"): 0.75, (2, "Z"): 0.25, (3, "Y"): 1.0}


def test_f8_ranges_of_weights_leave_their_tasks_as_sums(spark):
    rows = [("s", "a", i, ["x", "y"], [float(1 + i * 7 % 40), float(1 + i % 5)]) for i in range(120)] + [("s", "b", 0, ["x"], [2.0])]
    runs = spark.createDataFrame(rows, "scenario string, advisor string, run_id long, tickers array<string>, amounts array<double>")
    made = au.amount_stability(runs)
    assert "Join" not in plan_of(made)
    shares = [{t: x / sum(a) for t, x in zip(n, a)} for _, advisor, _, n, a in rows if advisor == "a"]
    far = [sum(abs(p.get(t, 0) - q.get(t, 0)) for t in "xy") / 2 for i, p in enumerate(shares) for q in shares[:i]]
    got = {r.advisor: (r.sized_runs, r.amount_stability) for r in made.collect()}
    assert got == {"a": (120, pytest.approx(1 - sum(far) / len(far))), "b": (1, None)}


def test_f8_macro_summary_reads_the_lines_once(spark):
    plan, got, wanted = plan_and_rows(spark, "AG14_macro_summary")
    assert "lineitem" not in plan and got == wanted


def test_f7_a_stream_of_records_derives_scenarios_once_and_keeps_seen_keys_on_disk(spark, monkeypatch):
    run, seen = jobs.drain, []

    def spy(rows, mode, write, checkpoint):
        seen.append((rows.columns, rows._jdf.queryExecution().analyzed().toString()))
        run(rows, mode, write, checkpoint)
        seen.append(pathlib.Path(checkpoint.removeprefix("file:"), "offsets", "0").read_text())

    monkeypatch.setattr(jobs, "drain", spy)
    _, got, wanted = plan_and_rows(spark, "SS3_record_audit_stream")
    (columns, plan), offsets = seen
    assert columns == ["arm", "valid", "parse_error"] and "Aggregate" not in plan
    assert "RocksDBStateStoreProvider" in offsets and got == wanted
