import datetime as dt
import random

import pytest

from holdfast.operators import ledger
from holdfast.streaming import jobs

TRADES = "portfolio_id long, trade_ref string, ticker string, transaction_type string, shares double, price_per_share double, fees double, executed_at timestamp, total_amount double"


def trades(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        shares, price = float(rng.randint(1, 20)), float(rng.randint(5, 50))
        rows.append((1 if i % 3 else rng.randint(2, 4), f"t{i:04d}", rng.choice("ABC"), rng.choice(["BUY", "SELL"]), shares, price, 2.5,
                     dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), shares * price))
    return rows


def walk(rows, fees_in_cost):
    book = {}
    for p, _, t, side, shares, price, fees, *_ in rows:
        held, cost, ok, bad = book.get((p, t), (0.0, 0.0, 0, 0))
        if side == "BUY":
            total = held * cost + shares * price + (fees if fees_in_cost else 0)
            held, cost, ok = held + shares, total / (held + shares), ok + 1
        elif shares <= held and not (fees_in_cost and fees > shares * price):
            held, ok = held - shares, ok + 1
            cost = cost if held else 0.0
        else:
            bad += 1
        book[p, t] = (held, cost, ok, bad)
    return book


@pytest.mark.parametrize("fees_in_cost", [False, True])
def test_batch_ledger(spark, fees_in_cost):
    rows = trades(1, 400)
    got = ledger.positions_from_trades(spark.createDataFrame(rows, TRADES), fees_in_cost).collect()
    expected = walk(rows, fees_in_cost)
    assert len(got) == len(expected)
    for r in got:
        assert (r.shares, r.average_cost, r.accepted, r.rejected) == pytest.approx(expected[r.portfolio_id, r.ticker])


def test_cash_is_checked_per_portfolio(spark):
    when = dt.datetime(2024, 1, 1)
    rows = [(1, "a", "X", "BUY", 10.0, 10.0, 1.0, when, 100.0), (1, "b", "Y", "BUY", 1.0, 10.0, 0.0, when + dt.timedelta(1), 10.0),
            (1, "c", "X", "SELL", 5.0, 20.0, 2.0, when + dt.timedelta(2), 100.0), (1, "d", "Y", "BUY", 1.0, 10.0, 0.0, when + dt.timedelta(3), 10.0),
            (1, "e", "X", "SELL", 9.0, 20.0, 0.0, when + dt.timedelta(4), 180.0)]
    opening = spark.createDataFrame([(1, 105.0)], "portfolio_id long, cash double")
    got = {r.trade_ref: (r.accepted, r.cash_after) for r in ledger.cash_checked_trades(spark.createDataFrame(rows, TRADES), opening).collect()}
    assert got == {"a": (True, 4.0), "b": (False, 4.0), "c": (True, 102.0), "d": (True, 92.0), "e": (False, 92.0)}


def test_daily_stream_drops_late_rows(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d, 12)
    first = [(1, "a", "X", "BUY", 1.0, 1.0, 2.5, day(1), 10.0), (1, "b", "X", "BUY", 1.0, 1.0, 2.5, day(20), 20.0)]
    late = [(1, "c", "X", "BUY", 1.0, 1.0, 2.5, day(1), 99.0), (1, "d", "X", "BUY", 1.0, 1.0, 2.5, day(28), 5.0)]
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    for batch in (first, late):
        spark.createDataFrame(batch, TRADES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(TRADES).parquet(source)
        late_rows = jobs.run_daily_trades(stream, out, str(tmp_path / "cp"))
    assert late_rows == 1
    got = {r.day.day: r.volume for r in spark.read.parquet(out).collect()}
    assert got == {1: 10.0, 20: 20.0}


def test_a_mark_closes_the_open_days(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d, 12)
    rows = [(1, "a", "X", "BUY", 1.0, 1.0, 2.5, day(1), 10.0), (1, "b", "X", "BUY", 1.0, 1.0, 2.5, day(3), 20.0)]
    source, marks, out = (str(tmp_path / x) for x in ("in", "marks", "out"))
    spark.createDataFrame(rows, TRADES).coalesce(1).write.parquet(source)
    stream = jobs.with_marks(spark.readStream.schema(TRADES).parquet(source), _made(spark, marks))
    assert jobs.run_daily_trades(stream, out, str(tmp_path / "cp")) == 0
    assert spark.read.schema("day timestamp").parquet(out).count() == 0  # both days are still open
    jobs.write_mark(spark, stream.schema, marks, "executed_at", "2024-02-01")
    jobs.run_daily_trades(stream, out, str(tmp_path / "cp"))
    assert {r.day.day: r.volume for r in spark.read.parquet(out).collect()} == {1: 10.0, 3: 20.0}


def _made(spark, folder):
    jobs.write_mark(spark, spark.createDataFrame([], TRADES).schema, folder, "executed_at", None)
    return folder


def test_records_of_another_model_are_no_duplicates(spark, tmp_path):
    schema = "provider string, model string, arm string, scenario string, run_id long, raw_response string, arrived_at timestamp"
    when = dt.datetime(2024, 1, 1)
    rows = [("p", m, "bare", "s", 1, "[]", when) for m in ("one", "two", "two")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    fresh = stream.withWatermark("arrived_at", "1 day").dropDuplicatesWithinWatermark(list(jobs.RECORD_KEYS))
    seen = []
    jobs.drain(fresh, "append", lambda df, i: seen.extend(r.model for r in df.collect()), str(tmp_path / "cp"))
    assert sorted(seen) == ["one", "two"]
