import random

import numpy as np
import pytest

from holdfast.operators import allocators as al
from holdfast.operators import backtest as bt
from holdfast.operators import resampling as rs
from holdfast.operators import returns as r


def make(spark, seed, n=23, names=("A", "B", "C")):
    rng = random.Random(seed)
    data = {t: [rng.uniform(-0.1, 0.12) for _ in range(n)] for t in names}
    rows = [("s", t, i, x) for t, xs in data.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "study string, ticker string, period int, ret double"), data


def weights_df(spark, w, name="w"):
    return spark.createDataFrame([("s", name, t, x) for t, x in w.items()], "study string, strategy string, ticker string, weight double")


def curve(df):
    return [(row.equity, row.cost) for row in df.orderBy("period").collect()]


@pytest.mark.parametrize("n, every", [(23, 0), (23, 1), (23, 5), (20, 5), (7, 9)])
def test_rebalanced_curve_matches_loop(spark, n, every):
    returns, data = make(spark, 1, n)
    w = {"A": 0.5, "B": 0.3, "C": 0.2}
    got = curve(bt.run_backtest(returns, weights_df(spark, {k: v * 4 for k, v in w.items()}), every, 0.02))
    hold = dict(w)
    for period in range(n):
        hold = {t: v * (1 + data[t][period]) for t, v in hold.items()}
        total, cost = sum(hold.values()), 0.0
        if every and (period + 1) % every == 0 and period < n - 1:
            cost = 0.02 * total * sum(abs(hold[t] / total - w[t]) for t in w) / 2
            hold = {t: w[t] * (total - cost) for t in w}
        assert got[period] == pytest.approx((total - cost, cost))


def test_negative_weight_fails(spark):
    returns, _ = make(spark, 1, 5)
    with pytest.raises(Exception, match="non-negative"):
        bt.run_backtest(returns, weights_df(spark, {"A": -1.0, "B": 2.0})).collect()


def test_walk_forward_matches_loop(spark):
    returns, data = make(spark, 2, 17)
    names = sorted(data)
    plan = al.weight_schedule(returns, lookback=8, min_observations=4, every=4, shrinkage=0.8).cache()
    schedule = {}
    for row in plan.collect():
        schedule.setdefault(row.strategy, {}).setdefault(row.period, {})[row.ticker] = row.weight
    assert sorted(schedule["min_variance"]) == [0, 4, 8, 12, 16]
    assert all(x == pytest.approx(1 / 3) for x in schedule["risk_parity"][0].values())
    for strategy, by_period in schedule.items():
        for at, w in by_period.items():
            assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0
            if at >= 4:
                x = np.array([data[t][max(0, at - 8):at] for t in names])
                cov = np.cov(x)
                sigma = 0.2 * cov + 0.8 * np.eye(3) * np.mean(np.diag(cov))
                assert [w[t] for t in names] == pytest.approx(list(al.SOLVERS[strategy](sigma)), abs=1e-9)
        got = curve(bt.run_walk_forward(returns, plan.filter(f"strategy = '{strategy}'"), 0.01))
        hold = dict(by_period[0])
        for period in range(17):
            cost = 0.0
            if period and period in by_period:
                total = sum(hold.values())
                cost = 0.01 * total * sum(abs(hold[t] / total - by_period[period][t]) for t in names) / 2
                hold = {t: by_period[period][t] * (total - cost) for t in names}
            hold = {t: v * (1 + data[t][period]) for t, v in hold.items()}
            assert got[period] == pytest.approx((sum(hold.values()), cost))


def test_allocators():
    sigma = np.diag([0.04, 0.01])
    assert al.min_variance(sigma) == pytest.approx([0.2, 0.8])
    assert al.risk_parity(sigma) == pytest.approx([1 / 3, 2 / 3])
    tight = np.array([[0.04, 0.039, 0.0], [0.039, 0.09, 0.0], [0.0, 0.0, 0.05]])
    w = al.min_variance(tight)
    assert (w >= 0).all() and w.sum() == pytest.approx(1)


def series(spark, xs, name="w"):
    return spark.createDataFrame([("s", name, i, x) for i, x in enumerate(xs)], "study string, strategy string, period int, ret double")


def test_metrics(spark):
    returns = series(spark, [0.2, -0.5, 0.5])
    m = r.performance(returns, 12.0).head()
    assert m.total_return == pytest.approx(1.2 * 0.5 * 1.5 - 1)
    flat = r.performance(series(spark, [0.01, 0.01]), 12.0).head()
    assert flat.sharpe == 0.0
    equity = spark.createDataFrame([("s", "w", 0, 1.2), ("s", "w", 1, 0.6), ("s", "w", 2, 0.9)], "study string, strategy string, period int, equity double")
    assert r.max_drawdown(equity).head().max_drawdown == pytest.approx(-0.5)


def test_alignment_and_zero_price(spark):
    rows = [("s", "A", d, p) for d, p in [("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-03", 3.0)]]
    rows += [("s", "B", d, p) for d, p in [("2024-01-01", 5.0), ("2024-01-02", 0.0), ("2024-01-03", 4.0)]]
    rows += [("t", "A", "2024-01-01", 1.0)]
    prices = spark.createDataFrame(rows, "study string, ticker string, date string, price double")
    kept = {(x.study, x.ticker, x.date) for x in r.align_prices(prices).collect()}
    assert kept == {("s", t, d) for t in "AB" for d in ("2024-01-01", "2024-01-03")}


def test_rolling_counts(spark):
    pair = series(spark, [0.01 * ((i * 7) % 5) for i in range(20)], "a").union(series(spark, [0.01 * ((i * 3) % 4) for i in range(20)], "b"))
    got = r.compare_rolling(r.rolling_sharpe(pair, 8, 3, 12.0), "a", "b").head()
    assert got.windows == len(range(0, 20 - 8 + 1, 3))


def test_bootstrap_is_repeatable_and_ordered(spark):
    rng = random.Random(9)
    pair = series(spark, [rng.gauss(0.01, 0.02) for _ in range(40)], "a").union(series(spark, [rng.gauss(-0.01, 0.02) for _ in range(40)], "b"))
    one, two = (rs.block_bootstrap_sharpe(pair, "a", "b", 5, 60, periods_per_year=12.0).head() for _ in range(2))
    assert one == two
    assert one.ci_low <= one.point_estimate <= one.ci_high and one.ci_low > 0


def test_clustered_interval(spark):
    rows = [("x", f"c{i}", 5 if i % 4 else 2, 5) for i in range(60)]
    counts = spark.createDataFrame(rows, "arm string, scenario string, valid long, runs long")
    got = rs.clustered_validity_interval(counts, "arm", "scenario", 400).head()
    rate = sum(x[2] for x in rows) / sum(x[3] for x in rows)
    assert got.resamples == 400 and got.ci_low < rate < got.ci_high and got.ci_high - got.ci_low < 0.2
    assert got == rs.clustered_validity_interval(counts, "arm", "scenario", 400).head()


def test_covariance_matches_numpy(spark):
    returns, data = make(spark, 4, 30)
    names = sorted(data)
    expected = np.cov(np.array([data[t] for t in names]))
    got = {(x.ticker_a, x.ticker_b): x.cov for x in r.covariance(returns).collect()}
    for i, p in enumerate(names):
        for j, q in enumerate(names):
            assert got[p, q] == pytest.approx(expected[i, j])


def test_weight_without_returns_fails(spark):
    rets = spark.createDataFrame([("s", "A", i, 0.1) for i in range(3)], "study string, ticker string, period int, ret double")
    weights = spark.createDataFrame([("s", "x", t, 0.5) for t in "AB"], "study string, strategy string, ticker string, weight double")
    for run in (bt.run_backtest, r.fixed_weight_returns):
        with pytest.raises(Exception, match="no returns for B in s"):
            run(rets, weights).collect()


def test_misaligned_returns_fail(spark):
    """B lacks a period: neither a back-test nor a walk-forward goes on with what is left."""
    schema = "study string, ticker string, period int, ret double"
    rows = [("s", t, i, 0.1) for t in "AB" for i in range(3)]
    broken = spark.createDataFrame([x for x in rows if x[1:3] != ("B", 1)], schema)
    shifted = spark.createDataFrame([("s", t, i + (t == "B"), 0.1) for _, t, i, _ in rows], schema)
    for returns in (broken, shifted):
        with pytest.raises(Exception, match="of [AB] in s miss periods"):
            bt.run_backtest(returns, weights_df(spark, {"A": 0.5, "B": 0.5})).collect()
        with pytest.raises(Exception, match="of [AB] in s miss periods"):
            r.fixed_weight_returns(returns, weights_df(spark, {"A": 0.5, "B": 0.5})).collect()
    whole = spark.createDataFrame(rows, schema)
    plan = weights_df(spark, {"A": 0.5, "C": 0.5}).selectExpr("*", "0 AS period")
    with pytest.raises(Exception, match="no returns for C in s"):
        bt.run_walk_forward(whole, plan).collect()
    assert curve(bt.run_backtest(whole, weights_df(spark, {"A": 1.0, "B": 0.0})))[-1][0] == pytest.approx(1.1**3)


def test_weights_that_are_all_zero_fail(spark):
    returns, _ = make(spark, 2, 4)
    with pytest.raises(Exception, match="no weight above zero in s w"):
        bt.run_backtest(returns, weights_df(spark, {"A": 0.0, "B": 0.0})).collect()


@pytest.mark.parametrize("block", [2, 64])
def test_window_covariances_match_numpy(spark, block):
    returns, data = make(spark, 5, 40, tuple("ABCDEFG"))
    windows = spark.createDataFrame([("s", 10, 0), ("s", 25, 5), ("s", 40, 38), ("s", 1, 0)], "study string, at int, first int")
    got = {(c.at, c.ticker_a, c.ticker_b): c.cov for c in r.window_covariances(returns, windows, block).collect()}
    names = sorted(data)
    for at, first in ((10, 0), (25, 5), (40, 38)):
        sigma = np.cov([data[t][first:at] for t in names])
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                assert got.pop((at, a, b)) == pytest.approx(sigma[i, j], abs=1e-15)
    assert not got
    with pytest.raises(Exception, match="returns of B in s miss periods"):
        r.window_covariances(returns.filter("NOT (ticker = 'B' AND period = 3)"), windows).collect()
