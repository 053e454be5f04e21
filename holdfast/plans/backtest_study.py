"""Price back-test study: several strategies over the same returns, measured and compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.grouping import cut_lineage
from holdfast.operators import allocators, resampling
from holdfast.operators import backtest as bt
from holdfast.operators import returns as r


def standard_strategies(current: DataFrame, benchmark_ticker: str) -> DataFrame:
    """Current, equal and benchmark weights as one (study, strategy, ticker, weight) table."""
    named = current.select("study", F.lit("current").alias("strategy"), "ticker", "weight")
    equal = r.equal_weights(current.select("study", "ticker").distinct())
    single = current.filter(F.col("ticker") == benchmark_ticker).select(
        "study", F.lit("benchmark").alias("strategy"), "ticker", F.lit(1.0).alias("weight")
    )
    return named.unionByName(equal).unionByName(single)


def price_backtest_study(
    returns: DataFrame,
    current: DataFrame,
    benchmark_ticker: str,
    periods_per_year: float = 252.0,
    rebalance_every: int = 0,
    cost_rate: float = 0.0,
    walk_forward: bool = True,
    lookback: int = 252,
    min_observations: int = 63,
    every: int = 63,
    shrinkage: float = 0.20,
) -> tuple[DataFrame, DataFrame]:
    """(metrics, comparisons): every strategy's metrics, and 'current' against each other.

    The schedule, the curves and the metrics are checkpointed: each feeds several later
    branches, and the plan would otherwise repeat the whole history once per branch.
    """
    curves = [bt.run_backtest(returns, standard_strategies(current, benchmark_ticker))]
    rivals = ["equal", "benchmark"]
    if rebalance_every:
        target = current.select("study", F.lit("rebalanced").alias("strategy"), "ticker", "weight")
        curves.append(bt.run_backtest(returns, target, rebalance_every, cost_rate))
        rivals.append("rebalanced")
    if walk_forward:
        schedule = cut_lineage(
            allocators.weight_schedule(returns, lookback, min_observations, every, shrinkage)
        )
        curves.append(bt.run_walk_forward(returns, schedule, cost_rate))
        rivals += ["min_variance", "risk_parity"]
    equity = cut_lineage(reduce(DataFrame.unionByName, curves))
    metrics = cut_lineage(bt.summarize(equity, periods_per_year))
    compared = reduce(DataFrame.unionByName, [bt.compare(metrics, "current", name) for name in rivals])
    return metrics, compared


def robustness_study(
    returns: DataFrame,
    current: DataFrame,
    window: int = 252,
    step: int = 21,
    block: int = 21,
    samples: int = 2000,
    periods_per_year: float = 252.0,
) -> tuple[DataFrame, DataFrame]:
    """(rolling, bootstrap) of equal against current weights over tickers present in both."""
    basket = current.join(
        returns.select("study", "ticker").distinct(), ["study", "ticker"], "left_semi"
    )
    pair = standard_strategies(basket, "").filter("strategy <> 'benchmark'")
    series = r.fixed_weight_returns(returns, r.normalize_weights(pair))
    rolling = r.compare_rolling(
        r.rolling_sharpe(series, window, step, periods_per_year), "equal", "current"
    )
    bootstrap = resampling.block_bootstrap_sharpe(
        series, "equal", "current", block, samples, periods_per_year=periods_per_year
    )
    return rolling, bootstrap
