"""Back-tests as window products instead of a sequential loop.

A rebalance resets the weights, so the stretch between two rebalances depends only on its
own targets: assets compound inside the stretch, stretches multiply together, and cost is a
factor on the boundary. Each back-test is one pass: a product per (strategy, ticker,
segment), a sum per period, and a product over the periods of a strategy. Lists collected at
a boundary hold one entry per ticker of the strategy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators import returns as r

SERIES = ("study", "strategy")


def _upto(end: int):
    return Window.partitionBy(*SERIES).orderBy("period").rowsBetween(Window.unboundedPreceding, end)


def _grown(rows: DataFrame) -> DataFrame:
    """Add each ticker's value per unit of segment start: weight times growth so far."""
    inside = (
        Window.partitionBy(*SERIES, "ticker", "segment").orderBy("period")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return rows.withColumn("grown", F.col("weight") * F.product(1 + F.col("ret")).over(inside))


def run_backtest(
    returns: DataFrame, weights: DataFrame, rebalance_every: int = 0, cost_rate: float = 0.0
) -> DataFrame:
    """Equity curve per strategy under fixed targets; 0 lets the weights drift.

    The last period never rebalances, and cost is charged at the end of a closed segment.
    """
    if rebalance_every < 0 or cost_rate < 0:
        raise ValueError("rebalance_every and cost_rate must be non-negative")
    every = rebalance_every or 1
    last = Window.partitionBy("study", "strategy", "ticker")
    rows = (
        r.joined_weights(returns, r.normalize_weights(weights))
        .withColumn("last_period", F.max("period").over(last))
        .selectExpr(
            "*",
            f"if({rebalance_every} = 0, 0, int(floor(period / {every}D))) AS segment",
            f"{rebalance_every} > 0 AND (period + 1) % {every} = 0 AND period <> last_period AS closes",
        )
    )
    curve = _grown(rows).groupBy(*SERIES, "period").agg(
        F.sum("grown").alias("value"),
        F.max("closes").alias("closes"),
        F.expr("collect_list(if(closes, struct(grown, weight), NULL)) AS legs"),
    )
    traded = "aggregate(legs, 0D, (acc, x) -> acc + abs(x.grown / value - x.weight)) / 2"
    closed = curve.selectExpr(
        *SERIES, "period", "value", "closes",
        f"if(closes, {cost_rate}D * {traded}, 0D) AS paid",
    )
    start = F.coalesce(F.product(F.expr("if(closes, value * (1 - paid), NULL)")).over(_upto(-1)), F.lit(1.0))
    return closed.withColumn("start", start).selectExpr(
        *SERIES, "period", "start * value * (1 - paid) AS equity", "start * value * paid AS cost",
        "closes AS rebalanced",
    )


def run_walk_forward(returns: DataFrame, schedule: DataFrame, cost_rate: float = 0.0) -> DataFrame:
    """Equity curve under dated targets: rebalance first, then earn the period's return.

    ``schedule`` holds (study, strategy, period, ticker, weight); every listed period starts a
    segment. Cost is charged on the move from the drifted previous target.
    """
    if cost_rate < 0:
        raise ValueError("cost_rate must be non-negative")
    lengths = returns.groupBy("study").agg(F.max("period").alias("last_period"))
    dates = schedule.select(*SERIES, F.col("period").alias("segment")).distinct()
    following = F.lead("segment").over(Window.partitionBy(*SERIES).orderBy("segment"))
    spans = (
        dates.withColumn("following", following).join(lengths, "study")
        .withColumn("end_period", F.expr("coalesce(following - 1, last_period)"))
        .withColumn("period", F.expr("explode(sequence(segment, end_period))"))
        .select(*SERIES, "segment", "end_period", "period")
    )
    targets = r.checked_weights(returns, schedule).withColumnRenamed("period", "segment")
    rows = spans.join(targets, [*SERIES, "segment"]).join(
        returns.select("study", "ticker", "period", "ret"), ["study", "ticker", "period"]
    )
    curve = _grown(rows).groupBy(*SERIES, "segment", "end_period", "period").agg(
        F.sum("grown").alias("value"),
        F.expr("map_from_entries(collect_list(if(period = segment, struct(ticker, weight), NULL))) AS target"),
        F.expr("map_from_entries(collect_list(if(period = end_period, struct(ticker, grown), NULL))) AS drift"),
    )
    order = Window.partitionBy(*SERIES).orderBy("period")
    boundary = curve.withColumn("before", F.lag("drift").over(order)).withColumn(
        "before_value", F.lag("value").over(order)
    )
    moved = (
        "aggregate(array_union(map_keys(target), map_keys(before)), 0D, (acc, t) -> acc + "
        "abs(coalesce(target[t], 0D) - coalesce(before[t], 0D) / before_value)) / 2"
    )
    paid = boundary.selectExpr(
        *SERIES, "period", "value", "period = segment AND before IS NOT NULL AS opens",
        "period = end_period AS ends",
        f"if(period = segment AND before IS NOT NULL, {cost_rate}D * {moved}, 0D) AS paid",
    )
    earned = F.coalesce(F.product(F.expr("if(ends, value, NULL)")).over(_upto(-1)), F.lit(1.0))
    kept = F.product(F.expr("1 - paid"))
    chained = paid.withColumns(
        {"earned": earned, "kept": kept.over(_upto(0)), "kept_before": F.coalesce(kept.over(_upto(-1)), F.lit(1.0))}
    )
    return chained.selectExpr(
        *SERIES, "period", "earned * kept * value AS equity", "earned * kept_before * paid AS cost",
        "opens AS rebalanced",
    )


def summarize(equity: DataFrame, periods_per_year: float) -> DataFrame:
    """All metrics of each strategy's curve in one pass (the curve starts from one)."""
    ppy = f"{float(periods_per_year)}D"
    order = Window.partitionBy(*SERIES).orderBy("period")
    steps = equity.withColumns(
        {
            "previous": F.coalesce(F.lag("equity").over(order), F.lit(1.0)),
            "peak": F.greatest(F.lit(1.0), F.max("equity").over(_upto(0))),
        }
    ).withColumn("ret", F.expr("if(previous <> 0, equity / previous - 1, NULL)"))
    base = steps.groupBy(*SERIES).agg(
        F.expr("count(*) AS periods"), F.expr("count(ret) AS n"), F.product(F.expr("1 + ret")).alias("growth"),
        F.expr("avg(ret) AS mean_ret"), F.expr("stddev_pop(ret) AS dev"), F.expr("sum(cost) AS total_cost"),
        F.expr("count_if(rebalanced) AS rebalances"), F.expr("max_by(equity, period) - 1 AS total_return"),
        F.expr("least(0D, min(equity / peak - 1)) AS max_drawdown"),
    )
    return base.selectExpr(
        *SERIES, "periods", "rebalances", "total_return",
        f"if(growth > 0, pow(growth, 1D / (n / {ppy})) - 1, NULL) AS cagr",
        f"if(n < 2, 0D, dev * sqrt({ppy})) AS volatility",
        f"if(n < 2 OR dev < 1e-12D, 0D, mean_ret / dev * sqrt({ppy})) AS sharpe",
        "max_drawdown", "total_cost",
    )


def compare(metrics: DataFrame, strategy: str, benchmark: str) -> DataFrame:
    """Strategy minus benchmark per study; both must cover the same number of periods."""

    def gap(column: str) -> str:
        of = lambda name: f"max(if(strategy = '{name}', {column}, NULL))"
        return f"{of(strategy)} - {of(benchmark)}"

    rows = metrics.filter(F.col("strategy").isin(strategy, benchmark)).groupBy("study").agg(
        F.expr("count(*) AS sides"), F.expr("min(periods) = max(periods) AS same_span"),
        F.expr(f"{gap('total_return')} AS excess_total_return"), F.expr(f"{gap('cagr')} AS excess_cagr"),
        F.expr(f"{gap('sharpe')} AS sharpe_delta"), F.expr(f"{gap('max_drawdown')} AS max_drawdown_delta"),
    ).filter("sides = 2")
    checked = "if(same_span, true, raise_error('strategy and benchmark differ in periods'))"
    return rows.filter(checked).selectExpr(
        "study", f"'{strategy}' AS strategy", f"'{benchmark}' AS benchmark", "excess_total_return",
        "excess_cagr", "sharpe_delta", "max_drawdown_delta",
    )
