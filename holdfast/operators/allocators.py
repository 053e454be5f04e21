"""Long-only allocators and walk-forward weight schedules.

Spark computes the training covariance of each (study, rebalance date); the solver gets one
k x k matrix per group, as an array column, so a group is a single row whatever the history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.returns import window_covariances

# Stopping rule of the risk-parity iteration.
MAX_ITERATIONS = 1000
TOLERANCE = 1e-9

Solver = Callable[[np.ndarray], np.ndarray]


def min_variance(sigma: np.ndarray) -> np.ndarray:
    """Closed-form minimum variance, dropping the most negative weight until none is left."""
    keep = np.arange(len(sigma))
    while keep.size:
        raw = np.linalg.solve(sigma[np.ix_(keep, keep)], np.ones(keep.size))
        part = raw / raw.sum()
        low = int(part.argmin())
        if part[low] >= 0:
            weights = np.zeros(len(sigma))
            weights[keep] = part
            return weights
        keep = np.delete(keep, low)
    raise ValueError("no asset is left to hold")


def risk_parity(sigma: np.ndarray) -> np.ndarray:
    """Equal risk contributions, scaled towards the mean contribution until stable.

    A negative contribution has no such solution: the weights become NaN (null in the table).
    """
    weights = 1 / np.sqrt(np.diag(sigma))
    weights = weights / weights.sum()
    for _ in range(MAX_ITERATIONS):
        risk = weights * (sigma @ weights)
        mean = risk.mean()
        if mean <= 0:
            raise ValueError("portfolio variance collapsed to zero")
        with np.errstate(invalid="ignore"):
            scaled = weights * np.sqrt(mean / risk)
        scaled = scaled / scaled.sum()
        moved = np.abs(scaled - weights).max()
        weights = scaled
        if moved < TOLERANCE:
            break
    return weights


SOLVERS: dict[str, Solver] = {"min_variance": min_variance, "risk_parity": risk_parity}


def solve_weights(matrices: DataFrame, solvers: dict[str, Solver] | None = None) -> DataFrame:
    """Weights per group and solver from ``tickers`` and the flattened row-major ``sigma``."""
    chosen = solvers or SOLVERS

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = len(row.tickers)
                sigma = np.asarray(row.sigma, dtype=float).reshape(k, k)
                if (np.diag(sigma) <= 0).any():
                    raise ValueError("every asset must have positive variance")
                for name, solver in chosen.items():
                    out.append(
                        pd.DataFrame(
                            {
                                "study": row.study, "strategy": name, "period": row.period,
                                "ticker": list(row.tickers), "weight": solver(sigma),
                            }
                        )
                    )
            if out:
                yield pd.concat(out, ignore_index=True)

    return matrices.select("study", "period", "tickers", "sigma").mapInPandas(
        solve, "study string, strategy string, period int, ticker string, weight double"
    )


def rebalance_periods(returns: DataFrame, every: int) -> DataFrame:
    lengths = returns.groupBy("study").agg(F.expr("max(period) AS last_period"))
    return lengths.selectExpr("study", f"explode(sequence(0, last_period, {every})) AS at")


def training_matrices(
    returns: DataFrame, lookback: int, min_observations: int, every: int, shrinkage: float
) -> DataFrame:
    """Shrunk covariance of the ``lookback`` periods before each rebalance date.

    One row per (study, date): tickers in order and the flattened matrix, put together from the cells of
    ``returns.window_covariances``; no series of a study meets in one row.
    """
    dates = rebalance_periods(returns, every).filter(f"at >= {min_observations}")
    cells = window_covariances(returns, dates.selectExpr("study", "at", f"greatest(at - {lookback}, 0) AS first"))
    matrices = cells.groupBy("study", "at").agg(
        F.expr("sort_array(collect_list(struct(ticker_a, ticker_b, cov))) AS cells"),
        F.expr("avg(if(ticker_a = ticker_b, cov, NULL)) AS avg_var"),
    )
    shrunk = f"{1.0 - shrinkage}D * c.cov + if(c.ticker_a = c.ticker_b, {shrinkage}D * avg_var, 0D)"
    return matrices.selectExpr(
        "study", "int(at) AS period", "array_distinct(cells.ticker_a) AS tickers", f"transform(cells, c -> {shrunk}) AS sigma"
    )


def weight_schedule(
    returns: DataFrame,
    lookback: int = 252,
    min_observations: int = 63,
    every: int = 63,
    shrinkage: float = 0.20,
    solvers: dict[str, Solver] | None = None,
) -> DataFrame:
    """Dated weights from past returns only; equal weights until enough history exists."""
    if lookback < 2 or min_observations < 2 or every <= 0:
        raise ValueError("lookback and min_observations need 2 periods, every must be positive")
    chosen = solvers or SOLVERS
    tickers = returns.select("study", "ticker").distinct()
    counts = tickers.groupBy("study").agg(F.count(F.lit(1)).alias("k"))
    early = (
        rebalance_periods(returns, every).filter(f"at < {min_observations}")
        .join(tickers.join(counts, "study"), "study")
    )
    names = ", ".join(f"'{name}'" for name in chosen)
    uniform = early.selectExpr(
        "study", f"explode(array({names})) AS strategy", "int(at) AS period", "ticker", "1D / k AS weight"
    )
    matrices = training_matrices(returns, lookback, min_observations, every, shrinkage)
    return uniform.unionByName(solve_weights(matrices, chosen))
