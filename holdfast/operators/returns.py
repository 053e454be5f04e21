"""Price alignment, returns and performance metrics for many studies at once.

Series are keyed by ``study`` (and ``strategy``); rows per key grow with calendar periods
only, so windows over one series stay small however many studies there are.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tickers of a study whose covariances with another such block are one cell of work.
TICKER_BLOCK = 64


def align_prices(prices: DataFrame) -> DataFrame:
    """Keep dates on which every ticker of the study has a positive price (two at least)."""
    clean = prices.filter("price > 0")
    universe = prices.groupBy("study").agg(F.countDistinct("ticker").alias("n_tickers"))
    dates = clean.groupBy("study", "date").agg(F.countDistinct("ticker").alias("n"))
    full = dates.join(universe, "study").filter("n = n_tickers").select("study", "date")
    enough = full.groupBy("study").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("study")
    kept = full.join(enough, "study", "left_semi")
    return clean.join(kept, ["study", "date"], "left_semi")


def simple_returns(prices: DataFrame) -> DataFrame:
    """Period returns; a period whose previous price is zero is dropped, then renumbered."""
    series = Window.partitionBy("study", "ticker").orderBy("date")
    return (
        prices.withColumn("previous", F.lag("price").over(series))
        .filter("previous <> 0")
        .withColumn("ret", F.expr("price / previous - 1"))
        .withColumn("period", F.row_number().over(series) - 1)
        .select("study", "ticker", "date", "period", "ret")
    )


def normalize_weights(weights: DataFrame) -> DataFrame:
    """Scale each strategy's positive weights to one; a negative weight, or none above zero, fails the job."""
    checked = weights.withColumn(
        "weight",
        F.expr("if(weight < 0, raise_error('target weights must be non-negative'), weight)"),
    )
    totals = checked.groupBy("study", "strategy").agg(F.sum("weight").alias("_total"))
    none = "raise_error(concat('no weight above zero in ', study, ' ', strategy))"
    return (
        checked.join(totals, ["study", "strategy"])
        .withColumn("weight", F.expr(f"if(_total > 0, weight / _total, {none})"))
        .drop("_total")
        .filter("weight > 0")
    )


def equal_weights(tickers: DataFrame, strategy: str = "equal") -> DataFrame:
    """1/N over the tickers of each study."""
    counts = tickers.groupBy("study").agg(F.count(F.lit(1)).alias("_n"))
    return tickers.join(counts, "study").select(
        "study", F.lit(strategy).alias("strategy"), "ticker", F.expr("1D / _n AS weight")
    )


def checked_weights(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """``weights``, failing the job with the name of a ticker whose returns are missing or misaligned.

    The weighted tickers of a study need returns for the same periods: as many as the longest series, and the same
    ones (compared by a combined hash of the periods).
    """
    weighted = weights.select("study", "ticker").distinct()
    series = returns.groupBy("study", "ticker").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(period))").alias("h")).alias("_have")
    )
    found = weighted.join(series, ["study", "ticker"], "left")
    whole = found.groupBy("study").agg(F.max("_have").alias("_whole"))
    fault = (
        "CASE WHEN _have IS NULL THEN raise_error(concat('no returns for ', ticker, ' in ', study)) "
        "WHEN _have <> _whole THEN raise_error(concat('returns of ', ticker, ' in ', study, ' miss periods of other tickers')) "
        "ELSE ticker END"
    )
    sound = found.join(whole, "study").select("study", "ticker", F.expr(fault).alias("_sound"))
    kept = weights.join(sound, ["study", "ticker"])
    return kept.withColumn("ticker", F.col("_sound")).drop("_sound")


def joined_weights(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Returns of the weighted tickers, which have to be complete and aligned."""
    return returns.join(checked_weights(returns, weights), ["study", "ticker"])


def fixed_weight_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Return of a portfolio reset to its weights every period."""
    return (
        joined_weights(returns, weights)
        .groupBy("study", "strategy", "period")
        .agg(F.expr("sum(weight * ret) AS ret"))
    )


def performance(returns: DataFrame, periods_per_year: float, risk_free: float = 0.0) -> DataFrame:
    """Cumulative return, growth rate, volatility and Sharpe ratio per series."""
    ppy = f"{float(periods_per_year)}D"
    base = returns.groupBy("study", "strategy").agg(
        F.expr("count(*) AS periods"), F.product(F.expr("1 + ret")).alias("growth"),
        F.expr("avg(ret) AS mean_ret"), F.expr("stddev_pop(ret) AS dev"),
    )
    excess = f"(mean_ret - {float(risk_free)}D / {ppy})"
    return base.selectExpr(
        "study", "strategy", "periods", "growth - 1 AS total_return",
        f"if(growth > 0 AND {ppy} > 0, pow(growth, 1D / (periods / {ppy})) - 1, NULL) AS cagr",
        f"if(periods < 2, 0D, dev * sqrt({ppy})) AS volatility",
        f"if(periods < 2 OR dev < 1e-12D, 0D, {excess} / dev * sqrt({ppy})) AS sharpe",
    )


def max_drawdown(equity: DataFrame) -> DataFrame:
    """Deepest fall below the running peak; the peak starts at one."""
    so_far = (
        Window.partitionBy("study", "strategy").orderBy("period")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        equity.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(so_far)))
        .groupBy("study", "strategy")
        .agg(F.expr("least(0D, min(equity / peak - 1)) AS max_drawdown"))
    )


def rolling_sharpe(
    returns: DataFrame, window: int = 252, step: int = 21, periods_per_year: float = 252.0
) -> DataFrame:
    """Sharpe ratio of every full window starting at multiples of ``step``.

    Each row is copied to the windows that contain it (window / step of them) and the
    windows are aggregated, so nothing is scanned again for each window.
    """
    ppy = f"{float(periods_per_year)}D"
    whole = Window.partitionBy("study", "strategy")
    first = f"int(greatest(0, ceil((period - {window} + 1) / {step}D)))"
    last = f"int(least(floor(period / {step}D), floor((n - {window}) / {step}D)))"
    spread = (
        returns.withColumn("n", F.max("period").over(whole) + 1)
        .filter(f"n >= {window} AND {first} <= {last}")
        .withColumn("win", F.expr(f"explode(sequence({first}, {last}))"))
    )
    stats = spread.groupBy("study", "strategy", "win").agg(
        F.expr("avg(ret) AS m"), F.expr("stddev_pop(ret) AS d")
    )
    return stats.selectExpr(
        "study", "strategy", "win + 1 AS window_number",
        f"if({window} < 2 OR d < 1e-12D, 0D, m / d * sqrt({ppy})) AS sharpe",
    )


def compare_rolling(sharpes: DataFrame, a: str, b: str) -> DataFrame:
    """How often strategy a beats b over the same windows."""
    paired = sharpes.groupBy("study", "window_number").agg(
        F.expr(f"max(if(strategy = '{a}', sharpe, NULL)) AS sa"),
        F.expr(f"max(if(strategy = '{b}', sharpe, NULL)) AS sb"),
    )
    return paired.dropna().groupBy("study").agg(
        F.expr("count(*) AS windows"), F.expr("count_if(sa > sb) AS wins_a"),
        F.expr("count_if(sa > sb) / count(*) AS win_rate_a"),
        F.expr("avg(sa) AS mean_sharpe_a"), F.expr("avg(sb) AS mean_sharpe_b"),
    )


def turnover(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Half the absolute weight change over the union of tickers."""
    left = before.withColumnRenamed("weight", "w0")
    right = after.withColumnRenamed("weight", "w1")
    return left.join(right, [*keys, "ticker"], "full_outer").groupBy(*keys).agg(
        F.expr("sum(abs(coalesce(w1, 0D) - coalesce(w0, 0D))) / 2 AS turnover")
    )


def window_covariances(returns: DataFrame, windows: DataFrame, block: int = TICKER_BLOCK) -> DataFrame:
    """Sample covariance per ordered ticker pair over the periods from ``first`` to before ``at`` of each window.

    ``windows``: study, at, first. The tickers of a study are dealt into blocks of about ``block``, and each pair of
    blocks is one cell (study, x, y) that runs anywhere. A cell sums x, y and x * y once over the calendar, up to each
    bound of a window; a window is the difference of two such sums. Series are centred first, so the difference loses
    no digits that matter. A ticker without a return in a period of its study fails the job with its name.
    Columns: study, at, ticker_a, ticker_b, cov.
    """
    tickers = returns.select("study", "ticker").distinct()
    counts = tickers.groupBy("study").agg(F.expr(f"1 + (count(*) - 1) div {block}").alias("blocks"))
    placed = tickers.join(counts, "study").withColumn("own", F.expr("pmod(xxhash64(ticker), blocks)"))
    dealt = placed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "study", "ticker", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    )
    series = returns.select("study", "ticker", "period", "ret").join(dealt, ["study", "ticker"])
    cells = dealt.select("study", "x", "y").distinct().join(windows.select("study", "at", "first"), "study")
    cells = cells.selectExpr("study AS w_study", "x AS w_x", "y AS w_y", "at", "first")
    study = returns.schema["study"].dataType.simpleString()

    def cell(key: tuple[Any, ...], rows: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"study": [], "at": [], "ticker_a": [], "ticker_b": [], "cov": []})
        if not len(rows) or not len(bounds):
            return empty
        wide = rows.pivot(index="period", columns="ticker", values="ret")
        if wide.isna().to_numpy().any():
            raise ValueError(f"returns of {wide.columns[wide.isna().any()][0]} in {key[0]} miss periods of other tickers")
        own = rows.drop_duplicates("ticker").set_index("ticker")["own"]
        names_x = sorted(own.index[own == key[1]])
        names_y = sorted(own.index[own == key[2]])
        wide = wide - wide.mean()
        x, y, periods = wide[names_x].to_numpy(), wide[names_y].to_numpy(), wide.index.to_numpy()
        low, high = (np.searchsorted(periods, bounds[c].to_numpy()) for c in ("first", "at"))
        marks = np.unique(np.r_[0, low, high])
        sums = [np.zeros((len(names_x), 1)), np.zeros((1, len(names_y))), np.zeros((len(names_x), len(names_y)))]
        until = {0: list(sums)}
        for a, b in zip(marks, marks[1:]):
            part = (x[a:b].sum(0)[:, None], y[a:b].sum(0)[None], x[a:b].T @ y[a:b])
            sums = [s + p for s, p in zip(sums, part)]
            until[int(b)] = sums
        out = []
        for at, a, b in zip(bounds["at"], low.tolist(), high.tolist()):
            if b - a < 2:
                continue
            sx, sy, sxy = (end - start for end, start in zip(until[b], until[a]))
            cov = (sxy - sx * sy / (b - a)) / (b - a - 1)
            pairs = {"study": key[0], "at": at, "ticker_a": np.repeat(names_x, len(names_y)), "ticker_b": np.tile(names_y, len(names_x)), "cov": cov.ravel()}
            out.append(pd.DataFrame(pairs))
            if key[1] != key[2]:
                out.append(out[-1].rename(columns={"ticker_a": "ticker_b", "ticker_b": "ticker_a"})[list(empty)])
        return pd.concat(out) if out else empty

    grouped = series.groupBy("study", "x", "y").cogroup(cells.groupBy("w_study", "w_x", "w_y"))
    return grouped.applyInPandas(cell, f"study {study}, at long, ticker_a string, ticker_b string, cov double")


def covariance(returns: DataFrame, shrinkage: float = 0.0) -> DataFrame:
    """Sample covariance per ordered ticker pair, optionally shrunk to a constant variance."""
    if not 0.0 <= shrinkage <= 1.0:
        raise ValueError("shrinkage must be between 0 and 1")
    whole = returns.groupBy("study").agg(F.expr("max(period) + 1 AS at"), F.expr("min(period) AS first"))
    both = window_covariances(returns, whole).drop("at")
    if shrinkage == 0.0:
        return both
    level = both.filter("ticker_a = ticker_b").groupBy("study").agg(F.avg("cov").alias("avg_var"))
    return both.join(level, "study").selectExpr(
        "study", "ticker_a", "ticker_b",
        f"{1.0 - shrinkage}D * cov + if(ticker_a = ticker_b, {shrinkage}D * avg_var, 0D) AS cov",
    )
