"""Seeded resampling with draws that any engine can repeat (md5 of seed and position)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import let

CHUNKS = 16


def draw(modulus: str, *parts: str) -> str:
    """Uniform integer in [0, modulus) from the md5 of the joined parts."""
    return f"pmod(bigint(conv(substr(md5(concat_ws(',', {', '.join(parts)})), 1, 8), 16, 10)), bigint({modulus}))"


def block_bootstrap_sharpe(
    returns: DataFrame,
    a: str,
    b: str,
    block: int = 21,
    samples: int = 2000,
    seed: int = 12345,
    periods_per_year: float = 252.0,
    confidence: float = 0.95,
) -> DataFrame:
    """Circular block bootstrap of Sharpe(a) - Sharpe(b) per study; a block longer than its series fails the job.

    A study is one array of running sums of both series and their squares (as long as the calendar), so a block is a
    difference of two entries, or three where it passes the end. The array travels once for each of ``CHUNKS`` groups of
    samples; picks and samples are never rows before their result.
    """
    ppy = f"{float(periods_per_year)}D"
    pair = returns.filter(F.col("strategy").isin(a, b)).groupBy("study", "period").agg(
        F.expr(f"max(if(strategy = '{a}', ret, NULL)) AS ra"),
        F.expr(f"max(if(strategy = '{b}', ret, NULL)) AS rb"),
    )
    series = pair.groupBy("study").agg(
        F.expr("sort_array(collect_list(struct(period, ra, rb))) AS s"),
        F.avg("ra").alias("ma"), F.avg("rb").alias("mb"), F.count(F.lit(1)).alias("n"),
    )
    # Sums of x - mean keep their digits where variances are small against squares.
    term = {"a": "x.ra - ma", "qa": "(x.ra - ma) * (x.ra - ma)", "b": "x.rb - mb", "qb": "(x.rb - mb) * (x.rb - mb)"}
    sums = series.selectExpr("study", "ma", "mb", f"if(n >= {block}, n, raise_error('block must not be longer than the series')) AS n", "posexplode(s) AS (i, x)").selectExpr(
        "study", "ma", "mb", "n", "i", *[f"{e} AS {c}" for c, e in term.items()])
    running = Window.partitionBy("study").orderBy("i")
    sums = sums.select("study", "ma", "mb", "n", "i", *[F.sum(c).over(running).alias(c) for c in term])
    arrays = sums.groupBy("study").agg(
        F.expr("sort_array(collect_list(struct(i, a, qa, b, qb))) AS s"), F.first("ma").alias("ma"), F.first("mb").alias("mb"),
        F.expr("int(max(n)) AS n"),
    ).selectExpr("study", "ma", "mb", "n", *[f"concat(array(0D), s.{c}) AS p{c}" for c in term])

    def sharpe(total: str, square: str, mean: str) -> str:
        """Sharpe ratio from sums around ``mean`` over n periods."""
        spread = f"sqrt(greatest({square} / n - pow({total} / n, 2), 0D))"
        return let("d", spread, f"if(n < 2 OR d < 1e-12D, 0D, ({total} / n + {mean}) / d * sqrt({ppy}))")

    def difference(acc: str) -> str:
        return f"{sharpe(f'{acc}.a', f'{acc}.qa', 'ma')} - {sharpe(f'{acc}.b', f'{acc}.qb', 'mb')}"

    def taken(c: str) -> str:
        return f"p{c}[least(e, n)] - p{c}[s] + p{c}[greatest(e - n, 0)]"

    start = draw("n", str(seed), "study", "sample", "k")
    added = "named_struct(" + ", ".join(f"'{c}', acc.{c} + {taken(c)}" for c in term) + ")"
    stop = f"s + least({block}, n - k * {block})"
    step = let("s", f"int({start})", let("e", stop, added))
    zero = "named_struct(" + ", ".join(f"'{c}', 0D" for c in term) + ")"
    one = let("t", f"aggregate(sequence(0, int(ceil(n / {block}D)) - 1), {zero}, (acc, k) -> {step})", difference("t"))
    size = -(-samples // CHUNKS)
    sampled = (
        arrays.withColumn("chunk", F.expr(f"explode(sequence(0, {-(-samples // size) - 1}))"))
        .repartition("study", "chunk")
        .selectExpr("study", f"explode(transform(sequence(chunk * {size}, least(chunk * {size} + {size}, {samples}) - 1), sample -> {one})) AS diff")
    )
    tail = (1 - confidence) / 2
    spread = sampled.groupBy("study").agg(
        F.expr("count(*) AS samples"),
        F.expr(f"percentile(diff, {tail}D) AS ci_low"), F.expr(f"percentile(diff, {1 - tail}D) AS ci_high"),
        F.expr("avg(if(diff > 0, 1D, 0D)) AS prob_a_better"),
    )
    whole = "named_struct(" + ", ".join(f"'{c}', element_at(p{c}, -1)" for c in term) + ")"
    point = arrays.selectExpr("study", f"{let('t', whole, difference('t'))} AS point_estimate")
    return point.join(spread, "study")


def clustered_validity_interval(
    counts: DataFrame, group: str, cluster: str, resamples: int = 2000, seed: int = 20260629
) -> DataFrame:
    """Bootstrap interval of a rate, resampling whole clusters.

    Clusters with the same (valid, runs) outcome are interchangeable, so one resample is a
    multinomial draw over the distinct outcomes: its cost does not grow with the clusters.
    The bounds are the sorted rates at fixed positions, not interpolated quantiles.
    """
    outcomes = (
        counts.groupBy(group, "valid", "runs").agg(F.countDistinct(cluster).alias("copies"))
        .groupBy(group).agg(F.expr("sort_array(collect_list(struct(valid, runs, copies))) AS o"))
    )
    work = outcomes.select(
        F.col(group).cast("string").alias("grp"),
        F.expr(f"explode(sequence(0, {resamples - 1})) AS sample"),
        "o.valid", "o.runs", "o.copies",
    ).repartition("grp", "sample")

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rates = []
            for row in pdf.itertuples(index=False):
                copies = np.asarray(row.copies, dtype=np.int64)
                rng = np.random.default_rng([seed, *row.grp.encode(), int(row.sample)])
                hits = rng.multinomial(copies.sum(), copies / copies.sum())
                rates.append(float(hits @ np.asarray(row.valid)) / float(hits @ np.asarray(row.runs)))
            yield pd.DataFrame({"grp": pdf["grp"], "sample": pdf["sample"], "rate": rates})

    rates = work.mapInPandas(resample, "grp string, sample int, rate double")
    place = F.row_number().over(Window.partitionBy("grp").orderBy("rate", "sample")) - 1
    low, high = int(0.025 * resamples), int(0.975 * resamples)
    return rates.withColumn("place", place).groupBy(F.col("grp").alias(group)).agg(
        F.expr(f"max(if(place = {low}, rate, NULL)) AS ci_low"),
        F.expr(f"max(if(place = {high}, rate, NULL)) AS ci_high"),
        F.expr("count(*) AS resamples"),
    )
