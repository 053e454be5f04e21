"""Auditing recommendation runs: verdicts, stability and reports per run set."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import audit as a
from holdfast.functions import fees as fee
from holdfast.grouping import dealt_ranges, reuse

RUN_SET = ("scenario", "advisor")
#: Different sets of a run set that are compared in one row.
BLOCK = 256

ARM_ORDER = ("bare", "policy", "scaffold")


def run_verdicts(
    runs: DataFrame, scenarios: DataFrame, rules: dict[str, Callable[[], Column]] | None = None
) -> DataFrame:
    """One row per run: normalized picks, violations, validity and policy agreement.

    A run of an unknown scenario fails the job with the scenario's name.
    """
    compared = a.policy_comparison("picks", "policy_tickers", "k")
    clean = a.normalized_lists(scenarios.columns)
    known = scenarios.withColumns({c: F.expr(e) for c, e in clean.items()}).withColumn("_known", F.lit(True))
    unknown = "if(_known IS NULL, raise_error(concat('unknown scenario: ', scenario)), scenario)"
    return (
        runs.join(known, "scenario", "left")
        .withColumn("scenario", F.expr(unknown))
        .drop("_known")
        .selectExpr(
            "*",
            f"{a.normalize_tickers('tickers')} AS picks",
            "least(max_recommendations, size(policy_tickers)) AS k",
        )
        .selectExpr(
            "*",
            f"{a.violations(rules)} AS violations",
            *[f"{sql} AS {name}" for name, sql in compared.items()],
        )
        .selectExpr(
            "*",
            "size(violations) = 0 AS valid",
            f"if(size(amounts) > 0, {a.total_amount('amounts')}, NULL) AS cash_used",
            f"if(size(amounts) > 0, {fee.total_order_fee('amounts')}, NULL) AS fee",
            "agreement_at_k = 1 AND size(violations) > 0 AS agreed_but_invalid",
        )
    )


def violation_rows(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("violation", F.explode("violations")).drop("violations")


def shared_histogram(sets: DataFrame, sizes: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """How many pairs of runs of a run set have picks of sizes p and q with ``shared`` in common.

    ``sets`` holds each different set of picks of a run set once: keys, picks, copies. ``sizes`` counts them in each run
    set: keys, different. The sets are dealt by hash into
    blocks of about ``block``; each pair of blocks is one row, wherever it runs, and counts its pairs in one matrix
    product over its own tickers. Only counts leave a task. Columns: keys, p, q, shared, pairs (of different sets).
    """
    keys = list(keys)
    counts = sizes.selectExpr(*keys, f"1 + (different - 1) div {block} AS _blocks")
    placed = sets.join(counts, keys).withColumn("_own", F.expr("pmod(xxhash64(picks), _blocks)"))
    dealt = placed.withColumn("_other", F.explode(F.expr("sequence(0L, _blocks - 1)")))
    rows = dealt.groupBy(*keys, F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y")).agg(
        F.collect_list(F.struct("_own", "picks", "copies")).alias("_sets")
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.select(*keys).schema.fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("_sets")
            ends = members.value_lengths().to_numpy().cumsum()
            flat = members.flatten()
            own, copies = (flat.field(c).to_numpy() for c in ("_own", "copies"))
            width = flat.field("picks").value_lengths().to_numpy().astype(np.int64)
            tickers = flat.field("picks").flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            at = np.r_[0, width.cumsum()]
            row_of = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
            crossed = batch.column("_x").to_numpy() != batch.column("_y").to_numpy()
            base = int(width.max(initial=0)) + 1
            found, of, row = [], [], 0
            # Small rows share a matrix product of about ``block`` sets; pairs across rows are dropped.
            while row < len(ends):
                start = int(ends[row - 1]) if row else 0
                row = max(row + 1, int(np.searchsorted(ends, start + block, "right")))
                end = int(ends[row - 1])
                names, column = np.unique(tickers[at[start] : at[end]], return_inverse=True)
                holds = np.zeros((end - start, len(names)), np.float32)
                holds[np.repeat(np.arange(end - start), width[start:end]), column] = 1
                first, second = np.triu_indices(end - start, 1)
                rows_in, owners = row_of[start:end], own[start:end]
                pair = rows_in[first] == rows_in[second]
                pair &= ~crossed[rows_in[first]] | (owners[first] != owners[second])
                first, second = first[pair], second[pair]
                shared = (holds @ holds.T)[first, second].astype(np.int64)
                sizes, times = width[start:end], copies[start:end]
                low, high = np.minimum(sizes[first], sizes[second]), np.maximum(sizes[first], sizes[second])
                # Row, sizes and shared tickers as one number.
                shape, where = np.unique(((rows_in[first] * base + low) * base + high) * base + shared, return_inverse=True)
                pairs = np.zeros(len(shape), np.int64)
                np.add.at(pairs, where, times[first] * times[second])
                shape, common = np.divmod(shape, base)
                shape, larger = np.divmod(shape, base)
                which, smaller = np.divmod(shape, base)
                found.append(np.stack([smaller, larger, common, pairs]))
                of.append(which)
            of = np.concatenate(of) if of else np.zeros(0, np.int64)
            if len(of):
                heads = batch.select(keys).take(pa.array(of))
                numbers = [pa.array(column) for column in np.concatenate(found, axis=1)]
                yield pa.RecordBatch.from_arrays([*heads.columns, *numbers], [*keys, "p", "q", "shared", "pairs"])

    return rows.mapInArrow(count, f"{kinds}, p long, q long, shared long, pairs long")


def set_stability(runs: DataFrame, keys: Sequence[str] = RUN_SET, block: int = BLOCK) -> DataFrame:
    """Mean pairwise Jaccard of the picks in each run set; one run counts as stable, two empty ones as equal.

    Equal pick sets are merged with a count first; the rest is a histogram of sizes and shared tickers.
    """
    c = F.col
    keys = list(keys)
    sets = reuse(
        runs.dropna(subset=keys)
        .select(*keys, F.array_sort(F.expr(a.normalize_tickers("tickers"))).alias("picks"))
        .groupBy(*keys, "picks")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    sizes = reuse(sets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("different"), F.sum("copies").alias("runs"),
        F.sum(c("copies") * (c("copies") - 1) / 2).alias("same_pairs"),
    ))
    overlap = shared_histogram(sets, sizes, keys, block).groupBy(*keys).agg(
        F.expr("sum(pairs * shared / greatest(p + q - shared, 1))").alias("overlap")
    )
    pairs = c("runs") * (c("runs") - 1) / 2
    total = c("same_pairs") + F.coalesce("overlap", F.lit(0.0))
    return sizes.join(overlap, keys, "left").select(
        *keys, "runs", F.coalesce(F.try_divide(total, pairs), F.lit(1.0)).alias("set_stability")
    )


def distinct_picks(runs: DataFrame, keys: Sequence[str] = RUN_SET) -> DataFrame:
    """Sorted distinct tickers per run set (bounded by the ticker universe)."""
    rows = runs.select(*keys, F.explode(F.expr(a.normalize_tickers("tickers"))).alias("ticker"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set("ticker")).alias("unique_tickers"))


def _leg_weights(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weight per run and ticker; ``opens`` is 1 on exactly one row of every sized run.

    A row is a run; its repeated tickers are added up inside the row, in the order of its legs.
    """
    usable = runs.dropna(subset=list(keys)).filter(a.allocation_usable("tickers", "amounts"))
    legs = usable.selectExpr(
        *keys, "run_id", f"{a.total_amount('amounts')} AS total",
        f"zip_with(tickers, amounts, (t, x) -> struct({a.clean_ticker('t')} AS ticker, x AS amount)) AS legs",
    )
    weight = "aggregate(filter(legs, l -> l.ticker <=> t), 0D, (acc, l) -> acc + l.amount / total)"
    return legs.selectExpr(
        *keys, "run_id", f"posexplode(transform(array_distinct(legs.ticker), t -> struct(t AS ticker, {weight} AS weight))) AS (pos, leg)"
    ).selectExpr(*keys, "run_id", "leg.ticker", "leg.weight", "if(pos = 0, 1, 0) AS opens")


def allocation_weights(runs: DataFrame, keys: Sequence[str] = RUN_SET) -> DataFrame:
    """Share of the deployed cash per run and ticker; repeated tickers add up."""
    return _leg_weights(runs, keys).drop("opens")


def amount_stability(runs: DataFrame, keys: Sequence[str] = RUN_SET) -> DataFrame:
    """One minus the mean pairwise total-variation distance of the allocations.

    For one ticker the sum of |x - y| over all pairs of runs follows from each weight's rank:
    with c runs at weight w, b runs below it and n runs in all, it adds w c (2b + c - n).
    Runs without the ticker sit at zero. The pairs are never formed; equal weights are merged,
    and ranks are counted inside ranges of the weight, so a crowded ticker is not sorted by one task.
    A range leaves its task as sums; its rows' offset, the runs in lower ranges, is one factor of them.
    The sum is linear in n, which comes in only once per run set.
    """
    c = F.col
    keys = list(keys)
    group = [*keys, "ticker"]
    distinct = dealt_ranges(
        _leg_weights(runs, keys)
        .groupBy(*group, "weight")
        .agg(F.expr("count_if(weight <> 0) AS copies"), F.sum("opens").alias("opens")),
        group, [c("weight")], "bucket",
    )
    inside = Window.partitionBy(*group, "bucket").orderBy("weight").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        distinct.withColumn("below", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .groupBy(*group, "bucket")
        .agg(
            F.expr("sum(copies) AS n"), F.expr("sum(opens) AS opens"), F.expr("sum(weight * copies) AS mass"),
            F.expr("sum(weight * copies * if(weight > 0, 1, -1)) AS per_run"),
            F.expr("sum(weight * copies * (2 * below + copies)) AS inner"),
        )
    )
    lower = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("offset", F.coalesce(F.sum("n").over(lower), F.lit(0))).withColumn(
        "held", F.sum("n").over(Window.partitionBy(*group))
    )
    # Half of mass and per_run together is the mass of the positive weights.
    totals = placed.groupBy(*keys).agg(
        F.expr("sum(inner + 2 * offset * mass - held * (mass + per_run)) AS fixed"),
        F.expr("sum(per_run) AS per_run"), F.expr("sum(opens) AS sized_runs"),
    )
    return totals.selectExpr(
        *keys, "sized_runs",
        "if(sized_runs >= 2, 1 - (fixed + sized_runs * per_run) / (sized_runs * (sized_runs - 1)), NULL) "
        "AS amount_stability",
    )


def run_set_reports(verdicts: DataFrame, runs: DataFrame, keys: Sequence[str] = RUN_SET) -> DataFrame:
    """Counts, rates and means per run set, with both stability measures."""
    keys = list(keys)
    core = verdicts.groupBy(*keys).agg(
        F.sum(F.col("valid").cast("long")).alias("valid_runs"),
        F.avg("overlap_at_k").alias("mean_overlap"),
        F.avg("agreement_at_k").alias("mean_agreement"),
        F.avg("policy_jaccard").alias("mean_policy_jaccard"),
        F.sum(F.col("agreed_but_invalid").cast("long")).alias("agreed_but_invalid_runs"),
        F.avg("cash_used").alias("mean_cash_used"),
        F.avg("fee").alias("mean_fee"),
    )
    return (
        core.join(set_stability(runs, keys), keys)
        .join(amount_stability(runs, keys), keys, "left")
        .withColumn("valid_rate", F.try_divide("valid_runs", "runs"))
    )


def violation_counts(verdicts: DataFrame, keys: Sequence[str] = RUN_SET) -> DataFrame:
    return violation_rows(verdicts).groupBy(*keys, "violation").agg(F.count(F.lit(1)).alias("n"))


def prefix_totals(counts: DataFrame) -> DataFrame:
    prefix = F.split_part("violation", F.lit(":"), F.lit(1))
    return counts.groupBy(prefix.alias("prefix"), F.expr(a.violation_class("violation")).alias("failure_class")).agg(
        F.sum("n").alias("n")
    )


def advisor_aggregates(reports: DataFrame) -> DataFrame:
    """Micro validity and mean run-set measures per advisor."""
    return reports.groupBy("advisor").agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.sum("runs").alias("runs"),
        F.try_divide(F.sum("valid_runs"), F.sum("runs")).alias("validity_rate"),
        F.avg("mean_agreement").alias("mean_agreement"),
        F.avg("set_stability").alias("mean_set_stability"),
        F.avg("amount_stability").alias("mean_amount_stability"),
        F.try_divide(F.sum("agreed_but_invalid_runs"), F.sum("runs")).alias("false_positive_rate"),
    )


def macro_summary(reports: DataFrame) -> DataFrame:
    """Means of run-set rates per advisor plus the overall row."""
    return reports.rollup("advisor").agg(
        F.count(F.lit(1)).alias("run_sets"),
        F.avg("valid_rate").alias("mean_valid_rate"),
        F.avg("mean_agreement").alias("mean_agreement"),
        F.avg("set_stability").alias("mean_stability"),
        F.avg("amount_stability").alias("mean_amount_stability"),
    )


def arm_rank(arm: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(x) for x in ARM_ORDER]), arm)
    return F.when(place > 0, place - 1).otherwise(F.lit(9))


def arm_validity(verdicts: DataFrame, dims: Sequence[str] = ("advisor", "arm")) -> DataFrame:
    """Valid rate for every combination of the dimensions, subtotals included."""
    return verdicts.cube(*dims).agg(
        F.sum(F.col("valid").cast("long")).alias("valid"),
        F.count(F.lit(1)).alias("runs"),
        F.try_divide(F.sum(F.col("valid").cast("long")), F.count(F.lit(1))).alias("rate"),
    )


def rate_band(rate: Column) -> Column:
    return F.when(rate >= 0.9, "ok").when(rate >= 0.7, "warn").otherwise("bad")


def arm_stability(rates: DataFrame) -> DataFrame:
    """Mean and spread of a valid rate over repetitions, per arm."""
    n = F.count(F.lit(1))
    return rates.groupBy("arm").agg(
        n.alias("repetitions"),
        F.round(F.avg("valid_rate"), 4).alias("mean_rate"),
        F.min("valid_rate").alias("min_rate"),
        F.max("valid_rate").alias("max_rate"),
        F.when(n > 1, F.round(F.stddev_pop("valid_rate"), 4)).otherwise(F.lit(0.0)).alias("stdev_rate"),
    )
