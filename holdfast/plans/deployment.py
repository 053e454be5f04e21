"""Cash deployment: from position analyses and cash to fee-aware buy orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import fees as fee
from holdfast.grouping import top_per_group

OVERWEIGHT_MULTIPLE = 1.3
THEME_CAP_PCT = 20.0
PICKS = "array<struct<pick:int,ticker:string,score:double,live_price:double>>"


def within_weight_limit(multiple: float = OVERWEIGHT_MULTIPLE) -> Column:
    return F.col("weight_pct") <= F.lit(100.0) / F.col("position_count") * multiple


def eligible() -> Column:
    """Scored, and not overweight."""
    return within_weight_limit() & F.col("composite_score").isNotNull()


def theme_leaders(analyses: DataFrame) -> DataFrame:
    """Per portfolio and theme: total weight and the best ticker still eligible."""
    rank = F.struct(
        (-F.col("composite_score")).alias("neg_score"), "ticker", "live_price"
    )
    return analyses.groupBy("portfolio_id", "theme").agg(
        F.sum("weight_pct").alias("theme_weight"),
        F.min(F.when(eligible(), rank)).alias("best"),
    )


def purchase_candidates(analyses: DataFrame, fees: fee.FeeSchedule = fee.DEFAULT_FEES) -> DataFrame:
    """Best eligible ticker of each unsaturated theme, at most ``max_legs`` per portfolio."""
    open_themes = (
        theme_leaders(analyses)
        .filter((F.col("theme_weight") < THEME_CAP_PCT) & F.col("best").isNotNull())
        .select(
            "portfolio_id", "theme", F.col("best.ticker").alias("ticker"),
            (-F.col("best.neg_score")).alias("score"), F.col("best.live_price").alias("live_price"),
        )
    )
    return top_per_group(
        open_themes, ["portfolio_id"], [F.col("score").desc(), F.col("ticker")], fees.max_legs, "pick"
    )


def plan_deployment(
    analyses: DataFrame, cash: DataFrame, fees: fee.FeeSchedule = fee.DEFAULT_FEES
) -> DataFrame:
    """One plan row per portfolio: its orders, their fee, and a note when it holds nothing."""
    picks = purchase_candidates(analyses, fees).groupBy("portfolio_id").agg(
        F.sort_array(F.collect_list(F.struct("pick", "ticker", "score", "live_price"))).alias("picks")
    )
    held = analyses.select("portfolio_id").groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("position_count")
    )
    staged = (
        cash.select("portfolio_id", "cash")
        .join(held, "portfolio_id", "left")
        .join(picks, "portfolio_id", "left")
        .selectExpr(
            "portfolio_id", "cash", "position_count",
            f"slice(coalesce(picks, cast(array() AS {PICKS})), 1, {fee.max_orders('cash', fees)}) AS picks",
        )
        .selectExpr("*", f"{fee.order_amounts('picks.score', 'cash', fees)} AS amounts")
    )
    orders = (
        "transform(amounts, (paid, i) -> struct(i + 1 AS leg, picks[i].ticker AS ticker, paid AS amount, "
        f"try_divide(paid, picks[i].live_price) AS shares, {fee.order_fee('paid', fees)} AS fee))"
    )
    return staged.selectExpr(
        "portfolio_id", "cash",
        f"{orders} AS orders",
        "aggregate(amounts, 0D, (acc, x) -> acc + x) AS deployed",
        f"{fee.total_order_fee('amounts', fees)} AS total_fee",
        "size(picks) AS candidates",
        "CASE WHEN position_count IS NULL THEN 'no_positions' "
        f"WHEN cash < {fees.floor}D THEN 'below_floor' ELSE 'planned' END AS status",
    )


def orders_of(plans: DataFrame) -> DataFrame:
    # The outer form keeps the optimizer from evaluating the sizing again as a filter.
    exploded = plans.select("portfolio_id", F.explode_outer("orders").alias("o"))
    return exploded.filter("o IS NOT NULL").select("portfolio_id", "o.*")


def blocked_by_theme(
    analyses: DataFrame, cash: DataFrame, fees: fee.FeeSchedule = fee.DEFAULT_FEES
) -> DataFrame:
    """Eligible tickers passed over for their theme before the pick list was full.

    A walk down the ranking stops after its last allowed pick, so a ticker is blocked when
    it ranks above that pick without being one; with picks to spare every non-pick is.
    """
    c = F.col
    picks = purchase_candidates(analyses, fees).join(
        cash.selectExpr("portfolio_id", f"{fee.max_orders('cash', fees)} AS max_picks"), "portfolio_id"
    )
    last = picks.filter("pick = max_picks").select(
        "portfolio_id", c("score").alias("stop_score"), c("ticker").alias("stop_ticker")
    )
    taken = picks.filter("pick <= max_picks").select("portfolio_id", "ticker")
    open_to_buy = analyses.filter(eligible()).select("portfolio_id", "ticker", "composite_score")
    before_stop = (
        c("stop_score").isNull()
        | (c("composite_score") > c("stop_score"))
        | ((c("composite_score") == c("stop_score")) & (c("ticker") < c("stop_ticker")))
    )
    return (
        open_to_buy.join(cash.select("portfolio_id"), "portfolio_id", "left_semi")
        .join(last, "portfolio_id", "left")
        .filter(before_stop)
        .join(taken, ["portfolio_id", "ticker"], "left_anti")
        .select("portfolio_id", "ticker")
    )


def top_candidates(analyses: DataFrame, k: int = 6) -> DataFrame:
    """The k best eligible tickers per portfolio."""
    return top_per_group(
        analyses.filter(eligible()).select("portfolio_id", "ticker", "composite_score"),
        ["portfolio_id"], [F.col("composite_score").desc(), F.col("ticker")], k,
    )


def overweight(analyses: DataFrame) -> DataFrame:
    return analyses.filter(~within_weight_limit())


def planner_gap(plans: DataFrame, fees: fee.FeeSchedule = fee.DEFAULT_FEES) -> DataFrame:
    """How far each plan is from full deployment and from the one-order fee; plans may cover a grid of cash."""
    bound = fee.deployable_bound("cash", "candidates", fees)
    least_fee = fee.order_fee("deployed", fees)
    return plans.selectExpr(
        "portfolio_id", "cash", "status", "deployed AS deployed_planner",
        f"{bound} AS deployed_bound",
        f"greatest(0D, {bound} - deployed) AS deployment_gap",
        "total_fee AS fee_planner",
        f"{least_fee} AS fee_lower_bound",
        f"total_fee - {least_fee} AS fee_premium",
    )
