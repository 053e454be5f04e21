"""Operational tables: statements, trades and quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.grouping import top_per_group


def statements_of_type(statements: DataFrame, filing_type: str | None = None) -> DataFrame:
    rows = statements.withColumn("ticker", F.upper("ticker"))
    return rows.filter(F.col("filing_type") == filing_type) if filing_type else rows


def latest_statements(statements: DataFrame, limit: int = 20) -> DataFrame:
    """Newest statements per ticker: year, then quarter, annual rows after the quarters."""
    order = [F.col("fiscal_year").desc(), F.col("fiscal_quarter").desc_nulls_last()]
    return top_per_group(statements, ["ticker"], order, limit, "place")


def annual_only(metrics: DataFrame) -> DataFrame:
    return metrics.filter("fiscal_quarter IS NULL")


def average_roic(metrics: DataFrame, years: int = 10) -> DataFrame:
    """Mean of the non-zero values in the newest annual rows; zero when there are none."""
    newest = top_per_group(annual_only(metrics), ["ticker"], [F.col("fiscal_year").desc()], years)
    return newest.groupBy("ticker").agg(
        F.expr("coalesce(avg(nullif(roic, 0D)), 0D) AS average_roic")
    )


def compounding_metrics(annual: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Growth over each horizon ending in each year (rows per ticker are years)."""
    order = Window.partitionBy("ticker").orderBy("fiscal_year")
    structs = []
    for h in horizons:
        structs.append(
            F.struct(
                F.lit(h).alias("period_years"),
                F.lag("fiscal_year", h).over(order).alias("start_year"),
                F.lag("revenue", h).over(order).alias("r0"), F.lag("eps", h).over(order).alias("e0"),
            )
        )
    rows = annual.withColumn("spans", F.array(*structs)).withColumn("span", F.explode("spans"))
    growth = "if({a} > 0 AND {b} > 0, pow({b} / {a}, 1D / span.period_years) - 1, NULL)"
    return rows.filter("span.start_year = fiscal_year - span.period_years").selectExpr(
        "ticker", "span.period_years AS period_years", "fiscal_year AS end_year",
        growth.format(a="span.r0", b="revenue") + " AS revenue_cagr",
        growth.format(a="span.e0", b="eps") + " AS eps_cagr",
    )


def latest_compounding(metrics: DataFrame) -> DataFrame:
    order = [F.col("end_year").desc()]
    return top_per_group(metrics, ["ticker", "period_years"], order, 1).drop("rank")


def trades_between(trades: DataFrame, start: str, end: str) -> DataFrame:
    """Trades in a date-time range, both ends included."""
    return trades.filter(f"executed_at BETWEEN timestamp_ntz'{start}' AND timestamp_ntz'{end}'")


def fees_and_volume(trades: DataFrame) -> DataFrame:
    return trades.groupBy("portfolio_id").agg(
        F.expr("coalesce(sum(fees), 0D) AS total_fees"),
        F.expr("coalesce(sum(total_amount), 0D) AS volume"),
        F.expr("count(*) AS trades"),
    )


def trade_page(trades: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of each portfolio's trades, newest first."""
    order = [F.col("executed_at").desc(), F.col("trade_ref")]
    page = top_per_group(trades, ["portfolio_id"], order, offset + limit, "place")
    return page.filter(F.col("place") > offset)


def latest_quotes(quotes: DataFrame, as_of: str | None = None, ttl_minutes: int | None = None) -> DataFrame:
    """Newest quote per ticker; with a lifetime, tickers whose newest quote is older drop out."""
    order = [F.col("recorded_at").desc(), F.col("quote_id").desc()]
    newest = top_per_group(quotes, ["ticker"], order, 1).drop("rank")
    if as_of and ttl_minutes:
        cutoff = f"timestamp_ntz'{as_of}' - interval {ttl_minutes} minutes"
        newest = newest.filter(f"recorded_at >= {cutoff}")
    return newest


def merge_feeds(quotes: DataFrame, feeds: DataFrame) -> DataFrame:
    """Per ticker, the newest quote of the first feed (by priority) that has one."""
    ranked = quotes.join(feeds, "feed")
    order = [F.col("priority"), F.col("recorded_at").desc(), F.col("quote_id").desc()]
    return top_per_group(ranked, ["ticker"], order, 1).drop("rank")


def first_answering_feed(quotes: DataFrame, feeds: DataFrame) -> DataFrame:
    """Attempt log of the whole-batch form: feeds up to the first one with any quote."""
    counts = quotes.groupBy("feed").agg(F.count(F.lit(1)).alias("quotes"))
    tried = feeds.join(counts, "feed", "left").withColumn(
        "success", F.coalesce(F.col("quotes") > 0, F.lit(False))
    )
    winner = tried.filter("success").agg(F.min("priority").alias("_winner")).scalar()
    return tried.filter(F.col("priority") <= F.coalesce(winner, F.col("priority"))).selectExpr(
        "feed", "priority", "coalesce(quotes, 0) AS quotes", "success"
    )


def sort_with_nulls(df: DataFrame, column: str, descending: bool, *ties: str) -> DataFrame:
    """Table sort: nulls lead when descending and trail when ascending."""
    key = F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(key, *ties)
