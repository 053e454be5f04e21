"""Derives the domain tables (positions, fundamentals, runs, ...) from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import fees as fee
from holdfast.functions import money
from holdfast.functions import scoring

# Declared so a read never starts a schema-inference job over the file footers.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cents(amount: str) -> str:
    """Money to whole cents, so sums are exact in any order."""
    return f"bigint(round({amount} * 100))"


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and average cost per customer and part."""
    lines = table(spark, sf_dir, "lineitem")
    owners = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    held = (
        lines.join(owners, lines.l_orderkey == owners.o_orderkey)
        .groupBy("o_custkey", "l_partkey")
        .agg(F.expr("sum(l_quantity) AS shares"), F.expr(f"sum({cents('l_extendedprice')}) AS paid"))
    )
    return held.selectExpr(
        "o_custkey AS portfolio_id", "concat('P', l_partkey) AS ticker", "shares", "round(paid * 100 / shares) / 10000 AS cost"
    )


def positions(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """Holdings with name, theme and listed price; ``held`` are holdings with further columns, which are kept."""
    held = holdings(spark, sf_dir) if held is None else held
    # Joined on the ticker, so that a later join on it finds the rows where they are.
    parts = table(spark, sf_dir, "part").withColumn("ticker", F.expr("concat('P', p_partkey)"))
    extra = [c for c in held.columns if c not in ("portfolio_id", "ticker", "shares", "cost")]
    return held.join(parts, "ticker").selectExpr(
        "portfolio_id",
        "ticker",
        "p_name AS name",
        "p_brand AS theme",
        "p_type = 'PROMO' AS is_financial",
        "shares",
        "cost",
        "p_retailprice AS price",
        *extra,
    )


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS portfolio_id", "c_name AS portfolio_name",
        "concat('N', c_nationkey) AS currency", "c_acctbal AS cash",
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly statement rows per ticker."""
    yearly = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", F.expr("year(l_shipdate) AS fiscal_year"))
        .agg(
            F.expr("sum(l_extendedprice) AS rev"),
            F.expr("sum(l_extendedprice * (1 - l_discount)) AS disc"),
            F.expr("sum(l_quantity) AS qty"),
            F.expr("count(*) AS n"),
            F.expr("avg(l_tax) AS tax"),
        )
    )
    return yearly.selectExpr(
        "l_partkey", "fiscal_year", "n AS line_count", "rev AS revenue",
        "rev * 0.30D - (rev - disc) * 2 AS ebit",
        "rev * 0.25D - (rev - disc) AS operating_income",
        "disc / qty AS eps",
        "rev * 0.12D - (rev - disc) AS fcf",
        "qty AS diluted_shares",
        "rev - n * 30000D AS invested_capital",
        "if(n >= 2, tax, NULL) AS tax_rate",
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ticker: scalars from the part, oldest-first series from its years.

    The collected rows are yearly aggregates, so a list grows with calendar years only.
    """
    series = statements(spark, sf_dir).groupBy("l_partkey").agg(
        F.expr(
            "sort_array(collect_list(struct(fiscal_year, revenue, ebit, operating_income, eps, fcf, "
            "diluted_shares, invested_capital, tax_rate))) AS y"
        ),
        F.expr("sum(diluted_shares) AS units"),
        F.expr("sum(fcf) AS fcf_total"),
    )
    parts = table(spark, sf_dir, "part")
    reporting = "if(p_size % 17 <> 0, concat('N', p_size % 25), NULL)"
    return series.join(parts, series.l_partkey == parts.p_partkey).selectExpr(
        "concat('P', p_partkey) AS ticker", "p_name AS name", "p_brand AS theme", "p_type AS segment",
        "p_type = 'PROMO' AS is_financial",
        "p_retailprice AS broker_price",
        "p_retailprice * (p_size + 80) / 100 AS live_price",
        "p_retailprice * (p_size + 80) / 100 * units * 20 AS market_cap",
        "if(p_size % 9 <> 0, p_size / 100D, NULL) AS return_on_equity",
        "if(p_size % 5 = 0, 0D, p_size / 60D) AS gross_margin",
        "if(p_size % 7 <> 0, p_size / 120D, NULL) AS operating_margin",
        "CASE WHEN p_size % 6 = 0 THEN 0D WHEN p_size % 11 <> 0 THEN p_size + 8D END AS forward_pe",
        "if(p_size % 13 = 0, 0D, fcf_total) AS free_cash_flow",
        f"{reporting} AS financial_currency",
        f"if(p_size % 4 = 0, {reporting}, 'N0') AS trading_currency",
        "y.revenue AS revenue_series", "y.ebit AS ebit_series",
        "filter(y.tax_rate, t -> t IS NOT NULL) AS tax_rate_series",
        "y.operating_income AS operating_income_series", "y.eps AS eps_series", "y.fcf AS fcf_series",
        "y.diluted_shares AS diluted_shares_series", "y.invested_capital AS invested_capital_series",
    )


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates into the house currency, one per foreign nation (a 25-row dimension)."""
    return table(spark, sf_dir, "nation").filter("n_nationkey > 0").selectExpr(
        "concat('N', n_nationkey) AS base", "'N0' AS quote", "n_nationkey / 50D + 1 AS rate"
    )


def scored_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_fundamentals(
        scoring.with_fx_rate(fundamentals(spark, sf_dir), fx_rates(spark, sf_dir))
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade per lineitem, with the schedule's fee on its gross amount."""
    lines = table(spark, sf_dir, "lineitem")
    owners = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return lines.join(owners, lines.l_orderkey == owners.o_orderkey).selectExpr(
        "o_custkey AS portfolio_id",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trade_ref",
        "concat('P', l_partkey) AS ticker",
        "if(l_returnflag = 'R', 'SELL', 'BUY') AS transaction_type",
        "l_quantity AS shares",
        "l_extendedprice / l_quantity AS price_per_share",
        "l_extendedprice AS total_amount",
        f"{fee.order_fee('l_extendedprice')} AS fees",
        "l_shipdate AS executed_at",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote history: one row per event, keyed by a ticker per user."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('Q', user_id) AS ticker", "value AS price",
        "if(event_type <> 'error', value / 100, NULL) AS change_percent",
        "event_type AS feed", "ts AS recorded_at", "event_id AS quote_id",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed values per supplier: ordered on ``period_end``, public from ``filed``."""
    lines = table(spark, sf_dir, "lineitem")
    owners = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return (
        lines.join(owners, lines.l_orderkey == owners.o_orderkey)
        .filter("l_shipdate >= o_orderdate")
        .selectExpr(
            "concat('S', l_suppkey) AS entity", "concat('Tag', l_linenumber) AS tag",
            "l_extendedprice AS value", "date(o_orderdate) AS period_end", "date(l_shipdate) AS filed",
            "CASE l_returnflag WHEN 'A' THEN '10-K' WHEN 'N' THEN '10-Q' ELSE '20-f' END AS form",
            "year(o_orderdate) AS fiscal_year", "l_orderkey AS accession",
        )
    )


def _brand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    places = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(
        table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"),
        F.expr("s_nationkey = n_nationkey"),
    )
    return lines.join(parts, lines.l_partkey == parts.p_partkey).join(
        places, lines.l_suppkey == places.s_suppkey
    ).withColumnsRenamed({"p_brand": "ticker"}).withColumn("study", F.expr("concat('R', n_regionkey)"))


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean unit price per supplier region (study) and brand (ticker)."""
    month = F.expr("date(date_trunc('month', l_shipdate)) AS date")
    price = F.expr(f"sum({cents('l_extendedprice')}) / 100D / sum(l_quantity) AS price")
    return _brand_lines(spark, sf_dir).groupBy("study", "ticker", month).agg(price)


def brand_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend per study and brand: the 'current' weights of a study."""
    spend = F.expr(f"sum({cents('l_extendedprice')}) / 100D AS weight")
    return _brand_lines(spark, sf_dir).groupBy("study", "ticker").agg(spend)


def brand_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents spent per order, line slot and brand, dealt by order: steps by order find the rows where they are."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .selectExpr("l_orderkey", "l_linenumber", "replace(p_brand, '#', '') AS ticker", f"{cents('l_extendedprice')} AS paid")
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linenumber", "ticker")
        .agg(F.expr("sum(paid) AS spent"))
    )


def order_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of known customers with their legs by line slot then brand; runs and scenarios can share it.

    Legs are merged per (slot, brand) first, so an order carries at most 7 x 25 of them. Orders meet their customers
    before their legs, so only narrow rows are dealt by customer.
    """
    legs = brand_orders(spark, sf_dir).groupBy("l_orderkey").agg(
        F.expr("sort_array(collect_list(struct(l_linenumber, ticker, spent))) AS legs")
    )
    heads = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").join(
        table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.expr("o_custkey = c_custkey")
    )
    return heads.join(legs, heads.o_orderkey == legs.l_orderkey).drop("c_custkey", "l_orderkey")


def scenarios(spark: SparkSession, sf_dir: str, legs: DataFrame | None = None) -> DataFrame:
    """One scenario per ordering customer, with ticker lists ranked by brand spend; ``legs`` are kept ``order_legs``.

    Brands number 25, so the collected lists are bounded by that dimension.
    """
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    if legs is None:
        spent = brand_orders(spark, sf_dir).join(orders, F.expr("l_orderkey = o_orderkey"))
    else:
        spent = legs.selectExpr("o_custkey", "inline(legs)")
    spend = (
        spent.groupBy("o_custkey", "ticker").agg(F.expr("sum(spent) AS spent"))
        .groupBy("o_custkey")
        .agg(F.expr("sort_array(collect_list(struct(-spent AS k, ticker))).ticker AS ranked"))
        .withColumnRenamed("o_custkey", "_spender")
    )
    per_order = f"(sum({cents('o_totalprice')}) / count(*) / 10000D)"
    cash = orders.groupBy("o_custkey").agg(
        F.expr(f"{money.half_away(per_order, 2)} AS cash")
    )
    return (
        table(spark, sf_dir, "customer")
        .join(cash, F.expr("c_custkey = o_custkey"))
        .join(spend, F.expr("c_custkey = _spender"))
        .selectExpr(
            "concat('scn_', c_custkey) AS scenario", "c_mktsegment AS category", "cash",
            "slice(ranked, 1, 10) AS allowed_tickers", "slice(ranked, 4, 2) AS owned_tickers",
            "slice(ranked, 1, 3) AS policy_tickers", "slice(ranked, 9, 1) AS restricted_tickers",
            "slice(ranked, 10, 1) AS concentration_blocked_tickers",
            "array(concat('segment_', c_mktsegment), concat('nation_', c_nationkey)) AS available_fact_ids",
            "3 AS max_recommendations", "c_nationkey % 2 = 0 AS add_only",
            "c_mktsegment <> 'BUILDING' AS amounts_required", "250D AS min_order_amount",
            "if(c_nationkey % 3 = 0, 0.9D, NULL) AS min_cash_deployment_fraction",
        )
    )


def runs(spark: SparkSession, sf_dir: str, legs: DataFrame | None = None) -> DataFrame:
    """One recommendation run per order; ``legs`` are kept ``order_legs``."""
    legs = order_legs(spark, sf_dir) if legs is None else legs
    return legs.selectExpr(
        "concat('scn_', o_custkey) AS scenario",
        "if(left(o_orderpriority, 1) IN ('1', '2'), 'advisor_fast', 'advisor_slow') AS advisor",
        "array('bare', 'policy', 'scaffold')[int(o_orderkey % 3)] AS arm",
        "o_orderkey AS run_id",
        "legs.ticker AS tickers",
        "if(o_orderstatus = 'P', cast(array() AS array<double>), "
        "transform(legs.spent, a -> round(a / 100) / 100)) AS amounts",
        "CASE o_orderstatus WHEN 'O' THEN array(concat('segment_', c_mktsegment)) "
        "WHEN 'F' THEN array(concat('segment_', c_mktsegment), concat('status_', o_orderstatus), "
        "concat('status_', o_orderstatus)) ELSE cast(array() AS array<string>) END AS cited_fact_ids",
    )
