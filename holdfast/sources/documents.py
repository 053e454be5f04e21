"""JSON documents: scenario suites, run records, company facts and metric payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import series as s

RUN = "struct<run_id:string,tickers:array<string>,amounts:array<double>,cited_fact_ids:array<string>>"
SCENARIO = (
    "struct<name:string,category:string,cash:double,allowed_tickers:array<string>,"
    "owned_tickers:array<string>,policy_tickers:array<string>,restricted_tickers:array<string>,"
    "concentration_blocked_tickers:array<string>,available_fact_ids:array<string>,"
    "max_recommendations:int,add_only:boolean,amounts_required:boolean,"
    f"recommendations:map<string,array<{RUN}>>>"
)
SUITE = f"struct<version:string,scenarios:array<{SCENARIO}>>"
RECORD = (
    "status STRING, provider STRING, model STRING, arm STRING, scenario STRING, run_index INT, "
    "temperature DOUBLE, prompt STRING, prompt_hash STRING, raw_response STRING, usage VARIANT, "
    "truncated BOOLEAN, attempts INT, latency_seconds DOUBLE, collected_utc STRING, "
    "parsed STRUCT<tickers: ARRAY<STRING>, amounts: ARRAY<DOUBLE>, cited_fact_ids: ARRAY<STRING>>, "
    "parse_error STRING"
)
ENTRY = "struct<end:string,val:double,filed:string,form:string,fy:int,fp:string,accn:string>"
FACTS = f"struct<facts:map<string,map<string,struct<units:map<string,array<{ENTRY}>>>>>>"


def suite_scenarios(suites: DataFrame, column: str = "doc") -> DataFrame:
    """Scenario rows of parsed suites, with the defaults filled in."""
    empty = "cast(array() AS array<string>)"
    lists = [
        f"coalesce(x.{name}, {empty}) AS {name}"
        for name in (
            "policy_tickers", "restricted_tickers", "concentration_blocked_tickers", "available_fact_ids",
        )
    ]
    return suites.selectExpr(f"explode({column}.scenarios) AS x").selectExpr(
        "x.name AS scenario", "x.category", "x.cash", "x.allowed_tickers", "x.owned_tickers", *lists,
        "coalesce(x.max_recommendations, 3) AS max_recommendations", "coalesce(x.add_only, true) AS add_only",
        "coalesce(x.amounts_required, false) AS amounts_required", "x.recommendations",
    )


def suite_runs(scenarios: DataFrame) -> DataFrame:
    return scenarios.selectExpr("scenario", "explode(recommendations) AS (advisor, rs)").selectExpr(
        "scenario", "advisor", "explode(rs) AS r"
    ).selectExpr(
        "scenario", "advisor", "r.run_id", "r.tickers",
        "coalesce(r.amounts, cast(array() AS array<double>)) AS amounts",
        "coalesce(r.cited_fact_ids, cast(array() AS array<string>)) AS cited_fact_ids",
    )


def read_suite(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scenarios, runs) of the suite files under ``path``: a document per file, or one per line."""
    docs = spark.read.text(path, wholetext=not lines).selectExpr(f"from_json(value, '{SUITE}') AS doc")
    scenarios = suite_scenarios(docs)
    return scenarios.drop("recommendations"), suite_runs(scenarios)


def read_run_records(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """Run-record files under provider/model/arm/scenario__runN.json, with their path parts.

    Where ``scenario__runN.json`` is a folder of parts, as Spark writes it, ``lines`` reads a record per line. Folders may
    be named in partition style (provider=x).
    """
    pattern = r"^(?:provider=)?([^/]+)/(?:model=)?([^/]+)/(?:arm=)?([^/]+)/(?:file=)?([^/]+)__run(\\d+)\\.json$"
    rows = spark.read.schema(RECORD).option("multiLine", not lines).option(
        "recursiveFileLookup", True
    ).option("pathGlobFilter", "*" if lines else "*__run*.json").json(root)
    path = "_metadata.file_path"
    # The four folders and names that count are cut out first: a search through a whole path would try every start.
    end = f"if(substring_index({path}, '/', -2) RLIKE '__run[0-9]+[.]json/[^/]+$', substring_index(substring_index({path}, '/', -5), '/', 4), substring_index({path}, '/', -4))"
    part = [
        f"regexp_extract(_end, '{pattern}', {i}) AS {name}"
        for i, name in enumerate(("path_provider", "path_model", "path_arm", "path_scenario"), 1)
    ]
    return rows.selectExpr("*", f"{end} AS _end").selectExpr("*", *part, f"int(regexp_extract(_end, '{pattern}', 5)) AS path_run").drop("_end")


def company_facts(documents: DataFrame, column: str = "payload", taxonomy: str | None = None) -> DataFrame:
    """Flatten taxonomy -> tag -> unit -> entries; absent levels give no rows, null values drop."""
    keep = [c for c in documents.columns if c != column]
    doc = documents.selectExpr(*keep, f"from_json({column}, '{FACTS}') AS doc")
    rows = (
        doc.selectExpr(*keep, "explode(doc.facts) AS (taxonomy, tags)")
        .selectExpr(*keep, "taxonomy", "explode(tags) AS (tag, body)")
        .selectExpr(*keep, "taxonomy", "tag", "explode(body.units) AS (unit, entries)")
        .selectExpr(*keep, "taxonomy", "tag", "unit", "inline(entries)")
        .filter("val IS NOT NULL")
    )
    rows = rows.filter(F.col("taxonomy") == taxonomy) if taxonomy else rows
    return rows.selectExpr(
        *keep, "taxonomy", "tag", "unit", "val AS value", "to_date(end) AS period_end",
        "to_date(filed) AS filed", "coalesce(form, '') AS form", "fy AS fiscal_year",
        "nullif(fp, '') AS fiscal_period", "nullif(accn, '') AS accession",
    )


def field_series(rows: DataFrame, key: str, year: str, name: str, *fields: str) -> DataFrame:
    """Oldest-first series of the first usable field per statement row."""
    value = f"coalesce({', '.join(s.finite(f) for f in fields)})"
    return (
        rows.selectExpr(key, f"{year} AS y", f"{value} AS v").filter("v IS NOT NULL")
        .groupBy(key).agg(F.expr(f"transform(sort_array(collect_list(struct(y, v))), p -> p.v) AS {name}"))
    )


def tax_rate_series(rows: DataFrame, key: str, year: str, income: str, tax: str) -> DataFrame:
    """Tax over pre-tax income; rows without income or tax are skipped."""
    rated = rows.withColumn("_rate", F.expr(f"if({income} <> 0, {tax} / {income}, NULL)"))
    return field_series(rated, key, year, "tax_rate_series", "_rate")


def invested_capital_series(
    rows: DataFrame, key: str, year: str, explicit: str, debt: str, equity: str, cash: str
) -> DataFrame:
    """Explicit capital, else debt + equity - cash where that is positive."""
    derived = f"coalesce({debt}, 0D) + coalesce({equity}, 0D) - coalesce({cash}, 0D)"
    value = f"coalesce({explicit}, if({derived} > 0, {derived}, NULL))"
    return field_series(rows.withColumn("_cap", F.expr(value)), key, year, "invested_capital_series", "_cap")


def matrix_series(matrix: DataFrame, key: str, labels: tuple[str, ...], name: str) -> DataFrame:
    """Series from a label-by-period matrix: first listed label present wins, oldest first."""
    periods = [c for c in matrix.columns if c not in (key, "label")]
    wanted = ", ".join(f"'{x}'" for x in labels)
    ranked = matrix.withColumn("_rank", F.expr(f"array_position(array({wanted}), label)")).filter("_rank > 0")
    best = ranked.groupBy(key).agg(F.min("_rank").alias("_best"))
    chosen = ranked.join(best, key).filter("_rank = _best").drop("_rank", "_best")
    long = chosen.unpivot([key, "label"], periods, "period", "v")
    return field_series(long, key, "period", name, "v")


def metric_fundamentals(payloads: DataFrame, column: str = "metric", price: str = "price") -> DataFrame:
    """Fundamentals from a metric-map payload: key fallback, percents and implied histories."""
    m = lambda key: s.finite(f"m['{key}']")
    keep = [c for c in payloads.columns if c not in (column, price)]
    base = payloads.selectExpr(*keep, f"{s.finite(price)} AS live_price", f"from_json({column}, 'map<string,string>') AS m")
    pct = lambda *keys: s.first_percent(*[f"m['{k}']" for k in keys])
    either = lambda a, b: f"coalesce(nullif({m(a)}, 0D), {m(b)})"
    staged = base.selectExpr(
        *keep, "m", "live_price", f"{either('pfcfShareTTM', 'pfcfShareAnnual')} AS pfcf",
        f"{pct('revenueShareGrowth5Y', 'revenueGrowth5Y')} AS g_rev", f"{pct('epsGrowth5Y', 'epsGrowth3Y')} AS g_eps",
        f"{pct('cashFlowPerShareGrowth5Y', 'revenueShareGrowth5Y')} AS g_cash",
    )
    latest = lambda key, default: f"coalesce(nullif({m(key)}, 0D), {default}D)"
    ebit = s.implied_series("g_rev", latest("ebitdPerShareTTM", 20))
    return staged.selectExpr(
        *keep, "live_price", "if(pfcf > 0, 1D / pfcf, NULL) AS free_cash_flow",
        f"if(pfcf > 0, 1D, {m('marketCapitalization')}) AS market_cap",
        f"{pct('roeTTM', 'roe5Y')} AS return_on_equity", f"{pct('grossMarginTTM', 'grossMargin5Y')} AS gross_margin",
        f"{pct('operatingMarginTTM', 'operatingMargin5Y')} AS operating_margin",
        f"{either('forwardPE', 'peTTM')} AS forward_pe", "'USD' AS financial_currency", "'USD' AS trading_currency",
        f"{s.implied_series('g_rev', latest('revenuePerShareTTM', 100))} AS revenue_series",
        f"{ebit} AS ebit_series", f"array_repeat({s.DEFAULT_TAX_RATE}D, 6) AS tax_rate_series",
        f"{ebit} AS operating_income_series",
        f"{s.implied_series('g_eps', latest('epsNormalizedAnnual', 5))} AS eps_series",
        f"{s.implied_series('g_cash', latest('cashFlowPerShareTTM', 5))} AS fcf_series",
        f"{s.steady_share_series()} AS diluted_shares_series",
        f"{s.implied_series('0.03D', latest('bookValuePerShareQuarterly', 100))} AS invested_capital_series",
    )
