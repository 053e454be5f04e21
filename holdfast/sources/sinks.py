"""Report, decision-log, quote and audit sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_DIGITS = 12


def stable_report(df: DataFrame, digits: int = FLOAT_DIGITS) -> DataFrame:
    """One JSON document per row, with every DOUBLE (also inside arrays) rounded."""
    columns = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.DoubleType):
            columns.append(f"round({name}, {digits}) AS {name}")
        elif field.dataType == T.ArrayType(T.DoubleType(), field.dataType.containsNull if isinstance(field.dataType, T.ArrayType) else True):
            columns.append(f"transform({name}, x -> round(x, {digits})) AS {name}")
        else:
            columns.append(name)
    return df.selectExpr(f"to_json(struct({', '.join(columns)})) AS report")


def write_report(df: DataFrame, path: str, digits: int = FLOAT_DIGITS) -> None:
    stable_report(df, digits).write.mode("overwrite").text(path)


def decision_log(plans: DataFrame, policy_version: str, source: str, provider_mode: str) -> DataFrame:
    """Decision-log rows of deployment plans, with the plan as sorted JSON payload."""
    return plans.select(
        "portfolio_id", F.lit(policy_version).alias("policy_version"),
        F.lit(source).alias("portfolio_source"), F.lit(provider_mode).alias("provider_mode"),
        F.expr("cast(cash AS decimal(18,2)) AS cash"), F.expr("size(orders) AS order_count"),
        F.expr("cast(aggregate(orders, 0D, (acc, o) -> acc + o.amount) AS decimal(18,2)) AS total_order_amount"),
        F.expr("to_json(struct(cash, orders, total_fee)) AS payload_json"),
    )


def append_decisions(log: DataFrame, path: str) -> None:
    log.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_decisions(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.orderBy(F.col("created_at").desc(), "portfolio_id").limit(limit)


def quote_rows(quotes: DataFrame) -> DataFrame:
    return quotes.selectExpr(
        "upper(ticker) AS ticker", "cast(price AS decimal(18,4)) AS price",
        "cast(change_percent AS decimal(10,4)) AS change_percent", "recorded_at",
    )


def append_quotes(quotes: DataFrame, path: str) -> None:
    quote_rows(quotes).write.mode("append").parquet(path)


def write_audit(reports: DataFrame, manifest: DataFrame, path: str) -> None:
    """Audit summary and run manifest, side by side."""
    reports.write.mode("overwrite").json(f"{path}/audit_summary")
    manifest.write.mode("overwrite").json(f"{path}/run_manifest")
