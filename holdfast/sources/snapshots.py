"""Freezing and replaying fundamentals with the exchange rates they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def required_fx_pairs(fundamentals: DataFrame) -> DataFrame:
    foreign = (
        (F.col("financial_currency") != F.col("trading_currency"))
        & (F.col("financial_currency") != "")
        & (F.col("trading_currency") != "")
    )
    return (
        fundamentals.filter(foreign)
        .groupBy(F.col("financial_currency").alias("base"), F.col("trading_currency").alias("quote"))
        .agg(F.count(F.lit(1)).alias("tickers"))
    )


def record_snapshot(fundamentals: DataFrame, fx: DataFrame, captured_utc: str, path: str) -> None:
    """Append one capture: fundamentals and the needed rates, partitioned by its stamp."""
    stamp = F.lit(captured_utc)
    rates = fx.join(required_fx_pairs(fundamentals).select("base", "quote"), ["base", "quote"], "left_semi")
    for rows, folder in ((fundamentals, "fundamentals"), (rates, "fx")):
        rows.withColumn("captured_utc", stamp).write.mode("append").partitionBy("captured_utc").parquet(
            f"{path}/{folder}"
        )


def _read(spark: SparkSession, path: str, folder: str) -> DataFrame:
    # Stamps look like 20240101_000000; keep them as text.
    rows = spark.read.parquet(f"{path}/{folder}")
    return rows.withColumn("captured_utc", F.col("captured_utc").cast("string"))


def latest_stamp(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("captured_utc").alias("captured_utc"))


def latest_capture(rows: DataFrame) -> DataFrame:
    """Rows of the newest capture only."""
    return rows.join(latest_stamp(rows), "captured_utc", "left_semi")


def load_snapshot(spark: SparkSession, path: str, captured_utc: str | None = None):
    """(fundamentals, fx) of one capture, the newest when no stamp is given."""
    picked = []
    for folder in ("fundamentals", "fx"):
        rows = _read(spark, path, folder)
        rows = rows.filter(F.col("captured_utc") == captured_utc) if captured_utc else latest_capture(rows)
        picked.append(rows)
    return tuple(picked)


def missing_tickers(wanted: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Tickers asked for that the snapshot does not hold."""
    return wanted.select("ticker").distinct().join(snapshot.select("ticker"), "ticker", "left_anti")
