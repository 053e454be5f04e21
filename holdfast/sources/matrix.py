"""Wide return matrices: one date column, one column per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_wide(returns: DataFrame, digits: int = 10) -> DataFrame:
    """Aligned matrix with fixed decimals: a column for every ticker of the table, in sorted order."""
    value = F.format_string(f"%.{digits}f", "ret")
    return returns.groupBy("study", "date").pivot("ticker").agg(F.first(value))


def to_long(wide: DataFrame, ids: tuple[str, ...] = ("study", "date")) -> DataFrame:
    tickers = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(list(ids), tickers, "ticker", "ret")
    return long.selectExpr(*ids, "upper(btrim(ticker)) AS ticker", "double(ret) AS ret")


def write_matrix(returns: DataFrame, path: str) -> None:
    to_wide(returns).orderBy("study", "date").write.mode("overwrite").option("header", True).csv(path)


def read_matrix(spark: SparkSession, path: str, ids: tuple[str, ...] = ("study", "date")) -> DataFrame:
    return to_long(spark.read.csv(path, header=True, inferSchema=False), ids)
