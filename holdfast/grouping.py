"""Grouping helpers that stay safe when one key holds a large share of the rows.

A window over a whole group sorts that group in one task. These helpers reach the
same result from partial aggregates joined back on the key, where adaptive skew
joins can split a hot key, or from ranks taken inside ranges of the order.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def reuse(df: DataFrame) -> DataFrame:
    """Keep a result that several branches of one job read; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that every executor sees: below ``spark.checkpoint.dir``, else below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it, so later steps neither repeat nor depend on the history."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_group_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Attach per-group aggregates to every row (map-side combined, then joined)."""
    summary = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in totals.items()])
    return df.join(summary, list(keys))


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_name: str = "rank"
) -> DataFrame:
    """First k rows per group; Spark prunes to k per task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(window)).filter(F.col(rank_name) <= k)


def dealt_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "_range") -> DataFrame:
    """``df`` dealt by ranges of (keys, order), with the range's number; ranges follow the order.

    A group of any size and any values spreads over as many ranges as it needs. The rows are written
    once, so every branch that reads them sees a row in the same range.
    """
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return cut_lineage(spread.withColumn(name, F.spark_partition_id()))


def ranked_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank_name: str = "rank"
) -> DataFrame:
    """Rank every row of a group by ``order``, which should have no ties.

    Rows are ranked inside (group, range); a count per range gives the offsets, so no task sorts a whole
    group. Without keys, the whole table is ranked.
    """
    dealt = dealt_ranges(df, keys, order)
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    return (
        dealt.withColumn("_inside", F.row_number().over(within))
        .join(offsets, [*keys, "_range"])
        .withColumn(rank_name, F.col("_inside") + F.col("_offset"))
        .drop("_range", "_inside", "_offset")
    )
