"""Connected components of a large graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.storage import settle


def _with_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """u, v and m, the least of u and its neighbours (of its smaller neighbours, if not both ways)."""
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("low"))
    return edges.join(least, F.col("u") == F.col("x")).select("u", "v", F.least("low", "u").alias("m"))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its smallest node.

    Hubs are handled by map-side minima and joins that adaptive execution can split. Rounds end when the
    edges no longer change; an unfinished graph after ``most_rounds`` is an error, never a partial result.
    """
    star = settle(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        large = _with_least(star, True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = _with_least(large, False)  # v < u in every edge
        small = (
            down.filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
        )
        star = settle(small.distinct(), "star")
        now = tuple(star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())
        if now == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError("the components did not settle")
