"""Digest manifests, run records and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import text as t
from holdfast.grouping import ranked_per_group


def digests(files: DataFrame, name: str, content: str) -> DataFrame:
    return files.selectExpr(f"{name} AS name", f"{t.digest(content)} AS digest")


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Status of every name on either side of a manifest comparison."""
    left = expected.withColumnRenamed("digest", "expected")
    right = actual.withColumnRenamed("digest", "actual")
    return left.join(right, "name", "full_outer").withColumn(
        "status",
        F.expr(
            "CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'untracked' "
            "WHEN expected <> actual THEN 'mismatch' ELSE 'ok' END"
        ),
    )


def usable_records(records: DataFrame) -> DataFrame:
    return records.filter("status = 'collected'")


def collection_manifest(records: DataFrame, dims: list[str]) -> DataFrame:
    """Truncations, retries and latency of the collected records per cell."""
    return usable_records(records).groupBy(*dims).agg(
        F.expr("count(*) AS records"),
        F.expr("count_if(truncated) AS truncated_runs"),
        F.expr("sum(coalesce(attempts, 1) - 1) AS retries"),
        F.expr("round(sum(coalesce(latency_seconds, 0D)), 3) AS total_latency_seconds"),
    )


def would_call(planned: DataFrame, collected: DataFrame, keys: list[str]) -> DataFrame:
    """Planned cells without a collected record."""
    return planned.join(usable_records(collected).select(*keys), keys, "left_anti")


def provenance(records: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Check each record's stored hash, its expected prompt and its stored parse.

    ``records`` carries arm, prompt, prompt_hash, raw_response and stored_tickers; the
    expected prompt is rendered again from the scenario for the record's arm.
    """
    arms = " ".join(f"WHEN '{arm}' THEN {t.prompt(arm)}" for arm in t.PROMPT_ARMS)
    expected = scenarios.selectExpr("*").join(records, "scenario").selectExpr(
        "scenario", "run_id", "arm", "prompt_hash", "raw_response", "stored_tickers",
        f"{t.digest('prompt')} AS actual_hash", f"{t.digest(f'(CASE arm {arms} END)')} AS expected_hash",
    )
    return t.parse_replies(expected).selectExpr(
        "scenario", "run_id", "arm",
        "actual_hash = prompt_hash AS hash_ok", "actual_hash = expected_hash AS prompt_ok",
        "parse_error IS NULL AND tickers = stored_tickers AS parse_ok",
    )


def token_budget(prompts: DataFrame, prices: DataFrame, runs: int, max_output_tokens: int) -> DataFrame:
    """Calls, tokens and cost per price row for running every prompt ``runs`` times."""
    totals = prompts.agg(
        F.expr(f"count(*) * {runs} AS calls"),
        F.expr(f"sum({t.token_estimate('prompt')}) * {runs} AS input_tokens"),
    ).withColumn("output_tokens", F.expr(f"calls * {max_output_tokens}"))
    million = "cast(1000000 AS decimal(18,0))"
    return prices.withColumn("t", totals.select(F.struct("*")).scalar()).selectExpr(
        "provider", "model", "t.calls", "t.input_tokens", "t.output_tokens",
        f"cast(t.input_tokens AS decimal(18,0)) * input_usd_per_mtok / {million} AS input_cost",
        f"cast(t.output_tokens AS decimal(18,0)) * output_usd_per_mtok / {million} AS output_cost",
    )


def manifest_hash(records: DataFrame) -> DataFrame:
    """Order-free digest of a record set: a hash tree over the row digests.

    Equal rows are counted, not listed. Digests are then combined by ever shorter hex
    prefixes (6, 3 and 0 characters), so each step sorts at most 4096 children of a node
    above the leaves and a leaf holds only rows that share six digest characters.
    """
    row = f"sha2(to_json(struct({', '.join(sorted(records.columns))})), 256) AS h"
    level = records.select(F.expr(row)).groupBy("h").agg(F.expr("count(*) AS n")).selectExpr(
        "h AS p", "concat(h, ':', n) AS part", "n"
    )
    for width in (6, 3, 0):
        level = level.groupBy(F.expr(f"substr(p, 1, {width}) AS p")).agg(
            F.expr("sha2(array_join(sort_array(collect_list(struct(p, part))).part, ''), 256) AS part"),
            F.expr("sum(n) AS n"),
        )
    return level.selectExpr("part AS digest", "n AS records")


def interleaved(cells: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Deterministic shuffle of campaign cells within each group, by seeded digest."""
    shuffled = cells.withColumn("draw", F.expr(f"md5(concat_ws(',', {seed}, {key}))"))
    return ranked_per_group(shuffled, [group], [F.col("draw").desc(), F.col(key)], "position")
