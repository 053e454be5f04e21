"""Structured Streaming jobs; each ends at a sink folder and a checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import text as t
from holdfast.grouping import cut_lineage
from holdfast.operators import audit
from holdfast.streaming.stateful import late_rows, run_now


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def drain(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available now, one batch writer call per micro-batch; state lies on disk."""
    run_now(stream, write, checkpoint, mode)


def daily_trade_stream(trades: DataFrame, delay: str = "7 days") -> DataFrame:
    """Fees and volume per portfolio and day; rows later than the watermark are dropped."""
    return daily_trades(trades.withWatermark("executed_at", delay))


def daily_trades(trades: DataFrame) -> DataFrame:
    """The same tumbling-window aggregate for a batch or a stream."""
    return trades.groupBy("portfolio_id", F.window("executed_at", "1 day").alias("w")).agg(
        F.expr("sum(fees) AS fees"), F.expr("sum(total_amount) AS volume"), F.expr("count(*) AS trades")
    ).selectExpr("portfolio_id", "w.start AS day", "fees", "volume", "trades")


def run_daily_trades(trades: DataFrame, out: str, checkpoint: str) -> int:
    """Append the days that the watermark has closed; returns how many trades came too late for their day."""
    query = (
        daily_trade_stream(trades).writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return late_rows(query)


def with_marks(rows: DataFrame, folder: str) -> DataFrame:
    """A stream that also reads time marks from ``folder``, which has to exist (``write_mark``)."""
    return rows.unionByName(rows.sparkSession.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(folder))


def write_mark(spark: SparkSession, schema, folder: str, time_column: str, at: str | None) -> None:
    """A row without values but its time, which moves the watermark on and so closes what lies before it.

    Its own window stays open and is never emitted. Without a time, the folder is made and no row written.
    """
    columns = [
        F.lit(at if c.name == time_column else None).cast(c.dataType).alias(c.name) for c in schema.fields
    ]
    spark.range(1 if at else 0).select(*columns).coalesce(1).write.parquet(f"{folder}/{uuid.uuid4().hex}")


#: A record is one run of one model; another model's run of the same scenario is another record.
RECORD_KEYS = ("provider", "model", "arm", "scenario", "run_id")


def audit_record_stream(
    records: DataFrame, scenarios: DataFrame, keys: tuple[str, ...] = RECORD_KEYS
) -> DataFrame:
    """Arriving run records, deduplicated within the watermark, parsed and judged."""
    fresh = records.withWatermark("arrived_at", "1 day").dropDuplicatesWithinWatermark(list(keys))
    return audit.run_verdicts(t.parse_replies(fresh), scenarios)


def run_record_audit(records: DataFrame, scenarios: DataFrame, out: str, checkpoint: str) -> None:
    """Append per-arm counts of each micro-batch; totals are sums over batches.

    Scenarios are made once, not in every batch. Only what is counted leaves the parsing, and the keys that were seen
    lie in a state store on disk: there is one for each record of the watermark's time.
    """

    def write(rows: DataFrame, batch: int) -> None:
        counts = rows.groupBy("arm").agg(
            F.expr("count(*) AS runs"), F.expr("count_if(valid AND parse_error IS NULL) AS valid"),
            F.expr("count(parse_error) AS unparsed"),
        )
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    judged = audit_record_stream(records, cut_lineage(scenarios)).select("arm", "valid", "parse_error")
    drain(judged, "append", write, checkpoint)
