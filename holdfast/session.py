"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


LOCAL_SCRATCH = "file:///tmp/holdfast-scratch"


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC time; cluster settings are left alone."""
    builder = (
        SparkSession.builder.appName("holdfast")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        if master.startswith("local"):  # one machine, so its own folder is a shared one
            builder = builder.config("spark.checkpoint.dir", LOCAL_SCRATCH)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
