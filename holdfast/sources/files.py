"""File trees as tables: listings with modification times, content digests and digest manifests."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.manifests import manifest_diff


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = urlparse(root).path.rstrip("/") + "/"
    start = F.instr("path", base) + len(base)
    return found.withColumn("relative", F.substr("path", start))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every file under ``root`` with its relative name, size and modification time; contents stay unread."""
    return _files(spark, root, glob).selectExpr("relative", "length", "modificationTime AS modified")


def file_digests(spark: SparkSession, root: str, glob: str = "*", name: str = "relative") -> DataFrame:
    """SHA-256 of every file under ``root``; ``name`` is an expression over its relative name.

    A task holds one file at a time, so a file must fit in its memory.
    """
    return _files(spark, root, glob).selectExpr(f"{name} AS name", "sha2(content, 256) AS digest")


def write_manifest(digests: DataFrame, path: str) -> None:
    """Lines ``digest  name``, by name."""
    digests.orderBy("name").selectExpr("concat(digest, '  ', name) AS value").write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Names and digests of a manifest; blank lines are skipped, a name may hold blanks."""
    lines = spark.read.text(path).filter("btrim(value) <> ''")
    part = lambda i: F.regexp_extract("value", r"^\s*(\S+)\s+(.*?)\s*$", i)
    return lines.select(part(2).alias("name"), part(1).alias("digest"))


def verify_tree(spark: SparkSession, root: str, manifest: str, glob: str = "*", name: str = "relative") -> DataFrame:
    """Status (ok, missing, untracked, mismatch) and both digests of every name in the tree or its manifest."""
    return manifest_diff(read_manifest(spark, manifest), file_digests(spark, root, glob, name))
