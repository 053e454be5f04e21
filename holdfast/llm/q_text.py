"""Queries over whole texts: language ID and decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontaminate, language
from holdfast.llm.registry import query
from holdfast.llm.storage import table


def id_remainder(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder(4) == 2
    network = language.train(docs, ~held_out)
    named = language.identify(docs.select("doc_id", "text"), network)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
