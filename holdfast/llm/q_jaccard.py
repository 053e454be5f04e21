"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.jaccard import jaccard_classes
from holdfast.llm.links import with_links
from holdfast.llm.registry import query
from holdfast.llm.storage import settle, table


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classes = settle(jaccard_classes(docs, width=5, percent=80), "jaccard-classes")
    return with_links(docs, classes, width=5, percent=80).select("doc_id", "n_shingles", "component_id", "n_links")
