"""Query of the binary token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.registry import query
from holdfast.llm.storage import table
from holdfast.llm.tokens import read_records, token_folder, write_records


@query("op10_token_records")
def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_records(docs, token_folder(spark), path, end_id=0)
    return read_records(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
