"""The corpus pipeline: stages over ``documents``, each written as Parquet and read as the next one's input.

Every stage but the last returns the columns of documents. Null and empty texts end at the language stage,
which keeps only texts in a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontaminate, jaccard, language, mixing, tokens
from holdfast.llm.storage import settle, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language of the table; noise and other languages go.

    An empty table, or one without lang, stays empty.
    """
    network = language.train(docs.select("doc_id", "text", "lang"), F.lit(True))
    labelled = docs.withColumn("__label", language.label_column(network, judge=True))
    return labelled.filter("__label.familiar").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near copies: by doc_id, null last, then by hashes of text and row.

    Different texts under one doc_id, or under a null one, are compared each on its own. Texts without a word
    are no near copies; of rows with the same doc_id and text, one stays.
    """
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not docs.filter("doc_id IS NULL").head(1) and not repeated.head(1):
        return docs.join(_near_copies(docs.select("doc_id", "text")), "doc_id", "left_anti").select(*docs.columns)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), _row_hash(docs)]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = settle(dealt.withColumn("__row", F.monotonically_increasing_id()), "near-copies-rows")
    named = numbered.filter("doc_id IS NOT NULL")
    first = named.groupBy("doc_id", F.md5("text")).agg(F.min("__row").alias("__row")).select("__row")
    single = settle(numbered.join(first, "__row").unionByName(numbered.filter("doc_id IS NULL")), "near-copies-once")
    gone = _near_copies(single.select(F.col("__row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "__row")
    return single.join(gone, "__row", "left_anti").select(*docs.columns)


def _row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row; maps, which Spark does not hash, go by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes])


def _near_copies(docs: DataFrame) -> DataFrame:
    """doc_id of each document that has a near copy, or a chain of them, with a smaller doc_id."""
    classes = jaccard.jaccard_classes(docs, width=5, percent=80)
    return settle(classes.filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes any of its words, written in the order of the schedule.

    That is not at all, once or twice; each copy stands at the slot of its first block.
    """
    row = _row_hash(docs).alias("__row")
    keys = [F.col("doc_id").alias("__id"), F.col("source").alias("__source"), row]
    named = docs.select("doc_id", "source", "text", row)
    taken = settle(
        mixing.scheduled_copies(*mixing.mix(named)).select(
            F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("__row").alias("t_row"),
            F.col("pass").alias("__pass"), F.col("slot").alias("__slot"), F.col("bucket").alias("__bucket"),
            F.col("seq").alias("__seq"),
        ),
        "mix-copies",
    )
    named_once = taken.groupBy("t_id", "t_source", "t_row", "__pass").count().filter("count = 1")
    repeated = taken.count() > named_once.count()
    rows = docs.select(*docs.columns, *keys)
    rows = rows.dropDuplicates(["__id", "__source", "__row"]) if repeated else rows
    same = (
        F.col("__id").eqNullSafe(F.col("t_id"))
        & F.col("__source").eqNullSafe(F.col("t_source"))
        & (F.col("__row") == F.col("t_row"))
    )
    order = ["__slot", "__bucket", "__seq", "__pass"]
    return rows.join(taken, same).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what reading them back gives."""
    import public_tokenizers

    manifest = tokens.write_records(
        docs, tokens.token_folder(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )
    return tokens.read_records(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminated),
    ("mixing", mix_sources),
    ("token_records", write_tokens),
]
#: Models, edit distances and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
