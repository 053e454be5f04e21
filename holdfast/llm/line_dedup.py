"""Drop lines that an earlier document already has; the result is a keep bitmap, not text.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Keys go by two
64-bit hashes. Rows (hash, document, position) are range-partitioned by hash and sorted by document and
position, so one streaming pass sees each key's first document first. A key that makes up a noticeable
share of all lines would fill one partition; such keys are recognised in a sample, which only decides
their way: for them the first document is a map-side minimum. Only SQL expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.storage import settle

SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with over this share of the sampled lines takes the pre-aggregated way.
HOT_SHARE = 0.002
SAMPLE = 0.02


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(-1))


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, version, pos, h, h2 for each line whose key is long enough."""
    lines = docs.filter("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("version"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        "doc_id", "version", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), F.col("key")).alias("h2")
    )


def duplicate_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, version, pos of every line whose key a smaller doc_id also has."""
    lines = settle(_keyed_lines(docs, min_chars), "line-keys")
    seen = lines.sample(fraction=SAMPLE, seed=11).groupBy("h").agg(F.count("*").alias("n"))
    sampled = seen.agg(F.sum("n")).head()[0] or 0
    # At most 1 / HOT_SHARE keys pass, so the list is bounded whatever the input.
    hot = settle(seen.filter(F.col("n") > max(sampled * HOT_SHARE, 20)).select(F.col("h").alias("hot_h")), "line-hot")
    marked = lines.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left")
    cold = marked.filter("hot_h IS NULL").drop("hot_h").repartitionByRange("h")
    first = F.first("doc_id").over(
        Window.partitionBy("h", "h2")
        .orderBy("doc_id", "pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    later = cold.withColumn("first_doc", first).filter("doc_id > first_doc").select("doc_id", "version", "pos")
    warm = marked.filter("hot_h IS NOT NULL").drop("hot_h")
    firsts = warm.groupBy(F.col("h").alias("f_h"), F.col("h2").alias("f_h2")).agg(F.min("doc_id").alias("first_doc"))
    again = (
        warm.join(firsts, (F.col("h") == F.col("f_h")) & (F.col("h2") == F.col("f_h2")))
        .filter("doc_id > first_doc")
        .select("doc_id", "version", "pos")
    )
    return later.unionByName(again)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, version, drops: the sparse bitmap of each document that loses lines.

    ``drops`` maps a word index to 64 bits; a set bit is a dropped line, and words without one are left
    out. Documents that keep every line have no row. ``version`` is a hash of the text, so two texts under
    one doc_id stay apart; they count as one document for what repeats.
    """
    words = (
        duplicate_lines(docs, min_chars)
        .groupBy("doc_id", "version", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    )
    return words.groupBy("doc_id", "version").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Adds n_lines, n_dropped and kept (the text that stays) to ``docs``.

    Null or empty text is one empty line, which stays. A null doc_id keeps every line and takes no part.
    """
    named = bitmaps.select(
        F.col("doc_id").alias("b_doc_id"), F.col("version").alias("b_version"), F.col("drops").alias("b_drops")
    )
    same = (F.col("doc_id") == F.col("b_doc_id")) & (F.xxhash64("text") == F.col("b_version"))
    dropped = F.coalesce(
        F.aggregate(F.map_values("b_drops"), F.lit(0), lambda acc, bits: acc + F.bit_count(bits)), F.lit(0)
    )
    kept = F.when(
        F.col("b_drops").isNull(), F.coalesce(F.col("text"), F.lit(""))
    ).otherwise(
        F.array_join(
            F.filter(
                lines_of(F.col("text")),
                lambda line, i: F.coalesce(
                    F.getbit(F.element_at("b_drops", F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))), F.lit(0)
                )
                == 0,
            ),
            "\n",
        )
    )
    return docs.join(named, same, "left").select(
        *[docs[c] for c in docs.columns],
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
