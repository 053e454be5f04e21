"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a fixed random order and laid end to end, as often as its target
needs; that stream is cut into blocks of ``block_words`` words. Slot j of the schedule takes the point
frac((j + 1) * golden ratio) and maps it through the cumulative source weights; the k-th slot of a
source takes its k-th block. Blocks of a source that finds too few slots follow at the end, so each
source gets its target to the word. Only SQL expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.storage import settle

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
#: Slots ranked in one window group.
CHUNK = 65_536
#: Cells of the unit interval in which slots meet sources.
CELLS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all words.
    A target stops at ``most`` times its source's size; the excess is shared again by weight. That fixed
    point is closed-form: in ascending order of limit / weight, the sources at their limit come first.
    A source without words has target 0. The window is over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")
        ).cast("long"),
    ).withColumn("most", F.col("source_size") * most)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(
        F.col("most").cast("double") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = (
        weighed.withColumn("budget", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("level", level)
        .withColumn("full", F.col("most").cast("double") / F.col("weight") <= F.col("level"))
    )
    rest = F.col("all_weight") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(every)
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(every)
    return (
        leveled.withColumn("share_of_one", F.when(rest > 0, left / F.nullif(rest, F.lit(0))))
        .withColumn(
            "target",
            F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("share_of_one") * F.col("weight")),
        )
        .select("source", "source_size", "weight", "target")
    )


def place(sizes: DataFrame) -> DataFrame:
    """Adds bucket, seq and start: each row's place in its source's shuffled order.

    The order is by md5 of the id (of source and size, where the id is null), then id and size. A source is
    summed in 4096 buckets of that hash, so no task sorts a whole source.
    """
    unnamed = F.concat(F.lit("null "), F.xxhash64("source", "size").cast("string"))
    mixed = sizes.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), unnamed))).withColumn(
        "bucket", F.substring("turn", 1, 3)
    )
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size")
    sums = mixed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("o_source"),
        F.col("bucket").alias("o_bucket"),
        F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)).alias("offset"),
    )
    ranked = mixed.withColumn("seq", F.row_number().over(inside)).withColumn(
        "within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    return ranked.join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))
    ).select(*sizes.columns, "bucket", "seq", (F.col("offset") + F.col("within")).alias("start"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """source, rank, slot: the slots that take each source's blocks; blocks not listed come last."""
    spark = targets.sparkSession
    every = Window.orderBy(F.col("source").asc_nulls_last())
    parts = targets.withColumn("blocks", F.ceil(F.floor("target") / block_words)).filter("blocks > 0")
    total = F.sum("blocks").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.sum("blocks").over(every.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select(
        "source", "blocks", ((upto - F.col("blocks")) / total).alias("lo"), (upto / total).alias("hi"), total.alias("slots")
    )
    row = parts.agg(F.max("slots")).head()
    slots = int(row[0] or 0)
    cells = parts.select(
        "*",
        F.explode(
            F.sequence(
                F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long"))
            )
        ).alias("cell"),
    )
    points = (
        spark.range(slots)
        .select(F.col("id").alias("slot"), F.expr(f"((id + 1) * {GOLDEN}D) % 1.0D").alias("point"))
        .withColumn("cell", F.floor(F.col("point") * CELLS))
    )
    taken = (
        points.join(cells, "cell")
        .filter("point >= lo AND point < hi")
        .select("source", "blocks", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    )
    counts = taken.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    sums = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("source").alias("c_source"),
        F.col("chunk").alias("c_chunk"),
        F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("earlier"),
    )
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    return (
        taken.withColumn("nth", F.row_number().over(inside))
        .join(counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("chunk") == F.col("c_chunk")))
        .withColumn("rank", F.col("earlier") + F.col("nth") - 1)
        .filter("rank < blocks")
        .select("source", "rank", "slot")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block_words: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """(placed documents, pieces of the mix).

    ``docs`` has doc_id, source and text or size. Placed: doc_id, source, size, source_size, target,
    bucket, seq, start, and any other column of ``docs`` but text. (source, bucket, seq) names a row.
    Pieces: source, bucket, seq, slot, rank, pass, from_word, words: words of a document in a block, in
    schedule order by slot.

    Null text or no word: size 0 and no piece. Null doc_id: ordered by source and size. A null source is a
    source of its own. Repeated rows are separate documents. No document is taken more than ``most`` times.
    """
    if "size" not in docs.columns:
        docs = docs.select(*[c for c in docs.columns if c != "text"], word_count(F.col("text")).alias("size"))
    sizes = settle(docs, "mix-sizes")
    targets = settle(source_targets(sizes, weights, share, most), "mix-targets")
    named = targets.withColumnRenamed("source", "t_source").drop("weight")
    placed = settle(
        place(sizes)
        .join(named, F.col("source").eqNullSafe(F.col("t_source")))
        .drop("t_source"),
        "mix-placed",
    )
    quota = F.floor("target")
    begins = F.col("start") + F.col("pass") * F.col("source_size")
    pieces = (
        placed.filter("size > 0")
        .select(
            "source", "bucket", "seq", "size", "start", "source_size", quota.alias("quota"),
            F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"),
        )
        .withColumn("begins", begins)
        .withColumn("ends", F.least(F.col("begins") + F.col("size"), F.col("quota")))
        .filter("begins < ends")
        .withColumn(
            "rank",
            F.explode(F.sequence(F.floor(F.col("begins") / block_words), F.floor((F.col("ends") - 1) / block_words))),
        )
        .withColumn("from", F.greatest(F.col("begins"), F.col("rank") * block_words))
        .withColumn("words", F.least(F.col("ends"), (F.col("rank") + 1) * block_words) - F.col("from"))
    )
    slots = schedule(targets, block_words).select(
        F.col("source").alias("s_source"), F.col("rank").alias("s_rank"), "slot"
    )
    last = F.lit(2**62).cast("long")
    pieces = pieces.join(
        slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("rank") == F.col("s_rank")), "left"
    ).select(
        "source", "bucket", "seq", F.coalesce("slot", last + F.col("rank")).alias("slot"), "rank", "pass",
        (F.col("from") - F.col("begins")).alias("from_word"), "words",
    )
    return placed, pieces


def taken_words(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Placed rows with ``taken`` (words in the mix), ``copies`` (passes that take any word), first_slot, last_slot.

    The slots are those of the row's first and last piece in schedule order; null for a row not taken.
    """
    sums = pieces.groupBy(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), F.col("seq").alias("p_seq")).agg(
        F.sum("words").alias("taken"), F.count_distinct("pass").alias("copies"),
        F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"),
    )
    same = (
        F.col("source").eqNullSafe(F.col("p_source"))
        & (F.col("bucket") == F.col("p_bucket"))
        & (F.col("seq") == F.col("p_seq"))
    )
    return placed.join(sums, same, "left").select(
        *placed.columns,
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("copies", F.lit(0)).cast("int").alias("copies"),
        "first_slot", "last_slot",
    )


def scheduled_copies(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """A row for each pass over a placed row that takes any word: placed columns, pass and slot.

    ``slot`` is the place in the schedule of the copy's first block.
    """
    first = pieces.groupBy(
        F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), F.col("seq").alias("p_seq"), "pass"
    ).agg(F.min("slot").alias("slot"))
    same = (
        F.col("source").eqNullSafe(F.col("p_source"))
        & (F.col("bucket") == F.col("p_bucket"))
        & (F.col("seq") == F.col("p_seq"))
    )
    return placed.join(first, same).select(*placed.columns, "pass", "slot")
