"""The number of links of each document, counted inside the classes of the Jaccard join.

Links exist only inside a class, so its different sets are compared there and nowhere else. A class is dealt
into blocks of bounded members and shingles; each pair of blocks is one group, whose common shingles are
counted for all its pairs at once by a matrix product over the shingles that at least two members hold. Only a
sum for each set leaves the group: no pair is ever a row. The work still grows with the square of a class's
different sets, in groups that run anywhere; equal sets count as one with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.jaccard import _small
from holdfast.llm.shingles import set_id, shingle_sets
from holdfast.llm.storage import settle

#: Sets and shingles of a block, on average; columns of one matrix product.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 2048


def linked_copies(sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """For each set, the copies of the others it links with; if ``left`` differs, only across the two sides."""
    n = np.array([len(s) for s in sets])
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    inside = not len(a) or not len(b)
    if inside:
        a = b = np.arange(len(sets))
    values, at, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = holders > 1
    column = (np.cumsum(shared) - 1)[at]
    keep = shared[at]
    row, column = np.repeat(np.arange(len(sets)), n)[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(a), len(b)))
    for first in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[lo:hi], column[lo:hi] - first] = 1
        both += held[a] @ held[b].T
    linked = 100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)
    if inside:
        np.fill_diagonal(linked, False)
    found = np.zeros(len(sets), np.int64)
    found[a] += linked @ copies[b]
    if not inside:
        found[b] += copies[a] @ linked
    return found


def with_links(
    docs: DataFrame, classes: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Adds n_links to ``classes``, the stored result of ``jaccard_classes`` for ``docs`` (doc_id, text).

    n_links counts the other rows linked directly, equal sets included. Null, empty or blank text, and a null
    doc_id: 0. Repeated rows, and different texts under one doc_id, count each as a row of their own.
    """
    sets = settle(
        classes.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"),
            F.min("component_id").alias("family"), F.count("*").alias("copies"),
        ),
        "link-sets",
    )
    families = settle(
        sets.groupBy(F.col("family").alias("f"))
        .agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
        .filter("n > 1")
        .select("f", F.expr(f"1 + greatest((n - 1) div {block}, least(total div {block_shingles}, n - 1))").alias("blocks")),
        "link-families",
    )
    dealt = (
        sets.join(families, F.col("family") == F.col("f"))
        .withColumn("own", F.expr("pmod(xxhash64(set_id), blocks)"))
        .join(docs.select("doc_id", "text"), F.col("rep") == F.col("doc_id"))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select(
            "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "set_id",
            "copies", "text",
        )
        .repartition("family", "x", "y")
        .sortWithinPartitions("family", "x", "y", "set_id")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, seen = None, [], set()

        def close():
            if group is None or len(held) < 2:
                return None
            left = np.array([own == group[1] for own, *_ in held])
            if group[1] != group[2] and (left.all() or not left.any()):
                return None  # the other block is empty
            copies = np.array([c for _, _, c, _ in held])
            return [i for _, i, _, _ in held], linked_copies([t for *_, t in held], copies, left, percent)

        for rows in _small(batches):
            out = []
            keys = zip(rows["family"], rows["x"], rows["y"])
            for key, own, name, n, tokens in zip(keys, rows["own"], rows["set_id"], rows["copies"], shingle_sets(rows["text"], width)):
                if key != group:
                    out.append(close())
                    group, held, seen = key, [], set()
                if name not in seen and set_id(tokens) == name:  # else another text under the same doc_id
                    seen.add(name)
                    held.append((own, name, n, tokens))
            yield _frame(out)
        yield _frame([close()])

    found = dealt.mapInPandas(count, "set_id long, links long").groupBy(F.col("set_id").alias("s"))
    found = settle(found.agg(F.sum("links").alias("links")), "links")
    counted = sets.join(found, F.col("set_id") == F.col("s"), "left").select(
        F.col("set_id").alias("c"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")
    )
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return classes.join(counted, F.col("set_id") == F.col("c"), "left").select(
        *[classes[c] for c in classes.columns],
        F.when(alone, F.lit(0)).otherwise(F.col("n")).cast("long").alias("n_links"),
    )


def _frame(parts: list) -> pd.DataFrame:
    parts = [p for p in parts if p is not None]
    ids = np.concatenate([np.empty(0, np.int64), *[np.array(i, np.int64) for i, _ in parts]])
    return pd.DataFrame({"set_id": ids, "links": np.concatenate([np.empty(0, np.int64), *[n for _, n in parts]])})
