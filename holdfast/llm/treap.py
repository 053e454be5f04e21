"""Ranked lexical search over K2-treaps: quadtrees of a term-document grid that store the largest impact below.

Documents are indexed in segments, where they are read; no text is shuffled. A segment's grid has a row for each
term and a column for each document; a point is an occurrence, its value the term's impact in the document. The grid
is a square whose side is a power of two, cut into quadrants down to single points. Only quadrants with points
are kept, in level order: a four-bit mask of its quadrants for each inner node (a node's children follow from the
bits before it), and for each node how much its maximum lies below its parent's. Rows stand in order of document
frequency and columns in order of their most frequent term and length, so that points lie close together.

A search follows the row paths of all terms of an item at once. A state is a range of columns with the node of
each term there; the weighted sum of the nodes' maxima bounds the score of every document in the range. The states
with the highest bounds are halved first; a state of one column has its exact score. States below the lowest
score that can still count are dropped, so the result is exact. That score is carried from segment to segment.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.storage import settle, shared_folder
from holdfast.llm.tokens import open_store, settle_uri

#: A term is a longest run of these characters; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes of terms, lower-cased; all others become spaces.
BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(
    bytes.maketrans(UPPER.encode(), LOWER.encode())
)
#: A segment ends after so many documents or points.
SEGMENT_DOCS, SEGMENT_POINTS = 8_192, 1_000_000
#: States that are halved together; items of one pass over the index.
WAVE, PASS_ITEMS = 128, 2_000
POP = np.array([i.bit_count() for i in range(16)], np.int64)

INDEX = pa.schema(
    [
        ("terms", pa.list_(pa.string())),
        ("df", pa.list_(pa.int64())),
        ("docs", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("top", pa.int64()),
        ("masks", pa.binary()),
        ("drops", pa.binary()),
    ]
)
INDEX_SQL = "terms array<string>, df array<long>, docs array<long>, sizes array<long>, top long, masks binary, drops binary"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(BYTES).split() if text else []


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**31, each moved to twice its place."""
    x = x.astype(np.int64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        x = (x | (x << shift)) & mask
    return x


def compress(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> tuple[list[int], int, np.ndarray, np.ndarray]:
    """Nodes on each level from the root, the largest value, masks of inner nodes and drops of all but the root."""
    side = max(int(rows.max()), int(cols.max()), 1).bit_length()
    codes = spread(rows) << 1 | spread(cols)
    order = np.argsort(codes)
    codes, most = codes[order], values[order]
    sizes, masks, drops = [len(codes)], [], []
    for _ in range(side):
        above = codes >> 2
        first = np.flatnonzero(np.r_[True, above[1:] != above[:-1]])
        low = np.maximum.reduceat(most, first)
        counts = np.diff(np.r_[first, len(codes)])
        masks.append(np.bitwise_or.reduceat((1 << (codes & 3)).astype(np.uint8), first))
        drops.append(np.repeat(low, counts) - most)
        codes, most = above[first], low
        sizes.append(len(codes))
    return sizes[::-1], int(most[0]), np.concatenate(masks[::-1]), np.concatenate(drops[::-1])


class Treap:
    """A segment's tree, read from its row of the index."""

    def __init__(self, sizes: list[int], top: int, masks: np.ndarray, drops: np.ndarray):
        self.side = len(sizes) - 1
        born = POP[masks]
        self.first = np.r_[1 + np.cumsum(born) - born, 0]
        self.most = np.empty(1 + len(drops) + 1, np.int64)
        self.most[0], self.most[-1] = top, 0  # the last stands for "no node"
        inner, at = 0, 1
        for size, below in zip(sizes, sizes[1:]):
            above = np.repeat(self.most[inner : inner + size], born[inner : inner + size])
            self.most[at : at + below] = above - drops[at - 1 : at - 1 + below]
            inner, at = inner + size, at + below
        self.masks = np.r_[masks.astype(np.int64), 0]

    def best(self, rows: np.ndarray, weights: np.ndarray, most: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores that may be among the ``most`` highest, given ``known`` scores from elsewhere."""
        nodes = np.zeros((1, len(rows)), np.int64)
        bound = np.array([self.most[0] * weights.sum()])
        level, col = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cols, scores, least = [], [known], 1
        while True:
            reached = np.concatenate(scores)
            if len(reached) >= most:
                reached = np.partition(reached, len(reached) - most)[len(reached) - most :]
                scores, least = [reached], max(1, int(reached[0]))
            open_ = bound >= least
            if not open_.all():
                nodes, bound, level, col = nodes[open_], bound[open_], level[open_], col[open_]
            if not len(bound):
                break
            if len(bound) > WAVE:
                parted = np.argpartition(bound, len(bound) - WAVE)
                take, keep = parted[-WAVE:], parted[:-WAVE]
            else:
                take, keep = np.arange(len(bound)), np.arange(0)
            at, deep, place = nodes[take], level[take] + 1, col[take]
            left = ((rows >> (self.side - deep)[:, None]) & 1) << 1
            mask, start = self.masks[at], self.first[at]
            has = (mask >> left) & 1
            child = start + POP[mask & ((1 << left) - 1)]
            halves = (np.where(has, child, -1), np.where((mask >> (left + 1)) & 1, child + has, -1))
            nodes = [nodes[keep]]
            bound, level, col = [bound[keep]], [level[keep]], [col[keep]]
            for half, below in enumerate(halves):
                sums, where = self.most[below] @ weights, place << 1 | half
                leaf = deep == self.side
                done, more = leaf & (sums >= least), ~leaf & (sums >= least)
                cols.append((where[done], sums[done]))
                scores.append(sums[done])
                nodes.append(below[more])
                bound.append(sums[more])
                level.append(deep[more])
                col.append(where[more])
            nodes, bound, level, col = (np.concatenate(x) for x in (nodes, bound, level, col))
        found, sums = (np.concatenate(x) for x in zip(*cols)) if cols else (np.arange(0), np.arange(0))
        return found[sums >= least], sums[sums >= least]


class Segment:
    """Gathers documents and turns them into a row of the index."""

    def __init__(self, docs_with_terms: int, all_terms: int, most_docs: int):
        self.docs_with_terms, self.all_terms, self.most_docs = docs_with_terms, all_terms, most_docs
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.lengths, self.terms, self.times, self.points = [], [], [], [], 0

    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or self.points >= SEGMENT_POINTS

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = words(text)
        if not found:
            return
        counted = Counter(found)
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, counted), np.int64, len(counted)))
        self.times.append(np.fromiter(counted.values(), np.int64, len(counted)))
        self.points += len(counted)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        term, times = np.concatenate(self.terms), np.concatenate(self.times)
        each = [len(x) for x in self.terms]
        lead = np.array([t[np.argmax(k)] for t, k in zip(self.terms, self.times)])
        by_col = np.lexsort((self.lengths, lead))
        place = np.empty(len(by_col), np.int64)
        place[by_col] = np.arange(len(by_col))
        cols = np.repeat(place, each)
        spans = [100 - 25 + 25 * n * self.docs_with_terms // self.all_terms for n in self.lengths]
        impact = 1_000_000_000 * times // (1000 * times + 12 * np.repeat(np.array(spans, np.int64), each))
        df = np.bincount(term)
        first = np.full(len(df), len(each))
        np.minimum.at(first, term, cols)
        by_row = np.lexsort((first, -df))
        row = np.empty(len(by_row), np.int64)
        row[by_row] = np.arange(len(by_row))
        sizes, top, masks, drops = compress(row[term], cols, impact)
        names = list(self.vocabulary)
        planes = np.ascontiguousarray(drops.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3])
        zstd = pa.Codec("zstd", 1)
        yield pa.RecordBatch.from_pydict(
            {
                "terms": [[names[i].decode() for i in by_row]],
                "df": [df[by_row]],
                "docs": [[self.ids[i] for i in by_col]],
                "sizes": [sizes],
                "top": [top],
                "masks": [zstd.compress(masks.tobytes(), asbytes=True)],
                "drops": [zstd.compress(planes.tobytes(), asbytes=True)],
            },
            INDEX,
        )
        self.clear()


def load(sizes: list[int], top: int, masks: bytes, drops: bytes) -> Treap:
    zstd, inner, others = pa.Codec("zstd"), sum(sizes[:-1]), sum(sizes[1:])
    planes = np.frombuffer(zstd.decompress(drops, 3 * others), np.uint8).reshape(3, others).astype(np.int64)
    return Treap(sizes, top, np.frombuffer(zstd.decompress(masks, inner), np.uint8), planes[0] | planes[1] << 8 | planes[2] << 16)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have, repeats included."""
    sizes = docs.select(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).alias("n"))
    docs_with_terms, terms = sizes.agg(F.count_if(F.col("n") > 0), F.sum(F.col("n").cast("long"))).head()
    return docs_with_terms, terms or 0


def build_index(docs: DataFrame, docs_with_terms: int, terms: int, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """A row for each segment of ``docs`` (doc_id, text), written. Documents without terms have no column."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(docs_with_terms, terms, segment_docs)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                segment.add(doc_id, text.as_py())
                if segment.full():
                    yield from segment.rows()
        yield from segment.rows()

    return settle(docs.select("doc_id", "text").mapInArrow(build, INDEX_SQL), "search-index")


def weighed_items(items: DataFrame, index: DataFrame, docs_with_terms: int) -> DataFrame:
    """item (a number for each row), item_id and its terms with weights, repeats multiplied in. Written."""
    numbered = settle(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "search-items")
    lower = F.translate("text", UPPER, LOWER)
    terms = numbered.select("item", "item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    terms = settle(terms.groupBy("item", "item_id", "term").agg(F.count("*").alias("times")), "search-terms")
    entries = index.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).select(F.col("e.terms").alias("term"), "e.df")
    asked = terms.select("term").distinct()
    counts = entries.join(asked, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.expr(f"floor(1000 * ln((2 * {docs_with_terms}L + 2) / (2 * df + 1)))")
    weighed = terms.join(counts, "term").select("item", "item_id", "term", (F.col("times") * weight).cast("long").alias("weight"))
    return weighed.filter("weight > 0")


def search(
    docs: DataFrame, items: DataFrame, most: int = 20, segment_docs: int = SEGMENT_DOCS, pass_items: int = PASS_ITEMS
) -> DataFrame:
    """The ``most`` highest-scoring rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Returns item_id, rank, doc_id, score; only scores above 0. Equal scores are in ascending order of doc_id, null
    last. Each row of items is searched on its own, also where an item_id is repeated or null; each row of docs can
    be found, also a repeated one. Null and empty texts have no terms. Without terms, or with empty tables, there is
    no result. Items are searched in passes of about ``pass_items`` over the index.
    """
    spark, (docs_with_terms, terms) = docs.sparkSession, statistics(docs)
    index = build_index(docs, docs_with_terms, terms, segment_docs)
    weighed = weighed_items(items, index, docs_with_terms)
    passes = -(-items.count() // pass_items) or 1
    folder = settle_uri(spark, shared_folder(spark, "search-weights"))
    dealt = weighed.withColumn("pass", F.expr(f"pmod(xxhash64(item), {passes})"))
    dealt.repartition(passes, "pass").sortWithinPartitions("pass", "item", "term").write.partitionBy("pass").parquet(folder)

    def find(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = None
            for batch in batches:
                queries = queries or Queries(folder, part, most)
                for i in range(batch.num_rows):
                    queries.search(batch.slice(i, 1))
            if queries:
                yield queries.found()

        return run

    read = index.select("terms", "docs", "sizes", "top", "masks", "drops")
    found = None
    for part in range(passes):
        rows = read.mapInArrow(find(part), "item long, item_id long, doc_id long, score long")
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("item_id", "rank", "doc_id", "score")


class Queries:
    """The items of a pass and the best rows found for each so far."""

    def __init__(self, folder: str, part: int, most: int):
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, root = open_store(f"{folder}/pass={part}")
        self.most, self.items = most, []
        if store.get_file_info(root).type == fs.FileType.NotFound:
            return
        data = pq.read_table(root, filesystem=store, partitioning=None).sort_by([("item", "ascending"), ("term", "ascending")])
        self.terms = pc.unique(data["term"].combine_chunks())
        own = pc.index_in(data["term"], value_set=self.terms).to_numpy()
        item, weight = data["item"].to_numpy(), data["weight"].to_numpy()
        ids = data["item_id"].to_pylist()
        cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]).tolist() if len(item) else []
        for a, b in zip(cuts, [*cuts[1:], len(item)]):
            self.items.append((int(item[a]), ids[a], own[a:b], weight[a:b]))
        self.best: list[list[tuple]] = [[] for _ in self.items]

    def search(self, row: pa.RecordBatch) -> None:
        if not self.items:
            return
        held = row.column("terms").flatten()
        rows = pc.index_in(self.terms, value_set=held).to_numpy(zero_copy_only=False)
        rows = np.where(np.isnan(rows), -1, rows).astype(np.int64)
        docs = row.column("docs").flatten().to_pylist()
        tree = load(*(row.column(c)[0].as_py() for c in ("sizes", "top", "masks", "drops")))
        for k, (_, _, terms, weights) in enumerate(self.items):
            at = rows[terms]
            here = at >= 0
            if not here.any():
                continue
            known = np.array([-x[0] for x in self.best[k]], np.int64)
            cols, scores = tree.best(at[here], weights[here], self.most, known)
            if len(cols):
                new = [(-s, docs[c] is None, docs[c] or 0) for c, s in zip(cols.tolist(), scores.tolist())]
                self.best[k] = sorted(self.best[k] + new)[: self.most]

    def found(self) -> pa.RecordBatch:
        rows = [
            (item, item_id, None if null else doc, -score)
            for (item, item_id, _, _), best in zip(self.items, self.best if self.items else [])
            for score, null, doc in best
        ]
        columns = list(zip(*rows)) or [[]] * 4
        names = ("item", "item_id", "doc_id", "score")
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)
