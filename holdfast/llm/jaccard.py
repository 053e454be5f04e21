"""Exact Jaccard self-join of word-shingle sets by universe-partition pigeonhole.

Method. Sets go to size bands whose limits grow by 1 / threshold, so a partner is in the same band or the
next. Two linked sets differ in at most ``H`` shingles, so when a hash deals the shingles of a band into
``m > H`` segments, at least ``m - H`` segments are equal. The index holds one signature for each segment.

Allocation by cost. A segment without shingles is equal in a large part of its band, so its list is as long
as the band; it gets no budget. ``m`` has a few segments to spare, and a pair is found without the empty
ones unless both sets have more empty segments than their spare ones. Such sets raise the budget of their
other segments to two: they also enter the one-deletion neighbourhoods of those segments, which finds each
segment with at most one difference. That covers a pair as long as twice the filled segments exceed ``H``;
the few sets (tiny ones) for which they don't look up the empty segments too.

Exact copies share a set id and count as one. In a bucket of equal signatures each member meets the least
member, not every other; verified links are joined into components. Buckets that still hold several
components then test, for each two of them, the closest pair by parity sketch, and at last every pair left
that the sketch cannot exclude. So no link is lost and a large group costs a star, not its square. A
sketch is the parity of the shingles' hash bits: its distance is a lower bound of the sets' difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm import worker
from holdfast.llm.components import components
from holdfast.llm.shingles import U, mix, overlap, set_id, shingle_sets
from holdfast.llm.storage import settle

#: Words of 64 bits in a sketch: of sets below WIDE_FROM shingles, and of larger ones.
SKETCH, WIDE_SKETCH, WIDE_FROM = 16, 256, 2048
#: Members of a bucket compared in one block, and members sent along with one leader's text.
BLOCK, CHUNK = 1024, 256
#: Roles of a signature in its bucket, kept in its two lowest bits.
INDEX, PROBE, HOLLOW, HOLLOW_PROBE = 0, 1, 2, 3

SETS = "doc_id long, n_shingles long, set_id long, sketch array<long>, wide_sketch array<long>"


def band_edges(percent: int, most: int = 1 << 40) -> list[int]:
    """First size of each band; a partner of a set is in its band or the next."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent + 1))
    return edges


class Bands:
    def __init__(self, percent: int):
        self.percent = percent
        self.edges = np.array(band_edges(percent))

    def budget(self, size: int) -> int:
        """The most shingles by which a linked pair with a set of this size can differ."""
        return size * (100 - self.percent) // self.percent

    def segments(self, band: int) -> int:
        budget = self.budget(int(self.edges[band + 1]) - 1)
        return budget + 1 + (budget * 3 // 100 + 1 if budget else 0)

    def signatures(self, tokens: np.ndarray) -> Iterator[np.ndarray]:
        size = len(tokens)
        if not size:
            return
        band = int(np.searchsorted(self.edges, size, "right")) - 1
        if self.budget(size):  # else only equal sets are linked, and those share a set id
            yield self._signatures(tokens, band, INDEX, self.budget(size))
        if band and -(-size * self.percent // 100) < self.edges[band]:
            smaller = int(self.edges[band]) - 1
            most = (smaller + size) * (100 - self.percent) // (100 + self.percent)
            if self.budget(smaller):
                yield self._signatures(tokens, band - 1, PROBE, min(most, self.budget(smaller)))

    def _signatures(self, tokens: np.ndarray, band: int, role: int, budget: int) -> np.ndarray:
        m = self.segments(band)
        salt = mix(np.array([band + 1, (band + 1) << 20], np.uint64))
        value = mix(tokens ^ salt[0])
        segment = ((value >> U(33)) * U(m) >> U(31)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], mix(value[order] + U(1))
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sums, filled = np.add.reduceat(value, starts), segment[starts]
        name = mix(np.arange(m, dtype=np.uint64) + salt[1])
        found = [self._sign(sums, name[filled], role)]
        empty = m - len(filled)
        if empty > m - 1 - budget:
            counts = np.diff(np.r_[starts, len(value)])
            keep = np.repeat(counts > 1, counts)
            less = np.repeat(sums, counts)[keep] - value[keep]
            found.append(self._sign(less, name[segment[keep]], role))
            hollow = name[np.setdiff1d(np.arange(m), filled)]
            found.append(self._sign(np.zeros(len(hollow), np.uint64), hollow, HOLLOW))
            if 2 * len(filled) < budget + 1:
                found.append(self._sign(np.zeros(len(hollow), np.uint64), hollow, HOLLOW_PROBE))
        return np.concatenate(found)

    @staticmethod
    def _sign(sums: np.ndarray, name: np.ndarray, role: int) -> np.ndarray:
        return ((mix(sums ^ name) & ~U(3)) | U(role)).view(np.int64)


def _sketch(tokens: np.ndarray, words: int) -> np.ndarray:
    bits = (tokens * U(0xD6E8FEB86659FD93) >> U(40)).astype(np.int64) % (64 * words)
    odd = (np.bincount(bits, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _small(batches, step: int = 1000):
    worker.enter("jaccard")
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.iloc[at : at + step]
    worker.trim()


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id and sketches of each document."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _small(batches):
            n, ids, near, wide = [], [], [], []
            for tokens in shingle_sets(rows["text"], width):
                n.append(len(tokens))
                ids.append(set_id(tokens))
                near.append(_sketch(tokens, SKETCH) if 0 < len(tokens) < WIDE_FROM else None)
                wide.append(_sketch(tokens, WIDE_SKETCH) if len(tokens) >= WIDE_FROM * 3 // 4 else None)
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"].array, "n_shingles": n, "set_id": ids,
                    "sketch": pd.Series(near, dtype=object).array, "wide_sketch": pd.Series(wide, dtype=object).array,
                }
            )

    return docs.select("doc_id", "text").mapInPandas(make, SETS)


def signature_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """sig, set_id: a row for each signature; copies met in one task give their rows once."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, seen = Bands(percent), set()
        for rows in _small(batches):
            sigs, ids = [], []
            for tokens in shingle_sets(rows["text"], width):
                own = set_id(tokens)
                if own in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(own)
                for found in bands.signatures(tokens):
                    sigs.append(found)
                    ids.append((own, len(found)))
            if sigs:
                yield pd.DataFrame(
                    {"sig": np.concatenate(sigs), "set_id": np.repeat([i for i, _ in ids], [k for _, k in ids])}
                )

    return docs.select("text").mapInPandas(make, "sig long, set_id long")


def shared_buckets(signatures: DataFrame) -> DataFrame:
    """bucket, role, set_id, leader for buckets with several sets of which one may lead."""
    bucket = Window.partitionBy("bucket")
    leads = F.expr(f"role = {INDEX} OR role = {HOLLOW_PROBE}")
    return (
        signatures.select(
            F.expr("shiftright(sig, 2)").alias("bucket"), F.expr("cast(sig & 3 AS int)").alias("role"), "set_id"
        )
        .withColumn("leader", F.min(F.when(leads, F.col("set_id"))).over(bucket))
        .withColumn("low", F.min("set_id").over(bucket))
        .withColumn("high", F.max("set_id").over(bucket))
        .filter("low < high AND leader IS NOT NULL")
        .select("bucket", "role", "set_id", "leader")
        .distinct()
    )


def verify(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked pairs among ``pairs`` (a, b), compared by their whole sets.

    The members of each ``a`` come in chunks, each with one copy of its text ahead of them; a task holds
    one leader's set at a time.
    """
    known = sets.select(F.col("set_id").alias("k"), F.col("n_shingles").alias("n"))
    sized = (
        pairs.join(known, F.col("a") == F.col("k")).withColumnRenamed("n", "n_a").drop("k")
        .join(known, F.col("b") == F.col("k")).withColumnRenamed("n", "n_b").drop("k")
        .filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .select("a", "b")
    )
    sized = settle(sized, "jaccard-sized")
    members_of = sized.groupBy(F.col("a").alias("l")).agg(F.count("*").alias("n"))
    part = F.expr(f"pmod(b, 1 + n div {CHUNK})").alias("part")
    sized = settle(sized.join(members_of, F.col("a") == F.col("l")).select("a", "b", part), "jaccard-pairs")
    wanted = sized.select(F.col("a").alias("w")).union(sized.select("b")).distinct()
    named = wanted.join(sets.select("set_id", "rep"), F.col("w") == F.col("set_id")).select("set_id", "rep")
    bodies = settle(
        texts.select("doc_id", "text").join(named, F.col("doc_id") == F.col("rep")).select("set_id", "text"),
        "jaccard-texts",
    )
    leaders = sized.select("a", "part").distinct().join(bodies, F.col("a") == F.col("set_id"))
    members = sized.join(bodies, F.col("b") == F.col("set_id"))
    rows = (
        leaders.select("a", "part", F.col("a").alias("b"), F.lit(0).alias("turn"), "text")
        .unionByName(members.select("a", "part", "b", F.lit(1).alias("turn"), "text"))
        .repartition("a", "part")
        .sortWithinPartitions("a", "part", "turn")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead, own = None, None
        for rows in _small(batches):
            linked = []
            for a, b, tokens in zip(rows["a"], rows["b"], shingle_sets(rows["text"], width)):
                if set_id(tokens) != b:
                    continue  # another text under the same doc_id
                if a == b:
                    lead, own = a, tokens
                    continue
                if lead != a:
                    raise RuntimeError("a leader's text is missing")
                both = overlap(own, tokens)
                if 100 * both >= percent * (len(own) + len(tokens) - both):
                    linked.append((a, b))
            yield pd.DataFrame(linked, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(compare, "a long, b long")


def _open_buckets(buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, dealt into block pairs of bounded size."""
    bucket = Window.partitionBy("bucket")
    named = labels.select(F.col("node"), F.col("component"))
    still = (
        buckets.select("bucket", "role", "set_id")
        .join(named, F.col("set_id") == F.col("node"), "left")
        .select("bucket", "role", "set_id", F.coalesce("component", "set_id").alias("comp"))
        .withColumn("low", F.min("comp").over(bucket))
        .withColumn("high", F.max("comp").over(bucket))
        .filter("low < high")
        .withColumn("blocks", F.expr(f"1 + (count(*) OVER (PARTITION BY bucket)) div {BLOCK}"))
    )
    own = F.expr("pmod(xxhash64(set_id), blocks)")
    dealt = still.withColumn("own", own).withColumn(
        "other", F.explode(F.expr("sequence(0L, cast(blocks - 1 AS bigint))"))
    )
    facts = sets.select(F.col("set_id").alias("k"), F.col("n_shingles").alias("n"), "sketch", "wide_sketch")
    return (
        dealt.join(facts, F.col("set_id") == F.col("k"))
        .select(
            "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "role",
            "set_id", "comp", "n", "sketch", "wide_sketch",
        )
        .repartition("bucket", "x", "y")
        .sortWithinPartitions("bucket", "x", "y")
    )


def _close_pairs(members: DataFrame, percent: int, nearest_only: bool) -> DataFrame:
    """a, b, c_a, c_b, gap: pairs of different components that sizes and sketches allow."""

    names = ["a", "b", "c_a", "c_b", "gap"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            group = rows[["bucket", "x", "y"]].to_numpy()
            turns = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            cut = turns[-1] if len(turns) else 0
            if cut:
                yield pairs_of(rows.iloc[:cut], np.r_[turns[:-1], cut])
            held = rows.iloc[cut:]
        if held is not None and len(held):
            yield pairs_of(held, np.array([len(held)]))

    def pairs_of(rows: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
        """Compares each row with the next, the one after it and so on, for all groups at once."""
        ids, comp, n = rows["set_id"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy()
        role, own = rows["role"].to_numpy(), rows["own"].to_numpy()
        crossed = (rows["x"] != rows["y"]).to_numpy()
        end = np.repeat(ends, np.diff(np.r_[0, ends]))
        sketches = []
        for column, words in (("sketch", SKETCH), ("wide_sketch", WIDE_SKETCH)):
            have = rows[column].notna().to_numpy()
            at = np.full(len(rows), -1)
            at[have] = np.arange(have.sum())
            bits = np.concatenate([np.empty(0, np.int64), *rows[column].to_numpy()[have]]).reshape(-1, words)
            sketches.append((at, bits.view(np.uint64)))
        out = [np.empty((0, 5), np.int64)]
        first, step = np.arange(len(rows)), 0
        while True:
            step += 1
            first = first[first + step < end[first]]
            if not len(first):
                break
            i, j = first, first + step
            low, high = np.minimum(role[i], role[j]), np.maximum(role[i], role[j])
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (comp[i] != comp[j]) & (100 * small >= percent * large) & ~(crossed[i] & (own[i] == own[j]))
            ok &= (low == INDEX) & (high <= PROBE) | (low >= HOLLOW) & (high == HOLLOW_PROBE)
            i, j, both = i[ok], j[ok], (small + large)[ok]
            most = both - 2 * -(-percent * both // (100 + percent))
            gap = np.full(len(i), -1)
            for at, bits in sketches:
                fit = (gap < 0) & (at[i] >= 0) & (at[j] >= 0)
                gap[fit] = np.bitwise_count(bits[at[i[fit]]] ^ bits[at[j[fit]]]).sum(axis=1, dtype=np.int64)
            near = gap <= most
            i, j = i[near], j[near]
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            c, d = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
            out.append(np.column_stack([a, b, c, d, gap[near]]))
        found = pd.DataFrame(np.concatenate(out), columns=names).drop_duplicates(["a", "b"])
        if nearest_only:
            found = found.sort_values(["gap", "a", "b"]).drop_duplicates(["c_a", "c_b"])
        return found

    return members.mapInPandas(find, "a long, b long, c_a long, c_b long, gap long")


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id of each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links; two documents link when
    100 * |A and B| >= percent * |A or B|. Fewer than ``width`` words make one shingle. Null, empty or
    blank text: an empty set, linked with nothing, and its own doc_id. Repeated rows keep their own row, and
    texts that share a doc_id are compared each on its own. A row with a null doc_id takes no part; its
    component_id is null.
    """
    docs = docs.select("doc_id", "text")
    known = docs.filter("doc_id IS NOT NULL")
    table = settle(shingle_table(docs, width), "shingle-sets")
    sets = settle(
        table.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"),
            F.max("sketch").alias("sketch"), F.max("wide_sketch").alias("wide_sketch"),
        ),
        "shingle-classes",
    )
    buckets = settle(shared_buckets(signature_rows(known, width, percent)), "jaccard-buckets")
    tested = settle(
        buckets.filter("set_id <> leader").select(
            F.least("set_id", "leader").alias("a"), F.greatest("set_id", "leader").alias("b")
        ).distinct(),
        "jaccard-star",
    )
    links = [settle(verify(tested, sets, known, width, percent), "jaccard-links")]
    for nearest in (True, False):
        labels = _labels(links)
        close = _close_pairs(_open_buckets(buckets, labels, sets), percent, nearest)
        if nearest:
            group = Window.partitionBy("c_a", "c_b").orderBy("gap", "a", "b")
            close = close.withColumn("place", F.row_number().over(group)).filter("place = 1")
        fresh = close.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        fresh = settle(fresh, "jaccard-close")
        links.append(settle(verify(fresh, sets, known, width, percent), "jaccard-links"))
        tested = settle(tested.unionByName(fresh), "jaccard-tested") if nearest else tested
    labels = _labels(links)
    classes = (
        sets.select("set_id", "rep")
        .join(labels, F.col("set_id") == F.col("node"), "left")
        .select("set_id", "rep", F.coalesce("component", "set_id").alias("comp"))
    )
    least = classes.groupBy(F.col("comp").alias("c")).agg(F.min("rep").alias("component_id"))
    named = classes.join(least, F.col("comp") == F.col("c")).select(F.col("set_id").alias("s"), "component_id")
    return table.join(named, F.col("set_id") == F.col("s"), "left").select(
        "doc_id", "n_shingles", "set_id",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
        .otherwise(F.col("doc_id"))
        .alias("component_id"),
    )


def _labels(links: list[DataFrame]) -> DataFrame:
    edges = reduce(DataFrame.unionByName, links).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return settle(components(edges), "jaccard-labels")
