"""Near-duplicate vectors by a pigeonhole join over low-dimensional blocks of rotated vectors.

For unit vectors, cosine >= c means a squared distance of at most 2 - 2c. A fixed random rotation spreads
differences evenly over the coordinates; the rotated vectors are cut into blocks, and each block gets the part of
that squared distance that its share of the dimensions is due. A linked pair stays within the budget of at least
one block, so a range join in each block finds all links. The range join lays a grid of cells twice as wide as the
block's radius: a point is listed in every cell that its ball meets (at most one neighbour a dimension), and each
other point looks up its own cell. Pairs within a block's budget that no earlier block has found are compared as
whole vectors in double precision. Links are counted and pass on as spanning edges; pairs are never written out.

Vectors are compared inside their group (label and length). Equal vectors are merged first. Each task holds a
bounded number of a group's vectors and streams the others past them. A group beyond ``REGION`` vectors is also cut
at quantiles of each block's leading coordinates; a task then sees only the points whose balls reach its region.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.llm.storage import settle

#: Dimensions of a block at most; a ball meets at most 2 ** BLOCK cells.
BLOCK = 8
#: Vectors of a group that are compared without cutting it; own vectors of a task; visitors in one step.
REGION, CHUNK, STEP = 16_384, 2_048, 4_096
#: Candidate pairs of a block that are looked at together.
PAIRS = 100_000
#: Rounding of distances in the blocks; the comparison of whole vectors decides.
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, least: float) -> list[tuple[slice, float]]:
    """The blocks and the squared distance each may use up, in proportion to its dimensions."""
    count = math.ceil(dim / BLOCK)
    cuts = [round(i * dim / count) for i in range(count + 1)]
    return [(slice(a, b), (2 - 2 * least) * (b - a) / dim + SLACK) for a, b in zip(cuts, cuts[1:])]


class Grid:
    """Points of one block, each listed under every cell that its ball meets."""

    def __init__(self, points: np.ndarray, budget: float):
        self.radius = math.sqrt(budget)
        dims = points.shape[1]
        self.strides = (np.random.default_rng(dims).integers(1, 2**62, dims, dtype=np.int64) << 1) | 1
        place = points / (2 * self.radius)
        cell = np.floor(place)
        inside = place - cell
        side = np.where(inside < 0.5, -1, 1)
        away = (np.where(inside < 0.5, inside, 1 - inside) * 2 * self.radius) ** 2
        subsets = (np.arange(1 << dims)[:, None] >> np.arange(dims)) & 1
        met = away @ subsets.T <= budget + SLACK
        with np.errstate(over="ignore"):
            keys = (cell.astype(np.int64) * self.strides).sum(1)[:, None] + (side * self.strides) @ subsets.T.astype(np.int64)
        point, _ = np.nonzero(met)
        keys = keys[met]
        order = np.argsort(keys, kind="stable")
        self.keys, self.points = keys[order], point[order]

    def pairs(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs (own, visitor) in parts of bounded size."""
        with np.errstate(over="ignore"):
            keys = (np.floor(points / (2 * self.radius)).astype(np.int64) * self.strides).sum(1)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        ends = np.cumsum(high - low)
        at = 0
        while at < len(keys):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            n = (high - low)[at:stop]
            visitor = np.repeat(np.arange(at, stop), n)
            entry = np.arange(len(visitor)) - np.repeat(ends[at:stop] - n - before, n) + np.repeat(low[at:stop], n)
            yield self.points[entry], visitor
            at = stop


class Own:
    """The vectors a task holds: their grids, their links so far and how they hang together."""

    def __init__(self, node: np.ndarray, vectors: np.ndarray, least: float, block: int | None):
        self.node, self.vectors, self.least = node, vectors, least
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.turn = rotation(vectors.shape[1])
        self.rotated = (vectors / self.norms[:, None]) @ self.turn
        self.blocks = blocks_of(vectors.shape[1], least)
        self.grids = {
            j: Grid(self.rotated[:, part], budget)
            for j, (part, budget) in enumerate(self.blocks)
            if block is None or j == block
        }
        self.links = np.zeros(len(node), np.int64)
        self.root = np.arange(len(node))
        self.edges: list[np.ndarray] = []

    def meet(self, node: np.ndarray, vectors: np.ndarray, copies: np.ndarray) -> None:
        norms = np.sqrt((vectors * vectors).sum(1))
        rotated = (vectors / norms[:, None]) @ self.turn
        for j, grid in self.grids.items():
            part, budget = self.blocks[j]
            for own, other in grid.pairs(rotated[:, part]):
                gap = self.rotated[own, part] - rotated[other, part]
                near = (np.einsum("ij,ij->i", gap, gap) <= budget) & (self.node[own] != node[other])
                own, other = own[near], other[near]
                for earlier, most in self.blocks[:j]:  # another block has found these
                    gap = self.rotated[own, earlier] - rotated[other, earlier]
                    new = np.einsum("ij,ij->i", gap, gap) > most
                    own, other = own[new], other[new]
                dots = np.einsum("ij,ij->i", self.vectors[own], vectors[other])
                linked = dots / (self.norms[own] * norms[other]) >= self.least
                self._link(own[linked], other[linked], node, copies)

    def _link(self, own: np.ndarray, other: np.ndarray, node: np.ndarray, copies: np.ndarray) -> None:
        if not len(own):
            return
        np.add.at(self.links, own, copies[other])
        order = np.argsort(other, kind="stable")
        own, other = own[order], other[order]
        first = np.r_[True, other[1:] != other[:-1]]
        lead = own[np.flatnonzero(first)[np.cumsum(first) - 1]]
        self.edges.append(np.stack([node[other[first]], self.node[lead[first]]], 1))
        for pair in np.unique(lead * len(self.node) + own).tolist():
            a, b = (self._top(i) for i in divmod(pair, len(self.node)))
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def _top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def found(self) -> pd.DataFrame:
        """u, v (an edge; the same node twice: its number of links) and n."""
        counted = np.flatnonzero(self.links)
        own = np.stack([self.node[counted], self.node[counted], self.links[counted]], 1)
        tops = np.array([self._top(i) for i in counted.tolist()], np.int64)
        inner = np.stack([self.node[counted], self.node[tops]], 1) if len(counted) else np.zeros((0, 2), np.int64)
        edges = np.unique(np.sort(np.concatenate([inner, *self.edges]), 1), axis=0)
        edges = edges[edges[:, 0] != edges[:, 1]]
        edges = np.concatenate([own, np.c_[edges, np.zeros(len(edges), np.int64)]])
        return pd.DataFrame(edges.astype(np.int64), columns=["u", "v", "n"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


VALID = """label IS NOT NULL AND size(embedding) > 0 AND exists(embedding, x -> x <> 0)
    AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"""
#: Two hashes tell vectors apart; null for those that link with nothing.
KEYS = [
    "*",
    f"CASE WHEN {VALID} THEN xxhash64(label, embedding) END AS h1",
    f"CASE WHEN {VALID} THEN xxhash64(embedding, label) END AS h2",
]


def nodes_of(vectors: DataFrame) -> DataFrame:
    """Each different vector of a label once: node, label, dim, embedding, copies, low (its least vec_id), h1, h2."""
    keyed = vectors.selectExpr(*KEYS).filter("h1 IS NOT NULL")
    merged = keyed.groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.count("*").alias("copies"), F.min("vec_id").alias("low"),
    )
    merged = merged.withColumn("dim", F.size("embedding"))
    return settle(merged.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")


def _routed(nodes: DataFrame, least: float, region: int, chunk: int) -> DataFrame:
    """Rows of ``nodes`` as members and visitors of tasks: label, dim, block, region, part, role (0 own, 1 visitor).

    A group of up to ``region`` vectors is one region for all blocks (block -1). A larger one has regions in each
    block, cut at quantiles of the block's coordinates; a point visits each region that its ball meets. The vectors
    of a region are dealt to parts of about ``chunk``; every part gets all visitors.
    """
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    sized = nodes.join(sizes, ["label", "dim"])
    small = sized.filter(F.col("size") <= region).select(
        "label", "dim", F.lit(-1).alias("block"), F.lit(0).cast("long").alias("region"), F.col("size").alias("held"),
        "node", "embedding", "copies", F.lit(True).alias("home"),
    )
    placed = small
    large = sizes.filter(F.col("size") > region)
    if large.head(1):
        placed = small.unionByName(_cut(sized.filter(F.col("size") > region), large, least, region))
    parts = f"CAST(ceil(held / {chunk}) AS int)"
    base = ["label", "dim", "block", "region", "node", "embedding", "copies"]
    own = placed.filter("home").selectExpr(*base, f"CAST(pmod(xxhash64(node), {parts}) AS int) AS part", "0 AS role")
    visit = placed.selectExpr(*base, f"explode(sequence(0, {parts} - 1)) AS part", "1 AS role")
    return own.unionByName(visit)


def _cut(nodes: DataFrame, sizes: DataFrame, least: float, region: int) -> DataFrame:
    """``nodes`` of large groups in every region of every block that their balls meet."""
    points = "label, dim, node, copies, embedding, size, block int, place array<double>"
    names = [x.split()[0] for x in points.split(", ")]
    kinds = nodes.schema

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                whole = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
                unit = whole / np.sqrt((whole * whole).sum(1))[:, None] @ rotation(int(dim))
                for j, (part, _) in enumerate(blocks_of(int(dim), least)):
                    yield rows.assign(block=j, place=list(unit[:, part]))[names]

    schema = ", ".join(f"{f} {kinds[f].dataType.simpleString()}" for f in names[:6]) + ", block int, place array<double>"
    turned_rows = nodes.select(*names[:6]).mapInPandas(turned, schema)
    # Each level halves the regions at a median of the next coordinate; the quantiles split evenly, whatever the order.
    quantiles = (
        turned_rows.select("label", "dim", "block", "size", F.posexplode("place").alias("axis", "x"))
        .withColumn("levels", F.ceil(F.log2(F.col("size") / region)).cast("int"))
        .withColumn("width", F.expr(f"least({BLOCK}, dim)"))
        .withColumn("cuts", F.expr("shiftleft(1, (levels + width - 1 - axis) div width) - 1"))
        .filter("cuts > 0")
        .groupBy("label", "dim", "block", "axis", "cuts")
        .agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 1000).alias("q"))
        .withColumn("q", F.expr("transform(sequence(1, least(cuts, 63)), i -> q[CAST(round(64 * i / (least(cuts, 63) + 1)) AS int) - 1])"))
        .groupBy("label", "dim", "block")
        .agg(F.sort_array(F.collect_list(F.struct("axis", "q"))).alias("axes"))
    )
    joined = turned_rows.join(settle(quantiles, "vector-cuts"), ["label", "dim", "block"])
    # A ball meets the cells of an axis between those of its two ends; over all axes, those within the radius.
    joined = joined.withColumn("radius", F.expr(f"sqrt({2 - 2 * least} * size(place) / dim + {SLACK})"))
    cell = "aggregate(a.q, 0, (n, c) -> n + CASE WHEN {x} >= c THEN 1 ELSE 0 END)"
    reach = (
        "transform(axes, a -> struct("
        + cell.format(x="place[a.axis]")
        + " AS home, "
        + cell.format(x="place[a.axis] - radius")
        + " AS low, "
        + cell.format(x="place[a.axis] + radius")
        + " AS high, size(a.q) + 1 AS n))"
    )
    joined = joined.withColumn("reach", F.expr(reach))
    joined = joined.withColumn("home_region", F.expr("aggregate(reach, 0L, (r, a) -> r * a.n + a.home)"))
    regions = "aggregate(reach, array(0L), (rs, a) -> flatten(transform(rs, r -> transform(sequence(a.low, a.high), c -> r * a.n + c))))"
    joined = settle(joined.withColumn("regions", F.expr(regions)).drop("reach", "axes", "place"), "vector-regions")
    held = joined.groupBy("label", "dim", "block", F.col("home_region").alias("region")).agg(F.count("*").alias("held"))
    visits = joined.withColumn("region", F.explode("regions")).withColumn("home", F.expr("region = home_region"))
    visits = visits.join(held, ["label", "dim", "block", "region"])
    return visits.select("label", "dim", "block", "region", "held", "node", "embedding", "copies", "home")


def links(nodes: DataFrame, least: float, region: int = REGION, chunk: int = CHUNK) -> DataFrame:
    """u, v, n: for u = v, the rows that a task found linked to node u; else an edge that joins linked nodes."""
    key = ["label", "dim", "block", "region", "part"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, held = None, None, []
        for batch in batches:
            heads = pd.DataFrame({c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*key, "role"]})
            turns = np.flatnonzero((heads != heads.shift()).any(axis=1).to_numpy())
            for a, b in zip(turns, [*turns[1:], len(heads)]):
                task, role = tuple(heads.loc[a, key]), heads.loc[a, "role"]
                rows = batch.slice(a, b - a)
                node = rows.column("node").to_numpy()
                vectors, copies = _matrix(rows.column("embedding")), rows.column("copies").to_numpy()
                if task != current:
                    if own:
                        yield from _batches(own.found())
                    current, own, held = task, None, []
                if role == 0:
                    held.append((node, vectors))
                    continue
                if own is None:
                    if not held:
                        continue
                    own = Own(
                        np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), least,
                        None if task[2] < 0 else int(task[2]),
                    )
                    held = []
                for at in range(0, len(node), STEP):
                    own.meet(node[at : at + STEP], vectors[at : at + STEP], copies[at : at + STEP])
        if own:
            yield from _batches(own.found())

    routed = _routed(nodes, least, region, chunk)
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps small tasks apart
    dealt = routed.repartition(tasks, *key).sortWithinPartitions(*key, "role", "node")
    return dealt.mapInArrow(compare, "u long, v long, n long")


def _batches(frame: pd.DataFrame) -> list[pa.RecordBatch]:
    return pa.Table.from_pandas(frame, preserve_index=False).to_batches()


def near_duplicates(vectors: DataFrame, least: float = 0.98, region: int = REGION, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine in double precision is at least ``least``;
    vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. n_links counts rows, equal vectors included. component_id is the least vec_id reachable,
    null if none of the rows has one; kept is whether it is the row's own. Rows that share a vec_id are told apart
    by their vectors. An empty table gives none.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    nodes = nodes_of(rows)
    found = settle(links(nodes, least, region, chunk), "vector-links")
    counts = found.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("linked"))
    group = settle(components(found.filter("u <> v").select("u", "v")), "vector-groups")
    named = nodes.select("node", "h1", "h2", "copies", "low").join(counts, "node", "left").join(group, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = settle(named.join(least_id, "component").select("h1", "h2", "copies", "linked", "component_id"), "vector-named")
    joined = rows.selectExpr(*KEYS).select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
