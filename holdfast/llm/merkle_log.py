"""A Merkle manifest of a dataset, kept as a log of tree nodes in postorder.

Each tree holds the leaves of one group in order. While several nodes remain, every two consecutive ones
become their hash; a last odd one is hashed alone. Its nodes are logged in the order in which they are
complete, which is postorder: a node follows its subtree. A full subtree of level k has ``2**(k + 1) - 1``
nodes and ``s`` leaves of full subtrees have left ``2 * s - popcount(s)`` nodes in the log, so the place of
any node follows from its level, its index and the number of leaves alone (``log_position``).

Builders take aligned blocks of leaves: a block's nodes lie together in the log and are one row of
``segments``. Nodes above the blocks are built from the blocks' last nodes by builders of the same kind, round
by round, and are rows of ``uppers``. A proof reads its siblings inside the block from the segment, the others
from ``uppers`` by log position; the upper ones are looked up once for each block, not for each leaf.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.storage import settle

BLOCK_BITS = 10
WIDTH = 32
NONE = b"\0" * WIDTH


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return (n - 1).bit_length() if n > 1 else 0


def subtree_size(leaves: int, level: int) -> int:
    return sum((leaves + (1 << k) - 1) >> k for k in range(level + 1))


def log_position(level: int, index: int, n: int) -> int:
    """Place in the postorder log of node ``index`` of ``level`` in a tree of ``n`` leaves."""
    start = index << level
    return 2 * start - start.bit_count() + subtree_size(min(1 << level, n - start), level) - 1


def position_sql(level: str, index: str, n: str) -> str:
    """``log_position`` as SQL text."""
    start = f"shiftleft({index}, {level})"
    width = f"shiftleft(1L, {level})"
    partial = (
        f"aggregate(sequence(0, {level}), 0L, (__a, __l) -> __a + shiftright({n} - {start} + shiftleft(1L, __l) - 1, __l))"
    )
    return (
        f"2 * {start} - bit_count({start}) - 1"
        f" + CASE WHEN {start} + {width} <= {n} THEN 2 * {width} - 1 ELSE {partial} END"
    )


def hash_of(*digests: bytes) -> bytes:
    """Hash of digests given and returned as hex text."""
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def grow(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level from the leaves up, ``levels`` times."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([hash_of(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def completion_order(rows: list[list[bytes]]) -> list[bytes]:
    """Nodes of an aligned block, by level, in the order in which they are complete."""
    out, last = [], len(rows[0]) - 1
    for j, leaf in enumerate(rows[0]):
        out.append(leaf)
        for level in range(1, len(rows)):
            if (j + 1) % (1 << level) and j != last:
                break
            out.append(rows[level][j >> level])
    return out


UPPER = "tree long, n long, level int, at long, pos long, digest binary"


@dataclass
class Log:
    """segments: tree, n, block, base (place of the first node), nodes; uppers: tree, n, level, at, pos, digest."""

    segments: DataFrame
    uppers: DataFrame
    block_bits: int

    def roots(self) -> DataFrame:
        """tree, n, root of every tree."""
        return self.uppers.filter(f"level = {_height_sql('n')}").select("tree", "n", F.col("digest").alias("root"))


def _height_sql(n: str) -> str:
    return f"CASE WHEN {n} > 1 THEN length(bin({n} - 1)) ELSE 0 END"


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``at``, the place of each row in its group from 0, and ``n``, the group's rows.

    Rows are dealt in ranges of group and order, nulls first, and numbered inside each range; counts for each
    group and range give the rest, so a group of any size spreads over as many ranges as it needs.
    """
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = settle(
        dealt.withColumn("__turn", F.monotonically_increasing_id()).withColumn("__range", F.spark_partition_id()),
        "numbered",
    )
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "__range").agg(F.min("__turn").alias("__first"), F.count("*").alias("__rows"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    counts = counts.withColumn("n", F.sum("__rows").over(Window.partitionBy(*group)))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*group, "__range"]]
    found = dealt.alias("d").join(counts.alias("c"), reduce(lambda a, b: a & b, same))
    at = (F.col("d.__turn") - F.col("c.__first") + F.col("c.__before")).alias("at")
    return found.select(*[F.col(f"d.{c}") for c in df.columns], at, F.col("c.n"))


def build_log(leaves: DataFrame, block_bits: int = BLOCK_BITS) -> Log:
    """The log of the trees over ``leaves``: tree, n, at (0 to n - 1 without gaps), digest (32 bytes)."""

    def block(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        tree, number, n = int(pdf["tree"].iloc[0]), int(pdf["block"].iloc[0]), int(pdf["n"].iloc[0])
        rows = grow([d.hex().encode() for d in pdf["digest"]], min(block_bits, height(n)))
        start = number << block_bits
        return pd.DataFrame(
            {
                "tree": [tree],
                "n": [n],
                "block": [number],
                "base": [2 * start - start.bit_count()],
                "nodes": [bytes.fromhex(b"".join(completion_order(rows)).decode())],
            }
        )

    def upper(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        tree, n, below, first = (int(pdf[c].iloc[0]) for c in ("tree", "n", "level", "at"))
        rows = grow([d.hex().encode() for d in pdf["digest"]], min(block_bits, height(n) - below))
        found = [
            (tree, n, below + k, (first >> k) + i, log_position(below + k, (first >> k) + i, n), bytes.fromhex(d.decode()))
            for k, row in enumerate(rows)
            if k
            for i, d in enumerate(row)
        ]
        return pd.DataFrame(found, columns=["tree", "n", "level", "at", "pos", "digest"])

    placed = leaves.select("tree", "n", "at", "digest", F.expr(f"shiftright(at, {block_bits})").alias("block"))
    segments = settle(
        placed.groupBy("tree", "block").applyInPandas(block, "tree long, n long, block long, base long, nodes binary"),
        "merkle-segments",
    )
    level = F.expr(f"least({block_bits}, {_height_sql('n')})").cast("int").alias("level")
    last = F.expr(f"substring(nodes, length(nodes) - {WIDTH - 1}, {WIDTH})").alias("digest")
    tops = segments.select("tree", "n", level, F.col("block").alias("at"), last)
    place = F.expr(position_sql("level", "at", "n")).alias("pos")
    tops = settle(tops.select("tree", "n", "level", "at", place, "digest"), "merkle-tops")
    most = segments.agg(F.max("n")).head()[0] or 0
    rounds = [tops]
    for base in range(block_bits, height(most), block_bits):
        ready = rounds[-1].filter(f"level = {base} AND {_height_sql('n')} > {base}")
        ready = ready.withColumn("block", F.expr(f"shiftright(at, {block_bits})"))
        made = ready.groupBy("tree", "block").applyInPandas(upper, UPPER)
        rounds.append(settle(made, "merkle-uppers"))
    return Log(segments, reduce(DataFrame.unionByName, rounds), block_bits)


def upper_siblings(log: Log) -> DataFrame:
    """tree, block and ``above``: the siblings of the block's node, level by level to the root, 32 bytes each."""
    bits = log.block_bits
    steps = log.segments.select("tree", "n", "block").withColumn("top", F.expr(_height_sql("n")))
    steps = steps.filter(f"top > {bits}").withColumn("level", F.explode(F.expr(f"sequence({bits}, top - 1)")))
    steps = steps.withColumn("sibling", F.expr(f"shiftright(block, level - {bits}) ^ 1L"))
    exists = "shiftleft(sibling, level) < n"
    steps = steps.withColumn("pos", F.expr(f"CASE WHEN {exists} THEN {position_sql('level', 'sibling', 'n')} END"))
    found = steps.join(log.uppers.select("tree", "pos", "digest"), ["tree", "pos"], "left")
    listed = F.sort_array(F.collect_list(F.struct("level", F.coalesce("digest", F.lit(NONE)).alias("digest"))))
    return found.groupBy("tree", "block").agg(
        F.aggregate(listed, F.lit(b""), lambda a, x: F.concat(a, x["digest"])).alias("above")
    )


def fold(leaf: bytes, siblings: list[tuple[str, bytes]]) -> bytes:
    """The root that a leaf and its siblings ("L" on its left, "R" on its right, "-" none) give, as hex text."""
    for side, other in siblings:
        leaf = hash_of(other, leaf) if side == "L" else hash_of(leaf, other) if side == "R" else hash_of(leaf)
    return leaf


def sides(at: int, n: int) -> str:
    """For each level, the side of the sibling on the path from leaf ``at``."""
    return "".join(
        "L" if at >> k & 1 else "R" if ((at >> k) + 1) << k < n else "-" for k in range(height(n))
    )


PROOF = (
    "tree long, at long, name long, digest binary, sides string, siblings binary, proof_sha256 string, "
    "folded binary, subroot binary"
)


def proofs(leaves: DataFrame, log: Log, beyond: DataFrame | None = None) -> DataFrame:
    """The path of each leaf to the root, what it folds to, and the path's digest.

    ``leaves``: tree, n, at, name (carried along), digest and claimed, the digest that is folded in place of the
    leaf's. ``beyond`` (tree, sides, siblings, subroot) goes on from each tree's root. Siblings have 32 bytes a
    level, zeros where there is none. The siblings above a block are looked up once for all its leaves.
    """
    bits = log.block_bits

    def walk(key: tuple[Any, ...], rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        tree, n, base, nodes, above, more, further, subroot = block.iloc[0][
            ["tree", "n", "base", "nodes", "above", "more", "further", "subroot"]
        ]
        n, base = int(n), int(base)
        local = min(bits, height(n))
        shared = (above or b"") + (further or b"")
        found = []
        for at, name, digest, claimed in zip(rows["at"], rows["name"], rows["digest"], rows["claimed"]):
            at = int(at)
            path = sides(at, n)
            own = []
            for k in range(local):
                place = WIDTH * (log_position(k, (at >> k) ^ 1, n) - base) if path[k] != "-" else -1
                own.append(nodes[place : place + WIDTH] if place >= 0 else NONE)
            siblings = b"".join(own) + shared
            path += more or ""
            others = [siblings[i : i + WIDTH].hex().encode() for i in range(0, len(siblings), WIDTH)]
            steps = list(zip(path, others, strict=True))
            proof = hashlib.sha256(b"".join(x for side, x in steps if side != "-")).hexdigest()
            folded = bytes.fromhex(fold(claimed.hex().encode(), steps).decode())
            found.append((int(tree), at, name, digest, path, siblings, proof, folded, subroot))
        out = pd.DataFrame(found, columns=[c.split()[0] for c in PROOF.split(", ")])
        return out.astype({"name": "Int64"})

    blocks = log.segments.join(upper_siblings(log), ["tree", "block"], "left")
    if beyond is None:
        beyond = log.roots().select("tree", F.lit("").alias("sides"), F.lit(b"").alias("siblings"), F.col("root").alias("subroot"))
    further = beyond.select("tree", F.col("sides").alias("more"), F.col("siblings").alias("further"), "subroot")
    blocks = blocks.join(further, "tree")
    rows = leaves.select("tree", "at", "name", "digest", "claimed", F.expr(f"shiftright(at, {bits})").alias("block"))
    return rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(walk, PROOF)


def leaf_sql(**changed: str) -> str:
    """Hex digest of a documents row: each column as its byte count, a colon and its value, or ``-`` for null."""
    parts = []
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        value = f"CAST({changed.get(name, name)} AS string)"
        parts.append(f"coalesce(concat(octet_length({value}), ':', {value}), '-')")
    return f"sha2(concat({', '.join(parts)}), 256)"


def manifest(docs: DataFrame, tampered: str | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Manifest of ``docs``: a tree for each lang, by ascending doc_id, and a tree over their roots by lang.

    ``tampered`` is a SQL condition; rows that meet it are verified as if n_chars were one more. Columns:
    doc_id, leaf, subroot, root, proof_sha256, folded_root (hex text), verified. Null doc_ids and langs come
    first, rows with equal doc_id are in order of their leaves; each row is a leaf, a repeated one too. An empty
    table has no rows. Columns beyond the five are ignored. Texts are hashed where they are read; only digests
    are shuffled.
    """
    claimed = f"CASE WHEN {tampered} THEN unhex({leaf_sql(n_chars='n_chars + 1')}) END" if tampered else "CAST(NULL AS binary)"
    leaves = docs.select(
        "doc_id", "lang", F.expr(f"unhex({leaf_sql()})").alias("digest"), F.expr(claimed).alias("claimed")
    )
    placed = numbered(leaves, ["lang"], ["doc_id", "digest"])
    groups = settle(placed.groupBy("lang").agg(F.max("n").alias("rows")), "merkle-groups")
    trees = numbered(groups, [], ["lang"]).select("lang", F.col("at").alias("tree"), F.col("n").alias("trees"))
    trees = settle(trees, "merkle-trees")
    placed = placed.alias("p").join(trees.alias("t"), F.col("p.lang").eqNullSafe(F.col("t.lang")))
    claim = F.coalesce("p.claimed", "p.digest").alias("claimed")
    placed = settle(placed.select("t.tree", "p.n", "p.at", F.col("p.doc_id").alias("name"), "p.digest", claim), "merkle-leaves")
    log = build_log(placed, block_bits)
    tops = trees.join(log.roots(), "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("at"),
        F.col("tree").alias("name"), F.col("root").alias("digest"), F.col("root").alias("claimed"),
    )
    tops = settle(tops, "merkle-subroots")
    crown = build_log(tops, block_bits)
    top_proofs = proofs(tops, crown)
    beyond = top_proofs.select(F.col("at").alias("tree"), "sides", "siblings", F.col("digest").alias("subroot"))
    root = crown.roots().head()
    root = F.lit(root["root"].hex() if root else None).cast("string")
    found = proofs(placed, log, settle(beyond, "merkle-beyond"))
    text = {c: F.lower(F.hex(c)).alias(c) for c in ("digest", "subroot", "folded", "siblings")}
    return found.select(
        F.col("name").alias("doc_id"),
        text["digest"].alias("leaf"),
        text["subroot"],
        root.alias("root"),
        "proof_sha256",
        text["folded"].alias("folded_root"),
        (F.lower(F.hex("folded")) == root).alias("verified"),
        "sides",
        text["siblings"],
    )
