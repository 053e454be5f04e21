"""Document fingerprints: a Merkle tree over passages, paragraphs and sections.

A paragraph is a line with its line break. Its passages, the leaves, are runs of sentences of at least
``PASSAGE`` characters; a sentence without an end is cut after a word. A section ends at an empty line or
after a paragraph whose hash falls below a fixed bound (one in eight), so sections fall into step again
behind an edit. The leaves joined are the text, so equal roots mean equal texts.

A fingerprint is text: the root, then for each section its digest and paragraphs, for each paragraph its
digest and passages, for each passage its digest and length: ``root:S{P=leaf.len,leaf.len;P=...}...``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PASSAGE = 24
SECTION_BOUND = 32
_SENTENCE = re.compile(r"[^.!?\n]{0,200}[^.!?\n ]*(?:[.!?]+ ?| |\n|$)")
FINGERPRINTS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def passages(text: str) -> Iterator[list[str]]:
    """The passages of each paragraph."""
    paragraph: list[str] = []
    held, size = [], 0
    for sentence in _SENTENCE.findall(text):
        if not sentence:
            continue
        held.append(sentence)
        size += len(sentence)
        if size >= PASSAGE or sentence[-1] == "\n":
            paragraph.append("".join(held))
            held, size = [], 0
            if sentence[-1] == "\n":
                yield paragraph
                paragraph = []
    if held:
        paragraph.append("".join(held))
    if paragraph:
        yield paragraph


def _node(kind: bytes, children: list[bytes]) -> bytes:
    return hashlib.sha256(kind + b"".join(children)).digest()


def fingerprint(text: str) -> str:
    sections: list[tuple[bytes, str]] = []
    digests: list[bytes] = []
    written: list[str] = []

    def close():
        digest = _node(b"s", digests)
        sections.append((digest, f"{digest.hex()[:10]}{{{';'.join(written)}}}"))
        digests.clear()
        written.clear()

    for paragraph in passages(text):
        leaves = [hashlib.sha256(b"l" + p.encode("utf-8", "surrogatepass")).digest() for p in paragraph]
        digest = _node(b"p", leaves)
        digests.append(digest)
        body = ",".join([f"{leaf.hex()[:10]}.{len(p)}" for leaf, p in zip(leaves, paragraph)])
        written.append(f"{digest.hex()[:10]}={body}")
        if paragraph == ["\n"] or digest[0] < SECTION_BOUND:
            close()
    if digests:
        close()
    return f"{_node(b'r', [d for d, _ in sections]).hex()}:{''.join(s for _, s in sections)}"


def root(mark: str) -> str:
    return mark.partition(":")[0]


def branches(mark: str) -> list[tuple[str, list[tuple[str, list[tuple[str, int]]]]]]:
    """Sections as (digest, paragraphs), paragraphs as (digest, passages), passages as (digest, length)."""
    out = []
    for section in mark.partition(":")[2].split("}")[:-1]:
        digest, _, body = section.partition("{")
        paragraphs = []
        for one in body.split(";"):
            name, _, rest = one.partition("=")
            pairs = (x.partition(".") for x in rest.split(","))
            paragraphs.append((name, [(d, int(n)) for d, _, n in pairs]))
        out.append((digest, paragraphs))
    return out


def leaves(mark: str) -> list[tuple[str, int]]:
    pairs = (x.partition(".") for x in re.findall(r"[0-9a-f]{10}\.\d+", mark.partition(":")[2]))
    return [(d, int(n)) for d, _, n in pairs]


def likeness(a: str, b: str) -> float:
    """Share of the characters of both documents in passages they have in common, 0 to 1."""
    if root(a) == root(b):
        return 1.0
    x, y = leaves(a), leaves(b)
    total = sum(n for _, n in x) + sum(n for _, n in y)
    common = Counter(x) & Counter(y)
    return 2.0 * sum(n * k for (_, n), k in common.items()) / total if total else 1.0


def differences(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where two texts differ: (start, end) in the first and in the second, in characters.

    Compares sections first and goes down only into those that differ.
    """
    if root(a) == root(b):
        return []
    out: list[tuple[int, int, int, int]] = []

    def flat(nodes, level):
        return [x for _, kids in nodes for x in (kids if level else [(_, kids)])]

    def size(node) -> int:
        return node[1] if isinstance(node[1], int) else sum(size(k) for k in node[1])

    def descend(x: list, y: list, at: int, bt: int, level: int) -> None:
        px, py = [at], [bt]
        for n in x:
            px.append(px[-1] + size(n))
        for n in y:
            py.append(py[-1] + size(n))
        match = SequenceMatcher(None, [n[0] for n in x], [n[0] for n in y], autojunk=False)
        for op, i, j, k, m in match.get_opcodes():
            if op == "equal":
                continue
            if level < 2:
                descend(flat(x[i:j], 1), flat(y[k:m], 1), px[i], py[k], level + 1)
            else:
                out.append((px[i], px[j], py[k], py[m]))

    descend(branches(a), branches(b), 0, 0, 0)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_id_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, body, part, turn: texts by ascending doc_id in each part, and behind each part the next
    part's first document (turn 1; behind the last part the first document of all).

    Parts are ranges between quantiles of doc_id; only ids are read to set them up.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    cuts = [int(c) for c in cuts]
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    part = F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))
    heads = ids.select("doc_id", part.alias("part")).groupBy("part").agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owners = heads.select(
        "part", F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("ghost")
    )
    body = F.coalesce("text", F.lit("")).alias("body")
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", body)
    firsts = (  # one id for each range at most, so a broadcast spares the texts a shuffle
        texts.join(F.broadcast(owners.select("ghost").distinct()), F.col("doc_id") == F.col("ghost"))
        .groupBy(F.col("ghost").alias("g"))
        .agg(F.min("body").alias("body"))
    )
    ghosts = owners.join(firsts, F.col("ghost") == F.col("g")).select(
        F.col("ghost").alias("doc_id"), "body", "part", F.lit(1).alias("turn")
    )
    rows = texts.select("doc_id", "body", part.alias("part"), F.lit(0).alias("turn")).unionByName(ghosts)
    return rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "turn", "doc_id", "body")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text) and of its edited text, and their likeness.

    The edited text ends in the start of the next document's by ascending doc_id; after the last comes the
    first, and one document alone follows itself. Null text is empty. Rows with one doc_id follow each
    other by text, each with its own result. A row with a null doc_id is followed by an empty text.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (part, doc_id, text, fingerprint) of the last document
        for batch in batches:
            out = []
            for doc_id, text, part, turn in zip(batch["doc_id"], batch["body"], batch["part"], batch["turn"]):
                mark = fingerprint(text)
                if held is not None and held[0] == part:
                    out.append(_result(held[1], held[2], held[3], text, mark))
                held = None if turn else (part, doc_id, text, mark)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FINGERPRINTS.split(", ")])

    def lonely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = fingerprint("")
        for batch in batches:
            out = [_result(None, t, fingerprint(t), "", nothing) for t in batch["body"]]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in FINGERPRINTS.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    without_id = docs.filter("doc_id IS NULL").select(F.coalesce("text", F.lit("")).alias("body"))
    found = in_id_ranges(docs.select("doc_id", "text")).mapInPandas(compare, FINGERPRINTS)
    return found.unionByName(without_id.mapInPandas(lonely, FINGERPRINTS))


def _result(doc_id: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following)
    changed_mark = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (
        doc_id, len(text), digest, mark, changed_mark, likeness(mark, changed_mark), likeness(mark, next_mark),
    )
