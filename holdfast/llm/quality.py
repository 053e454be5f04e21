"""Document quality by cumulative-link (ordinal logistic) regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector shared by all grades and one threshold
between each two of them, kept in order by fitting their gaps as exponentials. x holds frequencies of
hashed byte trigrams and of hashed words, and one-hot bins of a few shape measures. The fit is Adam in
numpy, on the driver, over at most ``MAX_RATED`` rated documents in the order of a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.shingles import BUFFER, U, word_hashes

MAX_RATED = 6_000
TRIGRAMS = 1 << 13
WORDS = 1 << 13
BINS = 24
SHAPES = 4
WIDTH = TRIGRAMS + WORDS + BINS * SHAPES
#: Frequencies are multiplied by this, so that weights stay near one.
SCALE = 8.0


def _groups(texts: list[str | None]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if group and size + len(raw) > BUFFER:
            yield group
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield group


def _slots(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slots and their text edges, word slots and theirs, and the shape slots of each text."""
    buffer = b"\n\n".join(group) + b"\n\n"
    raw = np.frombuffer(buffer, np.uint8).astype(np.uint32)
    edges = np.cumsum([0, *(len(g) + 2 for g in group)])
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    trigrams = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    words, starts = word_hashes(buffer)
    cuts = np.searchsorted(starts, edges)
    word_slots = (words % U(WORDS)).astype(np.int64)
    shapes = np.empty((len(group), SHAPES), np.int64)
    for i, g in enumerate(group):
        own = words[cuts[i] : cuts[i + 1]]
        n = max(1, len(own))
        letters = sum(map(g.count, (b"!", b"#", b"%", b"$", b"|", b"*", b"&"))) / n
        measures = (
            len(np.unique(own)) / n * 16, min(len(g) / n, 24), np.log2(1 + len(own)), min(letters * 8, 23),
        )
        shapes[i] = [TRIGRAMS + WORDS + BINS * j + int(min(BINS - 1, m)) for j, m in enumerate(measures)]
    return trigrams, edges, word_slots, cuts, shapes


def sparse_rows(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text."""
    out = []
    for group in _groups(texts):
        trigrams, edges, words, cuts, shapes = _slots(group)
        for i in range(len(group)):
            t, n = np.unique(trigrams[edges[i] : max(edges[i], edges[i + 1] - 4)], return_counts=True)
            w, m = np.unique(words[cuts[i] : cuts[i + 1]], return_counts=True)
            values = [SCALE * n / max(1, n.sum()), SCALE * m / max(1, m.sum()), np.ones(SHAPES)]
            out.append((np.concatenate([t, w + TRIGRAMS, shapes[i]]), np.concatenate(values)))
    return out


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(
        cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = 30, batch: int = 256,
        rate: float = 0.05, decay: float = 1e-4, seed: int = 3,
    ) -> Ordinal:
        kinds = sorted(set(grades.tolist()))
        y = np.searchsorted(kinds, grades)
        share = np.clip(np.cumsum(np.bincount(y, minlength=len(kinds)))[:-1] / len(y), 1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
        gaps = np.log(np.maximum(np.diff(start), 1e-2))
        w, head, tail = np.zeros(WIDTH), start[:1].copy(), gaps
        sizes = np.array([len(s) for s, _ in rows])
        slots, values = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        rng = np.random.default_rng(seed)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, head, tail)]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                pick = order[at : at + batch]
                spans = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in pick])
                owner = np.repeat(np.arange(len(pick)), sizes[pick])
                s, v = slots[spans], values[spans]
                eta = np.bincount(owner, w[s] * v, len(pick))
                theta = np.concatenate([head, head + np.cumsum(np.exp(tail))])
                d_eta, d_theta = cls._slopes(eta, theta, y[pick])
                grads = [
                    np.bincount(s, v * d_eta[owner], WIDTH) / len(pick) + decay * w,
                    np.array([d_theta.sum() / len(pick)]),
                    np.array([d_theta[j + 1 :].sum() for j in range(len(tail))]) * np.exp(tail) / len(pick),
                ]
                step += 1
                pace = rate * (1 - 0.9 * epoch / epochs)
                for p, g, (m1, m2) in zip((w, head, tail), grads, state):
                    m1 += 0.1 * (g - m1)
                    m2 += 0.01 * (g * g - m2)
                    p -= pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        return cls(kinds, w, np.concatenate([head, head + np.cumsum(np.exp(tail))]))

    @staticmethod
    def _slopes(eta: np.ndarray, theta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the negative log-likelihood with respect to eta (each row) and theta (summed)."""
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        up = 1 / (1 + np.exp(-np.clip(edge[y + 1] - eta, -40, 40)))
        down = 1 / (1 + np.exp(-np.clip(edge[y] - eta, -40, 40)))
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        d_theta = np.zeros(len(theta) + 2)
        np.add.at(d_theta, y + 1, -du)
        np.add.at(d_theta, y, dd)
        return du - dd, d_theta[1:-1]

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= g) for each grade but the lowest, a row for each text."""
        eta = np.concatenate([np.empty(0), *(self._linear(g) for g in _groups(texts))])
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None, :], -40, 40)))

    def _linear(self, group: list[bytes]) -> np.ndarray:
        trigrams, edges, words, cuts, shapes = _slots(group)
        sums = np.concatenate([[0], np.cumsum(self.weights[trigrams])])
        ends = np.maximum(edges[:-1], edges[1:] - 4)
        word_sums = np.concatenate([[0], np.cumsum(self.weights[TRIGRAMS + words])])
        return (
            SCALE * (sums[ends] - sums[edges[:-1]]) / np.maximum(1, ends - edges[:-1])
            + SCALE * (word_sums[cuts[1:]] - word_sums[cuts[:-1]]) / np.maximum(1, np.diff(cuts))
            + self.weights[shapes].sum(axis=1)
        )


def train(docs: DataFrame, ratings: DataFrame, learn: Column, max_rated: int = MAX_RATED) -> Ordinal | None:
    """A model of ``ratings`` (doc_id, grade) over the texts of ``docs``; None without two grades.

    ``learn`` says which rows of ratings may be used. Null grades are left out; of several, the highest counts.
    """
    known = (
        ratings.filter(learn & F.col("grade").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rated)
        .select(F.col("doc_id").alias("r_doc_id"), "grade")
    )

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = sparse_rows(list(batch["text"]))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "grade": batch["grade"],
                    "slots": [s.astype("<i4").tobytes() for s, _ in rows],
                    "values": [v.astype("<f4").tobytes() for _, v in rows],
                }
            )

    rated = docs.join(F.broadcast(known), F.col("doc_id") == F.col("r_doc_id")).select("doc_id", "grade", "text")
    got = rated.mapInPandas(rows_of, "doc_id long, grade int, slots binary, values binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["slots"])))
    if len({r["grade"] for r in got}) < 2:
        return None
    rows = [(np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["values"], "<f4").astype(float)) for r in got]
    return Ordinal.fit(rows, np.array([r["grade"] for r in got]))


def rating_column(model: Ordinal | None, at_least: int) -> Column:
    """Struct (expected_grade, tail): the expected grade and P(grade >= at_least) of the column ``text``.

    Null and empty texts are rated as texts without words. Without a model both are null.
    """

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if model is None:
                yield pd.DataFrame({"expected_grade": [None] * len(texts), "tail": [None] * len(texts)}, dtype=float)
                continue
            tails = model.tails([None if t is None else t for t in texts])
            steps = np.diff(model.grades)
            above = [i for i, g in enumerate(model.grades[1:]) if g >= at_least]
            tail = tails[:, above[0]] if above else np.zeros(len(texts))
            if at_least <= model.grades[0]:
                tail = np.ones(len(texts))
            yield pd.DataFrame({"expected_grade": model.grades[0] + tails @ steps, "tail": tail})

    return F.pandas_udf(rate, "expected_grade double, tail double")("text")
