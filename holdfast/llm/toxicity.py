"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a text: densities and counts of lexicon words (a fixed list of insults; words, and word starts,
that labelled toxic texts use significantly often), how many of them stand near a second-person word,
densities of second-person words, capitals, marks and digits, and words that match a lexicon only after
undoing look-alike signs. All are computed for many texts at once from word hashes.

Training takes at most ``MAX_LABELLED`` labelled rows in the order of a hash of their ids, in ``FOLDS``
folds. The learned words (counted in Spark) that a row's features use come from the other folds, and so do
the trees whose scores calibrate; the final words and trees come from all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.shingles import BUFFER, BYTE_VALUES, word_hashes
from holdfast.llm.storage import settle

MAX_LABELLED = 18_000
#: Learned words kept, the most used first.
MAX_LEARNED = 20_000
FOLDS = 3
STEM = 5
NEAR = 5
# Plain insults, second-person words of the larger European languages, look-alike signs.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools loser losers pathetic "
    "worthless trash garbage scum clown disgusting disgrace filthy ugly hate kill bastard bitch crap shit "
    "bullshit asshole fuck fucking retard retarded imbecile cretin vermin parasite pig swine whore slut"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure tu te toi "
    "ton ta tes vous votre vos tus ti tuyo usted ustedes vosotros vuestro"
).split()
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FEATURES = (
    "insult_density insult_count learned_density learned_count stem_density stem_count near_second_person "
    "second_person_density capitals exclamations questions other_marks digits obfuscated_density long_runs "
    "log_words word_length"
).split()

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = ~(_LETTER | _DIGIT | _SPACE)
_NOT_LETTER = ~_LETTER
_DISGUISE, _NOT_DISGUISE = BYTE_VALUES.copy(), _NOT_LETTER.copy()
for _sign, _letter in LOOK_ALIKE.items():
    _DISGUISE[ord(_sign)] = BYTE_VALUES[ord(_letter)]
    _NOT_DISGUISE[ord(_sign)] = False


def hash_words(words: list[str]) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(word_hashes("\n".join(words).encode())[0])


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


@dataclass
class Lexicon:
    insults: np.ndarray
    second: np.ndarray
    learned: np.ndarray
    stems: np.ndarray

    @classmethod
    def of(cls, learned: np.ndarray, stems: np.ndarray) -> Lexicon:
        return cls(hash_words(INSULTS), hash_words(SECOND_PERSON), np.unique(learned), np.unique(stems))


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > BUFFER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield group


def _joined(group: list[str]) -> tuple[bytes, np.ndarray]:
    """The texts in one buffer, and where each starts."""
    parts = [t.encode("utf-8", "surrogatepass") for t in group]
    return b"\n".join(parts), np.cumsum([0, *(len(p) + 1 for p in parts)])


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text; an empty text gives zeros."""
    return np.concatenate([np.empty((0, len(FEATURES))), *(_features(g, lexicon) for g in _groups(texts))])


def _features(group: list[str], lexicon: Lexicon) -> np.ndarray:
    original, edges = _joined(group)
    buffer, low_edges = _joined([t.lower() for t in group])
    raw = np.frombuffer(original, np.uint8)
    ends = np.minimum(edges[1:], len(raw))

    def count_bytes(which: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(which[raw])])
        return sums[ends] - sums[np.minimum(edges[:-1], len(raw))]

    def per_text(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks)])
        cut = np.searchsorted(starts, low_edges)
        return sums[cut[1:]] - sums[cut[:-1]]

    words, starts = word_hashes(buffer, _NOT_LETTER)
    insult = _member(words, lexicon.insults)
    learned = _member(words, lexicon.learned)
    stem = _member(word_hashes(buffer, _NOT_LETTER, prefix=STEM)[0], lexicon.stems)
    second = _member(words, lexicon.second)
    owner = np.searchsorted(low_edges, starts, "right")
    hit = insult | learned | stem
    close = np.zeros(len(words), bool)
    for step in range(1, NEAR + 1):
        same = owner[step:] == owner[:-step]
        close[step:] |= second[:-step] & same
        close[:-step] |= second[step:] & same
    disguised, places = word_hashes(buffer, _NOT_DISGUISE, _DISGUISE)
    hidden = _member(disguised, lexicon.insults) | _member(disguised, lexicon.learned)
    same_byte = np.zeros(len(raw), bool)
    if len(raw) > 2:
        same_byte[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & _LETTER[raw[2:]]
    run_sums = np.concatenate([[0], np.cumsum(same_byte)])
    runs = run_sums[ends] - run_sums[np.minimum(edges[:-1], len(raw))]

    n = per_text(np.ones(len(words)), starts)
    some = np.maximum(n, 1)
    size = np.maximum(edges[1:] - edges[:-1] - 1, 1)
    letters = count_bytes(_LETTER)
    hits = per_text(hit, starts)
    marks = [count_bytes(np.arange(256) == ord(c)) for c in "!?"]
    return np.column_stack(
        [
            per_text(insult, starts) / some, np.log1p(per_text(insult, starts)),
            per_text(learned, starts) / some, np.log1p(per_text(learned, starts)),
            per_text(stem, starts) / some, np.log1p(per_text(stem, starts)),
            per_text(hit & close, starts) / np.maximum(hits, 1), per_text(second, starts) / some,
            count_bytes(_UPPER) / np.maximum(letters, 1), marks[0] / size, marks[1] / size,
            (count_bytes(_MARK) - marks[0] - marks[1]) / size, count_bytes(_DIGIT) / size,
            np.maximum(per_text(hidden, places) - per_text(insult | learned, starts), 0) / some, runs / some,
            np.log1p(n), letters / some,
        ]
    )


class Trees:
    """Boosted regression trees for log-odds, over quantile bins; all splits of a level are found at once."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(width)]
        binned = self._bin(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        self.trees = []
        score = np.full(n, self.base)
        slots = self.bins
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            node = np.zeros(n, np.int64)
            splits = []
            for level in range(self.depth):
                nodes = 1 << level
                best = np.full(nodes, 1e-6)
                feature, cut = np.zeros(nodes, np.int64), np.full(nodes, slots)
                for j in range(width):
                    key = node * slots + binned[:, j]
                    g = np.bincount(key, grad, nodes * slots).reshape(nodes, slots).cumsum(axis=1)
                    h = np.bincount(key, hess, nodes * slots).reshape(nodes, slots).cumsum(axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = (
                        g**2 / (h + self.ridge)
                        + (all_g - g) ** 2 / (all_h - h + self.ridge)
                        - all_g**2 / (all_h + self.ridge)
                    )
                    gain[(h < 0.3) | (all_h - h < 0.3)] = 0
                    at = gain.argmax(axis=1)
                    value = gain[np.arange(nodes), at]
                    better = value > best
                    best[better], feature[better], cut[better] = value[better], j, at[better]
                splits.append((feature, cut))
                node = 2 * node + (binned[np.arange(n), feature[node]] > cut[node])
            leaves = 1 << self.depth
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            value = self.rate * g / (h + self.ridge)
            self.trees.append((splits, value))
            score += value[node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (binned[rows, feature[node]] > cut[node])
            out += value[node]
        return out


class Isotonic:
    """A non-decreasing map of scores to probabilities by pooling adjacent violators; linear in between."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # mean label, weight, mean score
        for s, v in zip(score[order], y[order]):
            blocks.append([float(v), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                w = a[1] + b[1]
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, (a[2] * a[1] + b[2] * b[1]) / w])
        self.x = np.array([b[2] for b in blocks])
        self.y = np.array([(b[0] * b[1] + 0.02) / (b[1] + 0.04) for b in blocks])
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else np.full(len(score), 0.5)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def score(self, texts: list[str]) -> np.ndarray:
        return np.clip(self.calibration(self.trees.score(features(texts, self.lexicon))), 0.0, 1.0)


def _lexicons(rows: DataFrame) -> list[Lexicon]:
    """Lexicons of words and word starts that toxic texts use significantly often.

    One for each fold, learned from the other folds, and last one from all rows.
    """

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"]):
                raw = text.lower().encode("utf-8", "surrogatepass")
                words = np.unique(word_hashes(raw, _NOT_LETTER)[0])
                stems = np.unique(word_hashes(raw, _NOT_LETTER, prefix=STEM)[0])
                yield pd.DataFrame(
                    {
                        "h": np.concatenate([words, stems]).view(np.int64),
                        "stem": np.repeat([False, True], [len(words), len(stems)]),
                        "toxic": int(toxic),
                        "fold": int(fold),
                    }
                )

    in_fold = [F.col("fold") == k for k in range(FOLDS)]
    counts = (
        rows.mapInPandas(distinct, "h long, stem boolean, toxic int, fold int")
        .groupBy("h", "stem")
        .agg(
            F.sum("toxic").alias("t"), F.count("*").alias("n"),
            F.array(*[F.sum(F.when(c, F.col("toxic")).otherwise(0)) for c in in_fold]).alias("t_fold"),
            F.array(*[F.sum(F.when(c, 1).otherwise(0)) for c in in_fold]).alias("n_fold"),
        )
        .filter("t >= 3 AND (t + 0.5) / (n + 1) >= 0.75")
        .orderBy(F.desc("t"), "h")
        .limit(MAX_LEARNED)
        .collect()
    )
    base, every = rows.agg(F.avg(F.col("toxic").cast("double")), F.count("*")).head()
    out = []
    for fold in [*range(FOLDS), None]:
        known = every if fold is None else every * (1 - 1 / FOLDS)
        # All t texts with a word are toxic by chance with base ** t; texts bring some 50 new words each.
        least = np.log(50 * max(known, 2)) / -np.log(min(max(base or 0.5, 1e-6), 0.9))
        picked: dict[bool, list[int]] = {False: [], True: []}
        for r in counts:
            t = r["t"] - (r["t_fold"][fold] if fold is not None else 0)
            n = r["n"] - (r["n_fold"][fold] if fold is not None else 0)
            if t >= least and (t + 0.5) / (n + 1) >= 0.8:
                picked[r["stem"]].append(r["h"])
        out.append(Lexicon.of(*(np.array(picked[k], np.int64).view(np.uint64) for k in (False, True))))
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model fitted to labelled rows that ``learn`` (over doc_id) allows; None if they lack one of the labels."""
    known = (
        labels.filter(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("turn", F.xxhash64("doc_id"))
        .orderBy("turn", "doc_id")
        .limit(max_labelled)
        .select(F.col("doc_id").alias("l_doc_id"), "toxic", F.pmod("turn", F.lit(FOLDS)).cast("int").alias("fold"))
    )
    rows = settle(
        docs.filter("text IS NOT NULL")
        .join(F.broadcast(known), F.col("doc_id") == F.col("l_doc_id"))
        .select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"), "fold"),
        "toxic-rows",
    )
    lexicons = _lexicons(rows)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, own in batch.groupby("fold"):
                x = features(list(own["text"]), lexicons[fold])
                yield pd.DataFrame({"doc_id": own["doc_id"], "toxic": own["toxic"], "fold": own["fold"], "x": list(x)})

    got = rows.mapInPandas(measure, "doc_id long, toxic int, fold int, x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    y = np.array([float(r["toxic"]) for r in got])
    fold = np.array([r["fold"] for r in got])
    if not len(y) or y.min() == y.max():
        return None
    outside = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            rest = fold != k if (fold != k).any() else fold == k
            outside[fold == k] = Trees().fit(x[rest], y[rest]).score(x[fold == k])
    return Model(lexicons[-1], Trees().fit(x, y), Isotonic().fit(outside, y))


def score_column(model: Model | None) -> Column:
    """Toxicity of the column ``text``: null and empty texts are scored as a text without words."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            whole = ["" if t is None else t for t in texts]
            yield pd.Series(model.score(whole) if model else np.zeros(len(whole)))

    return F.pandas_udf(score, "double")("text")
