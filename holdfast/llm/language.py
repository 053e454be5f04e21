"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are lower-cased, encoded as UTF-8 and cut into windows of ``WINDOW`` bytes; every byte of a text is in
one window. A forward and a backward gated unit read each window, and a softmax over both states labels
every position with language probabilities. A document's probabilities are the mean over its letter
positions. Training is plain numpy: cross-entropy at every position, gradients by backpropagation through
time, Adam. It runs on the driver over a bounded sample: ``DOCS_PER_LANG`` documents of each language, in
the order of a hash of their ids, and at most ``WINDOWS_PER_DOC`` evenly spread windows of each.

The softmax names some language for any text. Whether a text is in that language at all is told by its grams,
three letter bytes in a row: the share of them that occurs in the language's sample. The bound comes from the
sample itself, from documents held out while grams of the others are counted.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 64
HIDDEN = 8
DOCS_PER_LANG = 400
WINDOWS_PER_DOC = 8
BATCH = 2048
NO_LANGUAGE = "und"
#: Characters that may be letters; signs among them, such as superscripts and Roman numerals, are told apart by category.
_WORDLIKE = re.compile(r"[^\W\d_]")
#: Bytes that belong to letters: a-z, and what UTF-8 uses beyond ASCII.
LETTER_BYTE = np.zeros(256, np.float32)
LETTER_BYTE[97:123] = LETTER_BYTE[128:] = 1.0
#: Numbers of the letter bytes in a gram, and the number of grams.
GRAM_BYTE = (np.cumsum(LETTER_BYTE) - 1).astype(np.int64)
GRAMS = int(LETTER_BYTE.sum()) ** 3
#: Texts with fewer grams are too short to be called foreign.
LEAST_GRAMS = 20
#: The bound is this part of the share that all but LOWEST of the held-out documents reach.
LOWEST, PART = 0.05, 0.5


def has_letter(text: str) -> bool:
    """Whether any character is a letter of Unicode (category L)."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _WORDLIKE.finditer(text))


def to_windows(text: str) -> np.ndarray:
    """The bytes of a text as rows of WINDOW bytes, the last padded with zeros."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


def grams(raw: np.ndarray) -> np.ndarray:
    """The grams of bytes, in order, repeats included."""
    code, letter = GRAM_BYTE[raw], LETTER_BYTE[raw] > 0
    base = round(GRAMS ** (1 / 3))
    whole = letter[:-2] & letter[1:-1] & letter[2:]
    return ((code[:-2] * base + code[1:-1]) * base + code[2:])[whole]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Weights by name; ``f`` and ``b`` are the directions. Gates are ordered update, reset, candidate."""

    langs: list[str]
    weights: dict[str, np.ndarray]
    #: For each language its grams, in order, and the least share of them that a text in it has.
    known: list[np.ndarray] = field(default_factory=list)
    bounds: list[float] = field(default_factory=list)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        w = {}
        for d in "fb":
            w |= {f"x{d}": make(256, 3 * hidden), f"u{d}": make(hidden, 3 * hidden), f"c{d}": np.zeros(hidden, np.float32)}
        w |= {"out": make(2 * hidden, len(langs)), "bias": np.zeros(len(langs), np.float32)}
        return cls(langs, w)

    def states(self, x: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """Hidden states (time, window, unit) of direction ``d``; ``tape`` gets what the gradient needs."""
        xw, u, c = self.weights[f"x{d}"], self.weights[f"u{d}"], self.weights[f"c{d}"]
        h = u.shape[0]
        state = np.zeros((x.shape[0], h), np.float32)
        out = np.empty((x.shape[1], x.shape[0], h), np.float32)
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            rec = state @ u
            inp = np.take(xw, x[:, t], axis=0)
            gates = _sigmoid(inp[:, : 2 * h] + rec[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            cand = rec[:, 2 * h :] + c
            n = r * cand
            n += inp[:, 2 * h :]
            n *= 2
            n = _sigmoid(n)
            n *= 2
            n -= 1
            new = state - n
            new *= z
            new += n
            if tape is not None:
                tape.append((t, state, z, r, n, cand))
            state = out[t] = new
        return out

    def position_probs(self, x: np.ndarray, both: np.ndarray | None = None) -> np.ndarray:
        """Language probabilities (time, window, language) of every position."""
        if both is None:
            both = np.concatenate([self.states(x, "f"), self.states(x, "b")], axis=2)
        logits = both @ self.weights["out"] + self.weights["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over letter positions and its gradients, by backpropagation through time."""
        tapes = {"f": [], "b": []}
        both = np.concatenate([self.states(x, d, tapes[d]) for d in "fb"], axis=2)
        mask = LETTER_BYTE[x].T
        total = max(1.0, float(mask.sum()))
        probs = self.position_probs(x, both)
        at = np.arange(x.shape[0])
        loss = -float((np.log(probs[:, at, y] + 1e-9) * mask).sum()) / total
        probs[:, at, y] -= 1
        probs *= (mask / total)[:, :, None]
        h = both.shape[2] // 2
        grads = {
            "out": both.reshape(-1, 2 * h).T @ probs.reshape(-1, probs.shape[2]),
            "bias": probs.sum(axis=(0, 1)),
        }
        above = probs @ self.weights["out"].T
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = self.weights[f"u{d}"]
            gx, gu, gc = np.zeros((256, 3 * h), np.float32), np.zeros_like(u), np.zeros(h, np.float32)
            carry = np.zeros((x.shape[0], h), np.float32)
            for t, state, z, r, n, cand in reversed(tapes[d]):
                g = above[t, :, part] + carry
                gn = g * (1 - z) * (1 - n * n)
                gz = g * (state - n) * z * (1 - z)
                gr = gn * cand * r * (1 - r)
                inp = np.concatenate([gz, gr, gn], axis=1)
                rec = np.concatenate([gz, gr, gn * r], axis=1)
                np.add.at(gx, x[:, t], inp)
                gu += state.T @ rec
                gc += rec[:, 2 * h :].sum(axis=0)
                carry = g * z + rec @ u.T
            grads |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 350, batch: int = 256, rate: float = 0.02, seed: int = 9):
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, len(x)))
            _, grads = self.gradients(x[pick], y[pick])
            scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((g**2).sum() for g in grads.values())))))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] -= (
                    pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                ).astype(np.float32)
        return self

    def learn_grams(self, samples: list[list[np.ndarray]]):
        """``samples`` has, for each language, the windows of each of its documents; every fourth is held out once."""
        self.known, self.bounds = [], []
        for docs in samples:
            own = [np.concatenate([grams(window) for window in x]) for x in docs]
            rank = [zlib.crc32(x.tobytes()) for x in docs]  # copies are held out together
            shares = []
            for turn in range(4):
                others = np.unique(np.concatenate([np.empty(0, np.int64), *[g for g, r in zip(own, rank) if r % 4 != turn]]))
                out = [g for g, r in zip(own, rank) if r % 4 == turn and len(g) >= LEAST_GRAMS]
                shares += [float(np.isin(g, others).mean()) for g in out if len(others)]
            self.known.append(np.unique(np.concatenate([np.empty(0, np.int64), *own])))
            self.bounds.append(PART * float(np.quantile(shares, LOWEST)) if shares else 0.0)
        return self

    def gram_tables(self) -> list[np.ndarray]:
        tables = [np.zeros(GRAMS, bool) for _ in self.known]
        for table, known in zip(tables, self.known):
            table[known] = True
        return tables

    def documents(self, texts: list[str]) -> np.ndarray:
        """Pooled language probabilities of each text."""
        sums = np.zeros((len(texts), len(self.langs)))
        weight = np.zeros(len(texts))
        group, owners, held = [], [], 0

        def flush():
            x, own = np.concatenate(group), np.concatenate(owners)
            for at in range(0, len(x), BATCH):
                part, who = x[at : at + BATCH], own[at : at + BATCH]
                mask = LETTER_BYTE[part].T
                scored = np.einsum("tbl,tb->bl", self.position_probs(part), mask)
                np.add.at(sums, who, scored)
                np.add.at(weight, who, mask.sum(axis=0))

        for i, text in enumerate(texts):
            rows = to_windows(text)
            for at in range(0, len(rows), BATCH):
                piece = rows[at : at + BATCH]
                group.append(piece)
                owners.append(np.full(len(piece), i))
                held += len(piece)
                if held >= BATCH:
                    flush()
                    group, owners, held = [], [], 0
        if group:
            flush()
        return sums / np.maximum(weight, 1)[:, None]


def learning_sample(docs: DataFrame, learn: Column, docs_per_lang: int, windows_per_doc: int) -> DataFrame:
    """lang and windows (bytes) of the sampled documents; bounded by both limits and the languages."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (
        docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", "lang")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= docs_per_lang)
        .select(F.col("doc_id").alias("p_doc_id"), F.col("lang").alias("p_lang"))
        .distinct()
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, rows = [], []
            for lang, text in zip(batch["lang"], batch["text"]):
                x = to_windows(text)
                pick = np.unique(np.linspace(0, len(x) - 1, windows_per_doc).round().astype(int))
                langs.append(lang)
                rows.append(x[pick].tobytes())
            yield pd.DataFrame({"lang": langs, "windows": rows})

    same = (F.col("doc_id") == F.col("p_doc_id")) & (F.col("lang") == F.col("p_lang"))
    chosen = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), same)
    return chosen.select("lang", "text").mapInPandas(cut, "lang string, windows binary")


def train(
    docs: DataFrame, learn: Column, docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC, steps: int = 350
) -> Network | None:
    """A network fitted to the rows of ``docs`` (doc_id, text, lang) that ``learn`` allows; None without any.

    What reaches the driver is at most docs_per_lang * windows_per_doc windows for each language.
    """
    rows = learning_sample(docs, learn, docs_per_lang, windows_per_doc).collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["windows"])))
    x = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in rows]
    y = np.concatenate([np.full(len(w), langs.index(r["lang"])) for r, w in zip(rows, x)])
    samples = [[w for r, w in zip(rows, x) if r["lang"] == lang] for lang in langs]
    return Network.fresh(langs).fit(np.concatenate(x), y, steps=steps).learn_grams(samples)


def label_column(network: Network | None, judge: bool = False) -> Column:
    """Struct (lang_pred, score) of the column ``text``; with ``judge`` also familiar.

    A text is familiar if enough of its grams are known in its language. All its bytes count; one of under
    LEAST_GRAMS grams passes, and one in no language does not.
    """
    kind = "lang_pred string, score double" + ", familiar boolean" * judge

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = network.gram_tables() if network and judge else []
        for texts in batches:
            familiar = np.zeros(len(texts), bool)
            langs, scores = np.full(len(texts), NO_LANGUAGE, object), np.zeros(len(texts))
            with_letters = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
            for at in range(0, len(with_letters) if network else 0, 500):
                some = with_letters[at : at + 500]
                probs = network.documents([texts.iat[i] for i in some])
                best = probs.argmax(axis=1)
                langs[some] = np.array(network.langs, object)[best]
                scores[some] = np.clip(probs[np.arange(len(some)), best], 0, 1)
                for i, lang in zip(some, best if judge else []):
                    own = grams(to_windows(texts.iat[i]).reshape(-1))
                    familiar[i] = len(own) < LEAST_GRAMS or tables[lang][own].mean() >= network.bounds[lang]
            out = pd.DataFrame({"lang_pred": langs, "score": scores})
            yield out.assign(familiar=familiar) if judge else out

    return F.pandas_udf(label, kind)("text")


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score, the pooled probability of that language.

    Null text, text without a letter, or no network: ``und`` with score 0. Other columns stay as they are,
    but for columns named lang_pred or score, which are replaced. Every row gets a label, also a repeated
    one or one with a null doc_id.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    labelled = docs.select(*kept, label_column(network).alias("__label"))
    return labelled.select(*kept, "__label.lang_pred", "__label.score")
