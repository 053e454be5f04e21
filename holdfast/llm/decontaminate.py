"""Find benchmark items inside documents, up to an error budget, by pigeonhole edit matching.

Texts are lower-cased and white space runs become one space. An item of m characters may be matched with
k = floor(rate * m) edits. Cut into k + 1 pieces, at least one piece of any such match is unchanged, so one
pass of an Aho-Corasick automaton over all pieces finds every place that can hold a match. Places of one
item that lie close together are one window, and Myers' bit-parallel algorithm computes the edit distance
at each position of the window.

Short items keep that budget (none below 13 characters), but a match has to begin and end at word boundaries,
as clean text holds short strings inside its words.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHES = "doc_id long, item_id long, start long, end long, distance int, budget int"
RATE = 0.08
#: Items with fewer characters than this are found inside words by chance; they match whole words only.
MIN_CHARS = 25
#: Characters of items in one automaton; more items are searched in several passes over the documents.
MAX_CHARS = 20_000_000
_WORD = re.compile(r"\S+")
#: Letters of scripts written without spaces: Thai to Tibetan, Myanmar, Khmer, kana, Han, and their extensions.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")


def lower(text: str) -> str:
    """Lower case with the length unchanged."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def normal(text: str) -> str:
    return " ".join(lower(text).split())


def positions(text: str) -> list[int]:
    """For each character of normal(text), its place in ``text``."""
    out: list[int] = []
    for word in re.finditer(_WORD, lower(text)):
        if out:
            out.append(out[-1] + 1)
        out += range(word.start(), word.end())
    return out


def is_boundary(text: str, at: int) -> bool:
    """Whether no word goes on across ``at``: not both neighbours are letters, digits or marks of a spaced script."""
    if at <= 0 or at >= len(text):
        return True
    return not all(unicodedata.category(c)[0] in "LNM" and not _UNSPACED.match(c) for c in text[at - 1 : at + 1])


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """After each character of ``text``: the least edit distance of ``pattern`` to a text part ending there.

    With ``anchored`` the part starts at the start of ``text``.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    pv, mv, score, low = full, 0, m, int(anchored)
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | low) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        yield score


class Matcher:
    """Searches documents for items; made once in each Python worker."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        import ahocorasick

        self.items, self.min_chars = items, min_chars
        self.budgets = [int(len(text) * rate) for _, text in items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text) in enumerate(items):
            for at, piece in pieces(text, self.budgets[i]):
                found[piece].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def search(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item index, start, end, distance, budget) in characters of the normal form."""
        if self.empty:
            return []
        spots: dict[int, set[int]] = defaultdict(set)
        for end, (size, uses) in self.automaton.iter(text):
            for item, at in uses:
                spots[item].add(end - size + 1 - at)
        out = []
        for item, starts in spots.items():
            size, budget = len(self.items[item][1]), self.budgets[item]
            if size < self.min_chars and not budget:  # the only piece is the item
                whole = (s for s in sorted(starts) if is_boundary(text, s) and is_boundary(text, s + size))
                out += [(item, s, s + size, 0, 0) for s in whole]
                continue
            window: list[int] = []
            for start in sorted(starts):
                low, high = max(0, start - budget), min(len(text), start + size + budget)
                if window and low <= window[1]:
                    window[1] = high
                    continue
                if window:
                    out += self._within(item, text, *window)
                window = [low, high]
            out += self._within(item, text, *window)
        return out

    def _within(self, item: int, text: str, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
        pattern, budget = self.items[item][1], self.budgets[item]
        if len(pattern) < self.min_chars:
            return self._whole_words(item, text, low, high)
        hits: list[tuple[int, int]] = []  # (end, distance), the best of each run of ends
        last = -1
        for end, distance in enumerate(myers(pattern, text[low:high]), low + 1):
            if distance <= budget:
                if hits and end - last <= max(1, len(pattern) // 2):
                    if distance < hits[-1][1]:
                        hits[-1] = (end, distance)
                else:
                    hits.append((end, distance))
                last = end
        out = []
        for end, distance in hits:
            back = text[max(0, end - len(pattern) - budget) : end][::-1]
            size = next(n for n, d in enumerate(myers(pattern[::-1], back, True), 1) if d == distance)
            out.append((item, end - size, end, distance, budget))
        return out

    def _whole_words(self, item: int, text: str, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
        """As _within, of the matches that begin and end at word boundaries."""
        pattern, budget = self.items[item][1], self.budgets[item]
        out: list[tuple[int, int, int, int, int]] = []  # the best of each run of ends
        last = -1
        for end, distance in enumerate(myers(pattern, text[low:high]), low + 1):
            if distance > budget or not is_boundary(text, end):
                continue
            back = text[max(0, end - len(pattern) - budget) : end][::-1]
            sizes = enumerate(myers(pattern[::-1], back, True), 1)
            whole = [(d, n) for n, d in sizes if d <= budget and is_boundary(text, end - n)]
            if not whole:
                continue
            d, n = min(whole)
            if not out or end - last > max(1, len(pattern) // 2):
                out.append((item, end - n, end, d, budget))
            elif d < out[-1][3]:
                out[-1] = (item, end - n, end, d, budget)
            last = end
        return out


_MATCHERS: dict[str, Matcher] = {}


def find_items(
    docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS
) -> DataFrame:
    """Every match: doc_id, item_id, start, end (characters of the document's text), distance, budget.

    ``docs`` has doc_id and text, ``items`` item_id and text. Null or empty texts match nothing. Items of
    under ``min_chars`` characters in normal form match whole words only. Repeated items and documents each give
    their own rows; null ids stay null. Items beyond ``max_chars`` characters in all are dealt by hash into
    groups below that bound, with one pass each, so what a worker holds is bounded.
    """
    parts = [_search(docs, group, rate, min_chars) for group in item_groups(docs.sparkSession, items, max_chars)]
    return reduce(DataFrame.unionByName, parts)


def item_groups(spark: SparkSession, items: DataFrame, max_chars: int) -> list:
    """Broadcast lists of (item_id, normal text), each of bounded size."""
    usable = items.filter("text IS NOT NULL").select("item_id", "text")
    total = usable.agg(F.sum(F.char_length("text"))).head()[0] or 0
    groups, out = 1 + 2 * int(total // max_chars), []
    for group in range(groups):
        rows = usable if groups == 1 else usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group)
        chosen = [(r["item_id"], normal(r["text"])) for r in rows.collect()]
        chosen = sorted(((i, t) for i, t in chosen if t), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        out.append(spark.sparkContext.broadcast(chosen))
    return out


def _matcher(key: str, items, rate: float, min_chars: int) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items.value, rate, min_chars)
    return _MATCHERS[key]


def without_items(
    docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS
) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; a map over the documents, without a join."""
    for group in item_groups(docs.sparkSession, items, max_chars):
        docs = docs.filter(_is_clean(group, rate, min_chars))
    return docs


def _is_clean(items, rate: float, min_chars: int) -> Column:
    key = uuid.uuid4().hex

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _matcher(key, items, rate, min_chars)
        for texts in batches:
            yield pd.Series([not (t and matcher.search(normal(t))) for t in texts], dtype=bool)

    return F.pandas_udf(clean, "boolean")("text")


def _search(docs: DataFrame, items, rate: float, min_chars: int) -> DataFrame:
    key = uuid.uuid4().hex

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(key, items, rate, min_chars)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if text and (found := matcher.search(normal(text))):
                    place = positions(text)
                    rows += [
                        (doc_id, matcher.items[i][0], place[start], place[end - 1] + 1, distance, budget)
                        for i, start, end, distance, budget in found
                    ]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "distance", "budget"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(search, MATCHES)
