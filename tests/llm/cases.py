"""Small documents tables that every operator has to bear, and plain versions of shared steps."""

from __future__ import annotations

import re

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(seed: int, n: int = 30) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + str((seed + i) % 5) for i in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, copies, near copies, long texts and ties."""
    base = sentence(3, 60)
    long_text = "\n".join(sentence(i, 40) for i in range(150))
    return [
        (1, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (3, base.replace("alpha", "omega", 1), "en", "b", 10),
        (4, sentence(11, 50), "de", "b", 10),
        (5, None, "en", "a", None),
        (6, "", None, None, 0),
        (7, " \t\n \x0b\r ", "fr", "b", 5),
        (8, "Ä ß é\n日本語 text 🙂", None, "c", 3),
        (9, long_text, "en", "a", 1),
        (10, long_text, "en", None, 1),
        (11, "one two three", "en", "c", 1),
        (12, "ONE  two\tthree", "en", "c", 1),
        (None, sentence(5, 20), "en", "a", 1),
        (13, "12 34 !!", "en", "c", 1),
        (14, "\n\n", "en", "c", 1),
    ]


def documents(spark, extra: bool = False, empty: bool = False):
    df = spark.createDataFrame([] if empty else rows(), SCHEMA)
    if extra:
        for name in ("size", "score", "key", "h", "body", "part", "n", "set_id", "kept", "rank"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def linked(a: frozenset, b: frozenset, percent: int = 80) -> bool:
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def classes(sets: dict[int, frozenset]) -> dict[int, int]:
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if linked(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def schema_of(df) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f, T.StructField)]
