import math
import re
from collections import Counter

import numpy as np
import pytest

from holdfast.llm import treap
from tests.llm import cases

ITEMS = [
    (1, cases.sentence(3, 20)), (2, "ALPHA2 alpha2 日本語 é🙂 ß"), (3, None), (4, ""), (5, " .,!"), (6, "nowhere"), (None, "text one three"),
    (7, "one two"), (7, "text Ä"), (8, cases.sentence(11, 400)), (9, "one two three " * 50),
]


def terms(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, most):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in found:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for w in terms(text):
                if w in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(scored[:most], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, most, extra=False, **how):
    table = spark.createDataFrame(docs, cases.SCHEMA)
    asked = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        for name in ("term", "df", "score", "rank", "item", "n", "docs", "pass"):
            table, asked = (x.selectExpr("*", f"map(1, 2) AS {name}") for x in (table, asked))
    got = sorted((tuple(r) for r in treap.search(table, asked, most, **how).collect()), key=str)
    assert got == plain([(r[0], r[1]) for r in docs], items, most)
    return got


@pytest.mark.parametrize("most,how", [(3, {}), (20, {"segment_docs": 2, "pass_items": 3}), (1, {"segment_docs": 5, "pass_items": 1})])
def test_equals_all_scores(spark, most, how):
    docs = cases.rows() + [cases.rows()[0]] * 3
    assert len(check(spark, docs, ITEMS, most, extra=True, **how)) > 5


def test_many_documents_with_ties_and_skew(spark):
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(300)] + ["é", "ü", "日本"]
    heavy = np.array([1 / (i + 1) for i in range(len(names))])
    def text(n):
        return " ".join(rng.choice(names, n, p=heavy / heavy.sum()))
    docs = [(i, text(int(rng.integers(1, 60))), None, None, None) for i in range(400)]
    docs += [(1000 + i, docs[7][1], None, None, None) for i in range(60)] + [(2000, text(20_000), None, None, None)]
    items = [(i, text(15)) for i in range(12)] + [(50, docs[7][1])]
    check(spark, docs, items, 20, segment_docs=64)
    check(spark, docs, items, 20)


@pytest.mark.parametrize("seed", range(4))
def test_tree_gives_back_its_points(seed):
    rng = np.random.default_rng(seed)
    rows_n, cols_n = (1, 1) if seed == 0 else rng.integers(1, 200, 2)
    points = {(int(rng.integers(rows_n)), int(rng.integers(cols_n))): int(rng.integers(1, 10**6)) for _ in range(300)}
    rows, cols = (np.array(x) for x in zip(*points))
    sizes, top, masks, drops = treap.compress(rows, cols, np.array(list(points.values())))
    tree = treap.Treap(sizes, top, masks, drops)
    assert top == max(points.values()) and sum(sizes) == len(tree.most) - 1
    for r in range(rows_n):
        found, scores = tree.best(np.array([r]), np.array([1]), 10**6, np.array([], np.int64))
        assert dict(zip(found.tolist(), scores.tolist())) == {c: v for (x, c), v in points.items() if x == r}


def test_best_leaves_most_states_closed(monkeypatch):
    """Ranges whose bound is too low are never opened."""
    rng = np.random.default_rng(2)
    values = np.sort(rng.integers(1, 10**6, 4096))[::-1]
    tree = treap.Treap(*treap.compress(np.zeros(4096, np.int64), np.arange(4096), values))
    monkeypatch.setattr(treap, "WAVE", 4)
    seen = []
    most, tree.most = tree.most, None

    class Counted:
        def __getitem__(self, at):
            seen.append(np.size(at))
            return most[at]

    tree.most = Counted()
    found, scores = tree.best(np.array([0]), np.array([1]), 20, np.array([], np.int64))
    assert sorted(scores.tolist())[-20:] == sorted(values.tolist())[-20:]
    assert sum(seen) < 600


def test_empty_tables(spark):
    docs, none = cases.documents(spark), spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert treap.search(docs, none).count() == 0
    assert treap.search(cases.documents(spark, empty=True), items).count() == 0
    assert treap.search(docs.filter("doc_id IN (5, 6, 7)"), items).count() == 0
