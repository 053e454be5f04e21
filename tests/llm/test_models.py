"""Language ID, quality and toxicity: gradients, held-out accuracy and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import language, quality, toxicity
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = language.Network.fresh(["x", "y", "z"], hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = rng.integers(97, 110, (4, 7)).astype(np.uint8)
    y = np.array([0, 1, 2, 1])
    _, grads = net.gradients(x, y)
    for name in grads:
        flat = net.weights[name].reshape(-1)
        live = np.flatnonzero(np.abs(grads[name].reshape(-1)) > 1e-4)[:6]
        for i in live:
            keep = flat[i]
            flat[i] = keep + 1e-2
            up, _ = net.gradients(x, y)
            flat[i] = keep - 1e-2
            down, _ = net.gradients(x, y)
            flat[i] = keep
            assert (up - down) / 2e-2 == pytest.approx(grads[name].reshape(-1)[i], rel=0.05, abs=2e-4), name


def test_windows_cover_every_byte():
    for text in ("", "a", "é" * 100, "x" * 64, "x" * 65):
        raw = text.lower().encode()
        assert language.to_windows(text).tobytes().rstrip(b"\0") == raw


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = F.col("doc_id") % 3 != 0
    net = language.train(docs, learn, steps=250)
    rows = language.identify(docs.filter(~learn), net).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark):
    docs = cases.documents(spark, extra=True)
    net = language.train(docs, F.lit(True), steps=5)
    got = {r["doc_id"]: r for r in language.identify(docs, net).collect()}
    for i in (5, 6, 7, 13, 14):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[1]["lang_pred"] in net.langs and got[None]["lang_pred"] in net.langs
    assert got[9]["score"] == pytest.approx(got[10]["score"], abs=1e-4)
    none = cases.documents(spark, empty=True)
    assert language.train(none, F.lit(True)) is None
    assert language.identify(none, None).count() == 0


def test_trees_and_isotonic():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.Trees().fit(x[:1500], y[:1500])
    score = trees.score(x[1500:])
    assert ((score > 0) == y[1500:]).mean() > 0.95
    fit = toxicity.Isotonic().fit(score, y[1500:])
    p = fit(np.sort(score))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1
    flat = toxicity.Isotonic().fit(np.array([1.0, 2.0, 3.0]), np.array([1.0, 0.0, 1.0]))
    assert flat(np.array([1.5]))[0] == pytest.approx(0.5, abs=0.02)


def test_toxic_features_see_disguise_and_neighbours():
    lexicon = toxicity.Lexicon.of(np.empty(0, np.uint64), np.empty(0, np.uint64))
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features([t], lexicon)[0]))
    assert f("you are an idiot")["near_second_person"] == 1
    assert f("one idiot " + "word " * 20 + "you")["near_second_person"] == 0
    assert f("an 1d1ot here")["obfuscated_density"] > 0 and f("an idiot here")["obfuscated_density"] == 0
    assert f("IDIOT")["insult_count"] > 0 and f("IDIOT")["capitals"] == 1
    assert not np.isnan(toxicity.features(["", "!!", "a" * 100_000], lexicon)).any()
    many = ["an idiot", "", "you fool you", "x"]
    together = toxicity.features(many, lexicon)
    assert all((together[i] == toxicity.features([t], lexicon)[0]).all() for i, t in enumerate(many))


def _toxic_corpus(n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(cases.WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 80))]
        bad = i % 5 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["zornig", "vexil", "moron"]))
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_words_it_was_not_given(spark):
    rows, labels = _toxic_corpus()
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks, F.col("doc_id") % 3 != 1)
    got = docs.select("doc_id", toxicity.score_column(model).alias("s")).filter("doc_id % 3 = 1").collect()
    assert all((r["s"] >= 0.7) == (r["doc_id"] % 5 == 0) for r in got)


def test_toxicity_edge_cases(spark):
    docs = cases.documents(spark, extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, none, F.lit(True)) is None
    marks = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (4, 0, 0), (5, 0, 1), (None, 1, 1), (9, 1, None)], none.schema)
    model = toxicity.train(docs, marks, F.lit(True))
    scores = [r["s"] for r in docs.select(toxicity.score_column(model).alias("s")).collect()]
    assert len(scores) == len(cases.rows()) and all(0 <= s <= 1 for s in scores)
    assert cases.documents(spark, empty=True).select(toxicity.score_column(model)).count() == 0


def test_ordinal_recovers_order():
    rng = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(900):
        g = int(rng.integers(0, 4))
        slots = np.unique(np.concatenate([rng.integers(100, 200, 12), rng.integers(0, 20, 1) + 20 * g]))
        rows.append((slots, np.ones(len(slots))))
        y.append(g)
    model = quality.Ordinal.fit(rows, np.array(y), epochs=60)
    assert (np.diff(model.thresholds) > 0).all() and model.grades == [0, 1, 2, 3]
    eta = np.array([(model.weights[s] * v).sum() for s, v in rows])
    assert ((eta[:, None] > model.thresholds).sum(axis=1) == np.array(y)).mean() > 0.9


def test_ordinal_slopes():
    eta, theta, y = np.array([0.3, -0.7, 1.1]), np.array([-0.5, 0.8]), np.array([0, 1, 2])

    def loss(eta, theta):
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        s = lambda v: 1 / (1 + np.exp(-v))
        return -np.log(s(edge[y + 1] - eta) - s(edge[y] - eta)).sum()

    d_eta, d_theta = quality.Ordinal._slopes(eta, theta, y)
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        assert (loss(eta + step, theta) - loss(eta - step, theta)) / 2e-5 == pytest.approx(d_eta[i], abs=1e-4)
    for j in range(2):
        step = np.eye(2)[j] * 1e-5
        assert (loss(eta, theta + step) - loss(eta, theta - step)) / 2e-5 == pytest.approx(d_theta[j], abs=1e-4)


def test_quality_scores_agree_with_sparse_rows():
    rng = np.random.default_rng(6)
    model = quality.Ordinal([0, 1, 3], rng.normal(size=quality.WIDTH), np.array([-1.0, 1.0]))
    texts = [t for _, t, *_ in cases.rows()]
    eta = np.array([(model.weights[s] * v).sum() for s, v in quality.sparse_rows(texts)])
    want = 1 / (1 + np.exp(-np.clip(eta[:, None] - model.thresholds, -40, 40)))
    assert np.allclose(model.tails(texts), want, atol=1e-6)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.col("doc_id") % 3 != 0
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("grade")), learn)
    rated = docs.select("doc_id", quality.rating_column(model, 1)["tail"].alias("p")).join(labels, "doc_id").filter(~learn).collect()
    right = sum((r["p"] >= 0.5) == (r["quality"] == 1) for r in rated)
    assert right / len(rated) > 0.9


def test_quality_edge_cases(spark):
    docs = cases.documents(spark, extra=True)
    grades = spark.createDataFrame([(1, 0), (1, 2), (4, 1), (5, None), (None, 1), (6, 0)], "doc_id long, grade int")
    model = quality.train(docs, grades, F.lit(True))
    assert model.grades == [0, 1, 2]
    got = docs.select(quality.rating_column(model, 1).alias("r")).select("r.*").collect()
    assert len(got) == len(cases.rows()) and all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail"] <= 1 for r in got)
    assert quality.train(cases.documents(spark, empty=True), grades, F.lit(True)) is None
    lost = docs.select(quality.rating_column(None, 1).alias("r")).select("r.*").collect()
    assert all(r["tail"] is None for r in lost)


def test_only_unicode_letters_are_letters():
    assert all(map(language.has_letter, ["a", "É", "ß", "日", "ª", "1 b"]))
    assert not any(map(language.has_letter, ["", "²", "Ⅷ ½", "12 _ -", "٣", "🙂", "́"]))


def test_a_rating_needs_a_quality(spark, monkeypatch):
    from holdfast.llm import q_models

    seen = {}
    tables = {
        "documents": spark.createDataFrame([(1, "a b c")], "doc_id long, text string"),
        "labels": spark.createDataFrame(
            [(1, None, 1), (2, None, None), (3, 0, 1), (4, 1, 1), (5, 1, None), (6, 1, 0)], "doc_id long, quality int, toxic int"
        ),
    }

    def train(docs, graded, chosen):
        seen.update((r.doc_id, r.grade) for r in graded.collect())
        return quality.Ordinal([0, 1, 2], np.zeros(quality.WIDTH), np.zeros(2))

    monkeypatch.setattr(q_models, "table", lambda spark, sf, name: tables[name])
    monkeypatch.setattr(quality, "train", train)
    q_models.op4_quality(spark, "")
    assert seen == {1: None, 2: None, 3: 0, 4: 1, 5: 2, 6: 2}
