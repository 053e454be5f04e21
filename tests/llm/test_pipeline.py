import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from holdfast.llm import decontaminate, language, mixing
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF)
    assert known.columns == docs.columns
    rows = {r["doc_id"]: r for r in known.collect()}
    assert set(rows) == {r["doc_id"] for r in docs.collect()}  # all of these are in a language
    single = stages["near_copies"](spark, known, SF)
    want = cases.classes({i: cases.shingles(r["text"]) for i, r in rows.items()})
    kept = {r["doc_id"] for r in single.collect()}
    assert single.columns == docs.columns and kept == {i for i in rows if want[i] == i}
    clean = stages["decontamination"](spark, single, SF)
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    assert left == {i for i in kept if not any(t in decontaminate.normal(rows[i]["text"]) for t in items)}
    mixed = stages["mixing"](spark, clean, SF)
    counts = dict(mixed.groupBy("doc_id").count().collect())
    assert mixed.columns == docs.columns and set(counts) <= left and set(counts.values()) <= {1, 2}
    out = stages["token_records"](spark, mixed, SF)
    assert out.count() == sum(counts.values())


def test_stages_bear_edge_cases(spark):
    for docs in (cases.documents(spark, extra=True), cases.documents(spark, empty=True)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "token_records":
                assert out.columns == docs.columns, name
            assert out.count() <= 2 * n
    docs = cases.documents(spark).unionByName(cases.documents(spark))
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))


def test_mixed_rows_stand_in_schedule_order(spark):
    """Also with a column of maps and with repeated rows and ids."""
    rows = [(i % 300, f"{'word ' * (30 + i % 7)}{i % 290}", "en", "abc"[i % 3], i) for i in range(320)]
    docs = spark.createDataFrame(rows + rows[:5], cases.SCHEMA).withColumn("facts", F.expr("map('n', n_chars)"))
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    out = mixed.collect()
    assert mixed.columns == docs.columns and max(Counter((r["doc_id"], r["n_chars"]) for r in out).values()) <= 4
    placed, pieces = mixing.mix(docs.select("doc_id", "source", "text", corpus_pipeline._row_hash(docs).alias("row")))
    assert len(out) == mixing.scheduled_copies(placed, pieces).count()
    slots = {}
    for r in mixing.scheduled_copies(placed, pieces).collect():
        slots.setdefault((r["doc_id"], r["source"], r["size"]), set()).add(r["slot"])
    last = 0
    for r in mixed.collect():
        later = [s for s in slots[r["doc_id"], r["source"], len(r["text"].split())] if s >= last]
        assert later, "a copy stands before its slot's turn"
        last = min(later)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() > 0


def test_near_copies_go_by_text(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = one.replace("a39", "end")
    rows = [(1, one), (2, near), (2, two), (2, two), (3, three), (3, None), (None, one), (None, " ".join(reversed(two.split()))), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], cases.SCHEMA)
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[4], rows[5], *rows[7:]], key=str)


def test_noise_and_foreign_texts_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(20)]
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    ]
    bad = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(noise + foreign)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(bad), SF).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
    held_out = F.col("doc_id") % 3 == 0
    network = language.train(docs, ~held_out)
    named = docs.filter(held_out).withColumn("label", language.label_column(network, judge=True))
    assert named.filter("NOT label.familiar").count() == 0
