import hashlib
from collections import Counter, defaultdict

import pytest

from holdfast.llm import line_dedup, mixing
from tests.llm import cases

LETTERS = {i: i + 32 for i in range(65, 91)}


def plain_dedup(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LETTERS)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = {}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in holders or i == min(holders[key(x)])]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup_matches_plain(spark, extra):
    docs = cases.documents(spark, extra=extra)
    done = line_dedup.apply_bitmaps(docs.drop("kept"), line_dedup.keep_bitmaps(docs))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in done.collect()}
    assert got == plain_dedup(cases.rows())


def test_line_dedup_long_bitmaps_and_hot_lines(spark):
    lines = [f"line number {i} of many" for i in range(300)]
    rows = [(i, "\n".join([*lines[i % 7 :: 3], "a line that all documents share", "short"]), "en", "a", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    marks = line_dedup.keep_bitmaps(docs)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.apply_bitmaps(docs, marks).collect()}
    assert got == plain_dedup(rows)
    assert "text" not in marks.columns


def test_line_dedup_empty_and_repeated(spark):
    none = cases.documents(spark, empty=True)
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0
    twice = spark.createDataFrame([(1, "same line here", "en", "a", 1)] * 2 + [(2, "same line here", "en", "a", 1)], cases.SCHEMA)
    got = sorted((r["doc_id"], r["kept"]) for r in line_dedup.apply_bitmaps(twice, line_dedup.keep_bitmaps(twice)).collect())
    assert got == [(1, "same line here"), (1, "same line here"), (2, "")]


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares the budget by weight and again and again what is above the limits."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("extra", [False, True])
def test_mix_reaches_targets(spark, extra):
    docs = cases.documents(spark, extra=extra).drop("size")
    placed, pieces = mixing.mix(docs, block_words=64)
    got = mixing.taken_words(placed, pieces).collect()
    size, taken = Counter(), Counter()
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = plain_targets(size)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
    for source, target in want.items():
        assert abs(taken[source] - target) < 1
    assert len(got) == len(cases.rows())
    again = mixing.taken_words(*mixing.mix(docs, block_words=64)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["source"], r["taken"])
    assert sorted(map(key, got), key=str) == sorted(map(key, again), key=str)


def test_schedule_is_even_and_blocks_are_equal(spark):
    rows = [(i, "w " * 500, "en", "abc"[i % 3], 1) for i in range(60)]
    placed, pieces = mixing.mix(spark.createDataFrame(rows, cases.SCHEMA), block_words=100)
    slots = pieces.groupBy("slot", "source").sum("words").orderBy("slot").collect()
    inner = [r for r in slots if r["slot"] < 2**62]
    assert len({r["slot"] for r in slots}) == len(slots)
    assert sum(r["sum(words)"] == 100 for r in slots) >= len(slots) - 3
    first = Counter(r["source"] for r in inner[: len(inner) // 2])
    whole = Counter(r["source"] for r in inner)
    for source, n in whole.items():
        assert abs(first[source] - n / 2) <= 4


def test_slots_of_documents_and_copies(spark):
    """First and last slots are those of a row's pieces; unnamed rows are dealt over many buckets."""
    rows = [(i if i % 4 else None, "w " * (20 + i), "en", "ab"[i % 2], 1) for i in range(80)]
    placed, pieces = mixing.mix(spark.createDataFrame(rows, cases.SCHEMA), block_words=50)
    of = {}
    for r in pieces.collect():
        of.setdefault((r["source"], r["bucket"], r["seq"]), []).append((r["pass"], r["slot"]))
    got = mixing.taken_words(placed, pieces).collect()
    assert len({r["bucket"] for r in got if r["doc_id"] is None}) > 10
    for r in got:
        slots = [s for _, s in of.get((r["source"], r["bucket"], r["seq"]), [])]
        assert (r["first_slot"], r["last_slot"]) == ((min(slots), max(slots)) if slots else (None, None))
    copies = mixing.scheduled_copies(placed, pieces).collect()
    assert len(copies) == sum(r["copies"] for r in got)
    for r in copies:
        assert r["slot"] == min(s for p, s in of[r["source"], r["bucket"], r["seq"]] if p == r["pass"])


def test_mix_of_nothing(spark):
    placed, pieces = mixing.mix(cases.documents(spark, empty=True))
    assert mixing.taken_words(placed, pieces).count() == 0
    blank = spark.createDataFrame([(1, None, "en", None, 1), (2, "", "en", "a", 1)], cases.SCHEMA)
    got = mixing.taken_words(*mixing.mix(blank)).collect()
    assert {(r["doc_id"], r["size"], r["taken"]) for r in got} == {(1, 0, 0), (2, 0, 0)}


def test_queries_match_sql(spark):
    import duckdb

    from holdfast.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ("op3_line_dedup", "op9_mixing"):
        df = QUERIES[name](spark, sf)
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
        assert sorted(map(tuple, df.collect())) == want
    assert hashlib.sha256(b"").hexdigest()
