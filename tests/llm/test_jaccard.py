import random

import numpy as np
import pytest

from holdfast.llm import jaccard, links, shingles
from holdfast.llm.components import components
from holdfast.llm.shingles import overlap, shingle_sets
from tests.llm import cases


def near(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def family(rng, n, size, edits):
    base = [f"w{rng.randrange(3000)}" for _ in range(size)]
    return [" ".join(near(base, rng, rng.randrange(edits + 1))) for _ in range(n)]


@pytest.mark.parametrize("extra", [False, True])
def test_classes_of_edge_cases(spark, extra):
    got = jaccard.jaccard_classes(cases.documents(spark, extra=extra)).collect()
    sets = {i: cases.shingles(t) for i, t, *_ in cases.rows() if i is not None}
    want = cases.classes(sets)
    assert {r["doc_id"]: r["component_id"] for r in got} == want | {None: None}
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"]} == {i: len(s) for i, s in sets.items()}
    assert len(got) == len(cases.rows())


def test_random_families_lose_no_link(spark):
    rng = random.Random(4)
    texts = []
    for size in (4, 5, 6, 7, 8, 9, 10, 12, 14, 18, 25, 40, 80, 200):
        for _ in range(4):
            texts += family(rng, 6, size, max(1, size // 40 + rng.randrange(2)))
        texts += [" ".join(f"w{rng.randrange(9)}" for _ in range(size)) for _ in range(6)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 40))) for _ in range(60)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == cases.classes({i: cases.shingles(t) for i, t, *_ in rows})


def test_chain_is_one_class(spark):
    """Neighbours are linked, ends are not: the class still holds all."""
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100]), "en", "a", 1) for i in range(10)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_signatures_meet_for_every_linked_pair():
    """Any two linked sets share a bucket in roles that may meet; checked over many random sizes."""
    rng = np.random.default_rng(8)
    bands = jaccard.Bands(80)

    def buckets(tokens):
        sigs = np.concatenate([np.empty(0, np.int64), *bands.signatures(np.unique(tokens))])
        return {(int(s) >> 2, int(s) & 3) for s in sigs}

    for _ in range(3000):
        n = int(rng.integers(4, 60))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        keep = int(rng.integers(max(1, int(0.75 * n)), n + 1))
        b = np.concatenate([a[:keep], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
        both = overlap(np.unique(a), np.unique(b))
        union = len(np.unique(np.concatenate([a, b])))
        if 100 * both < 80 * union or both == union:
            continue
        x, y = buckets(a), buckets(b)
        pairs = {(p, q) for k, p in x for m, q in y if k == m}
        assert any(min(p) == 0 and max(p) <= 1 or min(p) >= 2 and max(p) == 3 for p in pairs), (len(a), len(b), both)


def test_hashed_sets_match_plain_sets():
    texts = [t for _, t, *_ in cases.rows()] + ["A b c d e f", "a B c D e f", "x" * 3_000_000, "a " * 100_000]
    for text, tokens in zip(texts, shingle_sets(texts)):
        assert len(tokens) == len(cases.shingles(text))
    a, b = shingle_sets(["A b c d e F", "a B c D e f"])
    assert (a == b).all()


def test_empty_table_and_repeated_rows(spark):
    assert jaccard.jaccard_classes(cases.documents(spark, empty=True)).count() == 0
    text = cases.sentence(2)
    twice = spark.createDataFrame([(5, text, "en", "a", 1)] * 2 + [(4, text, "en", "a", 1)], cases.SCHEMA)
    assert [r["component_id"] for r in jaccard.jaccard_classes(twice).collect()] == [4, 4, 4]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_long_buffers_are_hashed_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    text = b" ".join(bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in [5, 300, 1, 90, 2, 2, 64, 65, 400, 7] * 3) + b"  "
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "BUFFER", 64)
    monkeypatch.setattr(shingles, "_POWERS", {})
    pieces = shingles.word_hashes(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces)) and len(whole[0]) == 30
    assert all(len(p) <= 128 for p in shingles._POWERS.values())


def plain_links(rows):
    sets = [cases.shingles(t) if i is not None else frozenset() for i, t, *_ in rows]
    return sorted((str(r[0]), sum(cases.linked(a, b) for y, b in enumerate(sets) if y != x)) for (x, a), r in zip(enumerate(sets), rows))


@pytest.mark.parametrize("block, shingles_of_block", [(1024, 1 << 20), (3, 1 << 20), (1024, 40)])
def test_link_counts_match_all_pairs(spark, block, shingles_of_block):
    """Also where a class is cut into many blocks, by members or by shingles."""
    rng = random.Random(6)
    texts = [t for size in (4, 7, 12, 40, 90) for t in family(rng, 12, size, max(1, size // 30))]
    texts += [texts[0], texts[30], texts[59]]
    rows = cases.rows() + [(100 + i, t, "en", "a", 1) for i, t in enumerate(texts)]
    rows += [(100, cases.sentence(3, 60), "en", "a", 1), (101, texts[1], "en", "a", 1)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    classes = jaccard.settle(jaccard.jaccard_classes(docs), "classes")
    got = links.with_links(docs, classes, block=block, block_shingles=shingles_of_block).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == plain_links(rows)


def test_link_counts_of_nothing(spark):
    docs = cases.documents(spark, empty=True)
    assert links.with_links(docs, jaccard.settle(jaccard.jaccard_classes(docs), "classes")).count() == 0


def test_common_shingles_over_many_columns(monkeypatch):
    monkeypatch.setattr(links, "COLUMNS", 7)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 50).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(50) < 0.93], rng.integers(0, 2**63, 3).astype(np.uint64)]) for _ in range(30)]
    copies = rng.integers(1, 5, 30)
    for left in (np.ones(30, bool), np.arange(30) < 11):
        want = [
            sum(
                copies[j]
                for j in range(30)
                if j != i
                and (left.all() or left[i] != left[j])
                and 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))
            )
            for i in range(30)
        ]
        assert links.linked_copies(sets, copies, left, 80).tolist() == want and max(want) > 0
