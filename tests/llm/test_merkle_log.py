import hashlib
import zlib

import pytest

from holdfast.llm import merkle_log as m
from tests.llm import cases


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    out = ""
    for v in (row[0], row[3], row[2], row[4], row[1]):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def plain_levels(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([sha(*rows[-1][i : i + 2]) for i in range(0, len(rows[-1]), 2)])
    return rows


def plain_siblings(rows, i):
    out = []
    for row in rows[:-1]:
        run = row[i - i % 2 : i - i % 2 + 2]
        out.append((run[: i % 2], run[i % 2 + 1 :]))
        i //= 2
    return out


def plain_manifest(rows, tampered):
    """Rows of the manifest from lists, with every sibling taken from whole levels."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = plain_levels([plain_leaf(r) for r in groups[lang]])
    top = plain_levels([trees[x][-1][0] for x in langs])
    out = []
    for t, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            steps = plain_siblings(trees[lang], i) + plain_siblings(top, t)
            bad = tampered(r) and r[4] is not None
            folded = plain_leaf((*r[:4], r[4] + 1) if bad else r)
            for left, right in steps:
                folded = sha(*left, folded, *right)
            proof = sha(*[x for step in steps for side in step for x in side])
            root = top[-1][0]
            out.append((r[0], plain_leaf(r), trees[lang][-1][0], root, proof, folded, folded == root))
    return out


def postorder(level, index, n):
    if level == 0:
        return [(0, index)]
    out = []
    for child in (2 * index, 2 * index + 1):
        if child << (level - 1) < n:
            out += postorder(level - 1, child, n)
    return [*out, (level, index)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 32, 33, 100])
def test_positions_are_those_of_a_postorder_walk(spark, n):
    walk = postorder(m.height(n), 0, n)
    assert [m.log_position(k, i, n) for k, i in walk] == list(range(len(walk)))
    rows = spark.createDataFrame([(k, i, n) for k, i in walk], "k int, i long, n long")
    got = rows.selectExpr(f"{m.position_sql('k', 'i', 'n')} AS p").collect()
    assert [r.p for r in got] == list(range(len(walk)))


@pytest.mark.parametrize("n,bits", [(1, 2), (3, 2), (4, 2), (5, 1), (37, 2), (70, 3), (64, 1)])
def test_log_is_one_postorder_run(spark, n, bits):
    """Segments and upper nodes together hold every log position once, with the node that belongs there."""
    leaves = [sha(str(i)) for i in range(n)]
    rows = plain_levels(leaves)
    df = spark.createDataFrame([(0, n, i, bytes.fromhex(h)) for i, h in enumerate(leaves)], "tree long, n long, at long, digest binary")
    log = m.build_log(df, bits)
    found = {}
    for s in log.segments.collect():
        for k in range(len(s.nodes) // 32):
            found[s.base + k] = bytes(s.nodes[32 * k : 32 * k + 32]).hex()
    for u in log.uppers.collect():
        assert found.setdefault(u.pos, bytes(u.digest).hex()) == bytes(u.digest).hex()
    assert found == {m.log_position(k, i, n): h for k, row in enumerate(rows) for i, h in enumerate(row)}
    assert [bytes(r.root).hex() for r in log.roots().collect()] == [rows[-1][0]]


def tampers(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0


@pytest.mark.parametrize("bits", [1, 3, 10])
@pytest.mark.parametrize("extra", [False, True])
def test_manifest_equals_plain_version(spark, bits, extra):
    many = [(100 + i, cases.sentence(i, 6), ["en", "é", None][i % 3] if i % 5 else "en", "s", i) for i in range(90)]
    rows = cases.rows() + [cases.rows()[0]] * 2 + [(None, "x", None, None, None)] * 3 + many
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    if extra:
        for name in ("n", "at", "tree", "digest", "claimed", "level", "block", "name", "root"):
            docs = docs.selectExpr("*", f"map('a', 1) AS {name}")
    found = m.manifest(docs, "crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 0", bits)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key)
    assert got == sorted(plain_manifest(rows, tampers), key=key)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_path_folds_to_the_root(spark):
    for r in m.manifest(cases.documents(spark), None, 1).collect():
        others = [r.siblings[i : i + 64].encode() for i in range(0, len(r.siblings), 64)]
        assert m.fold(r.leaf.encode(), list(zip(r.sides, others, strict=True))).decode() == r.root
        assert r.verified


def test_empty_table_and_single_row(spark):
    assert m.manifest(cases.documents(spark, empty=True)).count() == 0
    one = m.manifest(cases.documents(spark).filter("doc_id = 1")).collect()
    assert [(r.leaf == r.subroot == r.root, r.proof_sha256) for r in one] == [(True, sha())]
