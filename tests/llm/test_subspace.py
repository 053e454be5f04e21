import numpy as np
import pytest

from holdfast.llm import subspace

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, least):
    """(vec_id, n_links, component_id, kept) of every row from all pairs; rows are told apart by place."""
    valid = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        valid.append(np.array(v, np.float32).astype(float) if ok else None)
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = valid[i], valid[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if np.array_equal(a, b) or a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[top(i)] = min(low.get(top(i), rows[i][0]), rows[i][0])
    return [(r[0], k, c := low.get(top(i)), r[0] is not None and r[0] == c) for i, (r, k) in enumerate(zip(rows, links))]


def cluster(rng, dim, n, noise):
    base = rng.standard_normal(dim)
    base /= np.linalg.norm(base)
    return [(base + noise * rng.standard_normal(dim) / np.sqrt(dim)) * rng.uniform(0.5, 3) for _ in range(n)]


def vectors(seed, dim, copies=True):
    rng = np.random.default_rng(seed)
    found = [rng.standard_normal(dim) for _ in range(80)]
    for n, noise in ((2, 0.05), (60, 0.14), (25, 0.2), (3, 0.0001), (40, 0.19)):
        found += cluster(rng, dim, n, noise)
    found = [[float(x) for x in v.astype(np.float32)] for v in found]
    rows = [(int(i), v, int(rng.integers(0, 2)) if k < 80 else 0) for k, (i, v) in enumerate(zip(rng.permutation(len(found)), found))]
    if copies:
        rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    return rows


def odd(dim):
    one = [1.0] * dim
    return [
        (2000, None, 1), (2001, [], 1), (2002, [0.0] * dim, 1), (2003, [None] + one[1:], 1), (2004, [float("nan")] + one[1:], 1),
        (2005, [float("inf")] + one[1:], 1), (2006, one, None), (2007, one, None), (2008, one, 1), (2009, one[:-1], 1),
        (None, one, 1), (None, [x * 2 for x in one], 7), (2010, [1e30] * dim, 1), (2010, one, 1), (2010, [-1.0] * dim, 1), (2011, [1e-30] * dim, 1),
    ]


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "n", "block", "copies"):
        df = df.selectExpr("*", f"map(1, 2) AS {name}")
    got = [tuple(r) for r in subspace.near_duplicates(df, **how).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain(rows, how.get("least", 0.98)), key=key)
    return got


@pytest.mark.parametrize("dim", [3, 16, 64])
def test_equals_all_pairs(spark, dim):
    got = check(spark, vectors(dim, dim) + odd(dim))
    assert sum(r[1] for r in got) > 1000


@pytest.mark.parametrize("dim,least", [(20, 0.98), (12, 0.9)])
def test_large_groups_are_cut_into_regions_and_parts(spark, dim, least):
    check(spark, vectors(dim, dim), least=least, region=40, chunk=16)


def test_candidates_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(subspace, "PAIRS", 50)
    rng = np.random.default_rng(1)
    points = rng.standard_normal((60, 4)) * 0.01
    grid = subspace.Grid(points, 0.01)
    found = [p for own, other in grid.pairs(points) for p in zip(own.tolist(), other.tolist())]
    near = {(i, j) for i in range(60) for j in range(60) if ((points[i] - points[j]) ** 2).sum() <= 0.01}
    assert near <= set(found) and len(found) == len(set(found))


def test_empty_table(spark):
    assert subspace.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
