import math

import numpy as np
import pytest
from runlens.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, id int, node string, vector int, dim string, key int"


def expected(rows, threshold=0.9):
    dims = [len(e) for _, e in rows if usable(e)]
    dim = max(sorted(set(dims)), key=dims.count, default=0)
    good = [usable(e) and len(e) == dim for _, e in rows]
    part = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    units = [np.float32(e).astype(float) / np.linalg.norm(np.float32(e).astype(float)) if g else None for (_, e), g in zip(rows, good)]
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                part[find(i)] = find(j)
    first = {}
    for i, (v, _) in enumerate(rows):
        first.setdefault(find(i), []).append(v)
    first = {p: min((x for x in v if x is not None), default=None) for p, v in first.items()}
    return [(v, links[i], first[find(i)]) for i, (v, _) in enumerate(rows)]


def usable(e):
    return bool(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)


def frame(spark, rows):
    return spark.createDataFrame([(v, e, None, 1, "n", 2, "d", 3) for v, e in rows], SCHEMA).repartition(3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    rows = [
        (1, a), (2, a), (3, [2 * x for x in a]), (4, b), (4, b), (5, None), (6, []), (7, [0.0] * 4), (8, [1.0, None, 2.0, 3.0]),
        (9, [nan, 1.0, 1.0, 1.0]), (10, [inf, 1.0, 1.0, 1.0]), (None, b), (None, [9.0, 9.0, -9.0, 9.0]), (11, [1.0, 2.0]),
        (12, [-0.0, 0.0, 1.0, 0.0]), (13, [0.0, 0.0, 1.0, 0.0]),
    ]
    got = vector_dedup.near_duplicates(frame(spark, rows)).collect()
    want = expected(rows)
    assert sorted([(r["id"], r["n_links"], r["component_id"]) for r in got], key=repr) == sorted(want, key=repr)
    assert sum(r["kept"] for r in got) == len({(w[2]) for w in want}) and len(got) == len(rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [0.0, 0.0])], [(1, [3.0]), (2, [5.0]), (3, [-1.0])]])
def test_nothing_to_index(spark, rows):
    got = vector_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == sorted(expected(rows))


@pytest.mark.parametrize("block", [2048, 5])
def test_groups_are_counted_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    random = np.random.default_rng(3)
    centres = random.normal(size=(60, 16))
    sizes = random.choice([1, 2, 30], 60)
    points = np.repeat(centres, sizes, axis=0) + random.normal(size=(sizes.sum(), 16)) * 0.12
    points[::7] = points[0]
    rows = [(i, p) for i, p in enumerate(points.astype(np.float32).tolist())]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(frame(spark, rows)).collect()}
    want = {v: (n, c) for v, n, c in expected(rows)}
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[v][0] <= want[v][0] for v in want)
    assert found >= 0.97 * there


def test_recall_on_the_table(spark):
    """Against brute force over all rows, for the queries whose id is divisible by 100."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in vectors.collect())
    units = np.array([e for _, e in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    got = {r["id"]: r["n_links"] for r in vector_dedup.near_duplicates(vectors).collect()}
    queries = [i for i, (v, _) in enumerate(rows) if v % 100 == 0]
    there = [(units[i] @ units.T >= 0.9).sum() - 1 for i in queries]
    assert sum(got[rows[i][0]] for i in queries) >= 0.9 * sum(there)


def test_links_at_the_threshold_are_found(spark):
    """Pairs turned by nearly the threshold's angle in random directions: the hardest links."""
    random = np.random.default_rng(5)
    a = random.normal(size=(600, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    t = random.normal(size=a.shape)
    t -= (t * a).sum(1, keepdims=True) * a
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    b = 0.905 * a + (1 - 0.905**2) ** 0.5 * t
    rows = [(i, p) for i, p in enumerate(np.concatenate([a, b]).astype(np.float32).tolist())]
    got = vector_dedup.near_duplicates(frame(spark, rows)).collect()
    there = sum(n for _, n, _ in expected(rows))
    assert there >= 1200 and sum(r["n_links"] for r in got) >= 0.9 * there


def test_each_length_has_its_links(spark):
    """Two frequent lengths, a rare one and numbers, against brute force per length."""
    random = np.random.default_rng(11)
    vectors = []
    for dim, centres in ((16, 320), (24, 300), (5, 20)):
        points = np.repeat(random.normal(size=(centres, dim)), 2, axis=0)
        points[::2] += random.normal(size=points[::2].shape) * 0.05
        vectors += points.astype(np.float32).tolist() + points[:6].astype(np.float32).tolist()
    vectors += [[2.0], [3.0], [-1.0]]
    rows = [(i, vectors[j]) for i, j in enumerate(random.permutation(len(vectors)).tolist())]
    want = {}
    for dim in (16, 24, 5, 1):
        want |= {v: (n, c) for v, n, c in expected([r for r in rows if len(r[1]) == dim])}
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(got[v][0] <= want[v][0] for v in want)
    for dim in (16, 24):
        ids = [v for v, e in rows if len(e) == dim]
        assert sum(got[v][0] for v in ids) >= 0.97 * sum(want[v][0] for v in ids) > 0
    assert all(got[v] == want[v] for v, e in rows if len(e) < 16)


def test_finite_vectors_of_any_size_are_linked(spark):
    """Squares of these components are no doubles any more, or zero."""
    rows = [
        (1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 0.0]), (4, [1e-200, 0.0]), (5, [5e-324, 0.0]),
        (6, [1.7e308, 1.6e308]), (7, [-1e200, 1e200]), (8, [0.0, 0.0]), (9, [float("inf"), 1.0]), (10, [3.0, 0.01]),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(docs).collect()}
    one, two = {1, 2, 6}, {3, 4, 5, 10}
    want = {i: (len(c) - 1, min(c)) for c in (one, two) for i in c} | {i: (0, i) for i in (7, 8, 9)}
    assert got == want
