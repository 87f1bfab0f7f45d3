import numpy as np

from sitewright.llm import embedding_dedup as ED
from tests.llm.fixtures import as_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 0) for k, v in rows], SCHEMA)
    return df.selectExpr("*", "1 as v", "2 as uid", "3 as links", "4 as keys", "5 as key", "6 as copies") if clash else df


def brute(rows):
    good = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if k is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = {k: 0 for k, _ in rows}, {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {k: (links[k], root(k)) for k, _ in rows}


def vectors(n=300, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    rows = [(k, centres[k % 40] + rng.normal(size=dim) * rng.choice([0.02, 0.2, 0.4, 1.0])) for k in range(n)]
    rows += [(n + k, rows[k][1] * 2) for k in range(10)] + [(n + 10 + k, rows[k][1]) for k in range(10)]
    return [(k, v.astype(np.float32)) for k, v in rows]


def test_against_all_pairs(spark):
    rows = vectors()
    expected = brute(rows)
    for depth, tile in ((1, 1024), (1, 16), (2, 1024), (3, 8)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in ED.near_duplicates(frame(spark, rows, clash=True), tile=tile, depth=depth).collect()}
        assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in expected.values())
        assert all(got[k][0] <= expected[k][0] for k in got)
        if depth == 1:
            assert got == expected


def test_double_precision(spark):
    """Components beyond single precision, and pairs whose cosine single precision would move over the threshold."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=16)
    x /= np.linalg.norm(x)
    u = rng.normal(size=16)
    u -= (u @ x) * x
    u /= np.linalg.norm(u)
    at = lambda c: c * x + np.sqrt(1 - c * c) * u
    rows = [(1, x), (2, at(0.95 + 1e-12)), (3, -x * 1e200), (4, -at(0.95 - 1e-12) * 1e-200), (5, [1e39] * 3), (6, [2e39, 2e39, 2.1e39]), (7, [1e-46, 0, 0]), (8, [0, 1e-46, 0])]
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ED.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * u
    for depth, (tables, probes) in ED.TABLES.items():
        a, b = (ED.keys_of(v, depth, tables, min(probes, depth + 1)) for v in (x, y))
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() > 0.97


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(3).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ED.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(ED.hadamard(ED.hadamard(x)), x)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0, 0]), (3, [1, nan]), (4, [1, inf]), (5, [1, None]), (6, [1, 0]), (7, [2, 0]), (8, [1, 0, 0]), (9, [-1, 0]), (9, [-1, 0]), (None, [1, 0]), (10, [0.0, -1]), (11, [-0.0, -1])]
    got = as_rows(ED.near_duplicates(frame(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    alone = [(k, 0, k, True) for k in (0, 1, 2, 3, 4, 5, 8)]
    assert got == sorted([*alone, (6, 1, 6, True), (7, 1, 6, False), (9, 1, 9, True), (9, 1, 9, True), (10, 1, 10, True), (11, 1, 10, False), (None, 0, None, True)], key=repr)
    assert ED.near_duplicates(frame(spark, []).where("false")).count() == 0
