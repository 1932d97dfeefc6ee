import numpy as np
import pytest

from rangeloom.llm import embeddings as emb
from rangeloom.llm.queries import QUERIES


def brute(rows, threshold):
    ok = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = (np.array(v, np.float64), label)
    up = {i: i for i, _, _ in rows if i is not None}
    n = dict.fromkeys(up, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for i, (v, label) in ok.items():
        by.setdefault((label, len(v)), []).append(i)
    for ids in by.values():
        m = np.array([ok[i][0] for i in ids])
        with np.errstate(over="ignore"):
            m = m / np.abs(m).max(axis=1)[:, None]
        m = m / np.linalg.norm(m, axis=1)[:, None]
        c = m @ m.T
        for a, b in zip(*np.nonzero(np.triu(c >= threshold, 1))):
            a, b = ids[a], ids[b]
            n[a] += 1
            n[b] += 1
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (n[i], root(i), root(i) == i) for i in up}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 64, 2500):
        x = rng.normal(size=(80, dim)) * 10.0 ** rng.integers(-3, 3, (80, 1))
        y = x + rng.normal(size=x.shape) * np.abs(x).mean(axis=1, keepdims=True) * 0.3
        ux, uy = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
        (qx, sx, nx, ex), (qy, sy, ny, ey) = emb.quantise(ux), emb.quantise(uy)
        approx = emb._products(qx, qy) * sx[:, None] * sy
        assert (emb._products(qx, qy) == qx.astype(np.int64) @ qy.astype(np.int64).T).all()
        bound = ex[:, None] * ny + nx[:, None] * ey + ex[:, None] * ey + 1e-9
        assert (np.abs(ux @ uy.T - approx) <= bound).all()


def near(rng, n, dim):
    base = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.0, 0.15, 0.3, 0.6])
        rows.append((i, [float(x) for x in v], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("dim,block", [(8, 64), (64, 50), (64, 5000)])
def test_against_brute_force(spark, dim, block):
    rows = near(np.random.default_rng(dim + block), 600, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(emb.near_duplicate_vectors(df, block=block)) == brute(rows, 0.93)


def test_odd_rows(spark):
    a, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, a, 1), (2, a, 1), (3, a, None), (4, a, 2), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 2.0], 1), (9, [inf, 1.0, 2.0], 1), (10, [None, 1.0, 2.0], 1),
            (11, [1e300, 2e300, 3e300], 1), (12, [1e-300, 2e-300, 3e-300], 1), (13, [1.0, 2.0], 1), (14, [2.0, 4.0], 1), (15, [-1.0, -2.0, -3.0], 1)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, block string")
    got = result(emb.near_duplicate_vectors(df))
    assert got == brute(rows, 0.93)
    assert got[1] == (3, 1, True) and got[14] == (1, 13, False)
    assert emb.near_duplicate_vectors(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = result(QUERIES["op6_embeddings"](spark, "/root/testdata/sf0.1"))
    assert got == brute(rows, 0.93)
