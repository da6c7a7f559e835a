import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolith.llm import ann


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        s = x @ x[ids.index(i)]
        order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k]
        out[i] = [(ids[j], float(s[j])) for j in order]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_and_scores(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 64)).astype(np.float32)
    x[:700] = x[0] + 0.05 * r.normal(size=(700, 64))  # a crowd
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32).astype(np.float64)
    ids = list(range(len(x)))
    got = run(spark, [(i, v.tolist()) for i, v in zip(ids, x)], block_rows=900, block_queries=60)
    want = brute(ids, x, ids[::20], 20)
    assert got.keys() == want.keys()
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / (20 * len(want))
    assert hit >= 0.95
    for q in got:
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        for v, s in got[q]:
            assert s == pytest.approx(float(x[v] @ x[q]), abs=1e-12)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 1.0, 1.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]),
            (6, [1.0, None, 1.0]), (7, [2.0, 0.0, 0.5]), (7, [2.0, 0.0, 0.5]), (None, [9.0, 9.0, 9.0]), (20, [0.0, 3.0, 0.0]), (40, [0.0, 0.0, 0.0]), (8, []), (9, [1.0])]
    got = run(spark, rows)
    assert got == {0: [(1, 3.0), (7, 3.0), (20, 0.0)], 20: [(1, 3.0), (0, 0.0), (7, 0.0)]}
    assert run(spark, []) == {}
    assert run(spark, [(1, [1.0])]) == {}


@pytest.mark.parametrize("block_rows", [25, 70, 198, 8192])
def test_repeated_vectors_tie_by_id(spark, block_rows):
    """Equal vectors, wherever they lie, have one score and stand in the order of their ids; clashing columns are ignored."""
    r = np.random.default_rng(block_rows)
    x = r.normal(size=(240, 16)).astype(np.float32)
    for of in (3, 50, 51):
        x[r.choice(240, 24, replace=False)] = x[of]
    x[7], x[8] = 0.0 * x[7] + [-0.0, 1.0] * 8, 0.0 * x[8] + [0.0, 1.0] * 8
    rows = [(i, v.tolist(), 1, "u") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, u int, query_id string").repartition(7)
    got = {}
    for a in ann.search(df, F.col("vec_id") % 20 == 0, rerank=30, block_rows=block_rows, block_queries=5).orderBy("query_id", "rank").collect():
        got.setdefault(a.query_id, []).append((a.vec_id, a.score))
    y, hits = x.astype(np.float64), 0
    for q in range(0, 240, 20):
        s = ann.products(y, y[q])
        want = sorted((j for j in range(240) if j != q), key=lambda j: (-s[j], j))[:20]
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(score == s[j] for j, score in got[q])
        for j, score in got[q]:  # no smaller id of an equal vector is left out
            assert all(i in [v for v, _ in got[q]] for i in range(j) if i != q and np.array_equal(y[i], y[j]))
        hits += len({j for j, _ in got[q]} & set(want))
    assert hits >= 0.9 * 240
