"""Neighbours against brute force: scores, order and recall; vectors that take no part; equal vectors."""

import numpy as np
import pytest

from auditlake.llm import op13_neighbours as N

SHAPE = "vec_id long, embedding array<float>, cell int, kth double"


def brute(pairs):
    ids, x = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.float32).astype(np.float64)
    out = {}
    for k in np.flatnonzero(ids % N.EVERY == 0):
        score = (x * x[k]).sum(1)
        other = np.delete(np.arange(len(ids)), k)
        order = other[np.lexsort((ids[other], -score[other]))][: N.TOP]
        out[int(ids[k])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(spark, rows):
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, SHAPE)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("kind", ["even", "clusters", "norms"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "CELL", 200)
    monkeypatch.setattr(N, "LEAF", 16)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24))
    if kind == "clusters":
        x = rng.standard_normal((40, 24))[rng.integers(0, 40, 3000)] * 3 + 0.2 * x
    if kind == "norms":
        x *= rng.lognormal(0, 0.7, 3000)[:, None]
    rows = [(int(k), v.tolist(), None, None) for k, v in enumerate(x.astype(np.float32))]
    got, want = found(spark, rows), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == N.TOP for v in got.values())
    assert recall(got, want) >= 0.95
    true = {(k, v): s for k, v, s in ((k, int(j), float(x[k].astype(np.float32).astype(float) @ x[j].astype(np.float32).astype(float))) for k in got for j, _ in got[k])}
    assert all(abs(s - true[q, v]) < 1e-9 * (1 + abs(s)) for q, a in got.items() for v, s in a)
    assert all(a == sorted(a, key=lambda p: (-p[1], p[0])) for a in got.values())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(r["embedding"]), None, None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = {}, brute(rows)
    for r in N.op13_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert recall(got, want) >= 0.95


def test_a_hot_vector_and_ties(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 50)
    rng = np.random.default_rng(2)
    rows = [(k, [1.0, 0.5, 0.25], None, None) for k in range(700)] + [(700 + k, rng.standard_normal(3).tolist(), None, None) for k in range(300)]
    got, want = found(spark, rows), brute(rows)
    assert recall(got, want) >= 0.95
    near = [k for k in got if k < 700]
    assert all([s for _, s in got[k]] == sorted((s for _, s in got[k]), reverse=True) for k in near)
    assert got[0] == want[0] and got[680] == want[680]


def test_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.0], 1, 1.0), (1, [2.0, 0.0], 1, 1.0), (2, [-1.0, 0.0], 1, None), (20, None, 1, None), (40, [0.0, 0.0], 1, None), (60, [1.0, None], 1, None), (80, [float("nan"), 1.0], 1, None), (100, [float("inf"), 1.0], 1, None), (120, [1.0], 1, None), (None, [1.0, 1.0], 1, None), (140, [], 1, None)]
    assert found(spark, rows) == {0: [(1, 2.0), (2, -1.0)]}


def test_few_none_and_repeated(spark):
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0], None, None)]) == {}
    twice = N.nearest(spark.createDataFrame([(20, [1.0], None, None), (20, [3.0], None, None)], SHAPE)).collect()
    assert [tuple(r) for r in twice] == [(20, 1, 20, 3.0), (20, 1, 20, 3.0)]


def test_quantile():
    assert abs(N.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3 and abs(N.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3
