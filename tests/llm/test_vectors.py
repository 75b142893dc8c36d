import math

import numpy as np
import pytest

from braidwell.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, block string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "b", "s") for i, v in rows], SCHEMA)


def brute(vectors, k, cost):
    out = {}
    for i, v in vectors.items():
        rank = sorted((cost(v, w), j) for j, w in vectors.items() if j != i)
        out[i] = rank[:k]
    return out


def dot(v, w):
    return -round(float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), 6)


def gap(v, w):
    return round(float(np.linalg.norm(np.float64(np.float32(v)) - np.float64(np.float32(w)))), 6)


@pytest.mark.parametrize("block", [16, 4096])
@pytest.mark.parametrize("kind", ["normal", "lengths", "equal"])
def test_both_equal_brute_force(spark, kind, block):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 12)).astype(np.float32)
    if kind == "lengths":
        x *= rng.exponential(1, (150, 1)).astype(np.float32) ** 3
    if kind == "equal":
        x = np.repeat(np.round(x[:10]), 15, axis=0)
    vectors = {i * 3: v.tolist() for i, v in enumerate(x)}
    df = table(spark, vectors.items())
    got = {}
    for r in topk.top_k(spark, df, k=5, block=block).collect():
        got.setdefault(r.vec_id, []).append((r.rank, (-r.score, r.neighbour_id)))
    want = brute(vectors, 5, dot)
    assert {i: [p for _, p in sorted(v)] for i, v in got.items()} == {i: [(s + 0.0, j) for s, j in v] for i, v in want.items()}
    got = {}
    for r in ann.neighbours(spark, df, k=5, block=block).collect():
        got.setdefault(r.vec_id, []).append((r.rank, (r.distance, r.neighbour_id)))
    assert {i: [p for _, p in sorted(v)] for i, v in got.items()} == brute(vectors, 5, gap)


def test_int8_bounds_hold():
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((80, 33)) * rng.exponential(5, (80, 1))).astype(np.float32)
    x[3] = 0
    q = ann.Quantised(x)
    middle, error = ann.bounds(q, q)
    true = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    assert (abs(true - middle) <= error).all()
    wide = rng.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (ann.int8_tile(wide, wide) == wide.astype(np.int64) @ wide.T.astype(np.int64)).all()


def test_awkward_rows(spark):
    rows = [(1, [1, 0, 0]), (2, [0, 0, 0]), (3, None), (None, [1, 1, 1]), (4, []), (5, [1, 2]), (6, [math.nan, 0, 0]), (7, [math.inf, 0, 0]), (8, [None, 0, 0]), (9, [2, 0, 1]), (9, [2, 0, 1]), (10, [0, 1, 0])]
    df = table(spark, rows)
    usable = {1: [1, 0, 0], 2: [0, 0, 0], 9: [2, 0, 1], 10: [0, 1, 0]}
    for rows, name in ((topk.top_k(spark, df).collect(), dot), (ann.neighbours(spark, df).collect(), gap)):
        assert {(r.vec_id, r.neighbour_id) for r in rows} == {(i, j) for i in usable for j in usable if i != j}
        best = brute(usable, 3, name)
        assert all(best[r.vec_id][r.rank - 1][1] == r.neighbour_id for r in rows)
    for f in (topk.top_k, ann.neighbours):
        assert f(spark, df.limit(0)).count() == 0
        assert f(spark, df.where("vec_id = 1")).count() == 0


def test_lower_bounds_of_one_product_are_below_all_distances():
    r = np.random.default_rng(5)
    for n, size in ((3, 1e-3), (64, 1.0), (700, 1e4)):
        x = np.concatenate([r.normal(size=(60, n)), np.zeros((2, n)), r.normal(size=(60, n)) * 1e-4]) * size
        q = ann.Quantised(x)
        left, right = ann.sides(q)
        exact = ((q.x[:, None] - q.x[None]) ** 2).sum(2)
        low = ann.lower_bounds(left, right, ann.margin(q, q))
        middle, error = ann.bounds(q, q)
        assert (low <= exact).all() and np.abs(low - (middle - error)).max() <= 2 * ann.margin(q, q)
