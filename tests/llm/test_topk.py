import math
import random

import numpy as np
import pytest

from stockloom.llm import topk
from pyspark.sql import functions as F


def plain(rows, ask, k):
    out = []
    for q, v in sorted({i: min(x for j, x in rows if j == i) for i, _ in rows if i is not None and ask(i)}.items()):
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i is not None and i != q and len(w) == len(v)))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize(("block", "seeds"), [(4096, 2048), (3, 2)])
def test_against_all_pairs(spark, block, seeds):
    rng = random.Random(2)
    centres = [[rng.randint(-200, 200) for _ in range(20)] for _ in range(4)]
    rows = [(i, [c + rng.randint(-9, 9) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(i, list(rows[5][1])) for i in range(300, 310)] + [(7, list(rows[9][1])), (None, rows[3][1]), (400, [1, 2]), (410, [3, 4]), (420, [9])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(vectors, vectors.filter("vec_id % 10 = 0"), 5, block, seeds).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain(rows, lambda i: i % 10 == 0, 5)


def test_large_numbers_are_exact(spark):
    rows = [(0, [2**31, 1]), (1, [2**31, 0]), (2, [2**31, 1]), (3, [2**31, -1]), (4, [-(2**31), 0])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(vectors, vectors.filter("vec_id = 0"), 3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 2, 2**62 + 1), (2, 1, 2**62), (3, 3, 2**62 - 1)]


def test_bounds_hold_at_every_resolution():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-300, 300, (40, 37)), rng.integers(-300, 300, (50, 37))
    exact = a @ b.T
    for d in (37, 20, 3, 1):
        exact = a[:, :d] @ b[:, :d].T
        for level in topk.LEVELS:
            bound = topk.statistics(a[:, :d], level) @ topk.statistics(b[:, :d], level).T
            lengths = np.sqrt(np.square(a[:, :d]).sum(1))[:, None] * np.sqrt(np.square(b[:, :d]).sum(1))
            assert (bound >= exact - topk.ROUNDING * lengths).all()


def test_fine_levels_rule_out_most_pairs_of_even_vectors():
    rng = np.random.default_rng(1)
    rows, ask = np.floor(32 * rng.standard_normal((8000, 64))).astype(np.int64), np.floor(32 * rng.standard_normal((50, 64))).astype(np.int64)
    best = topk.Best(np.arange(50) - 50, ask, 5, np.full(50, np.iinfo(np.int64).min))
    best.offer(np.arange(400), rows[:400])
    best.settle()
    best.seen[:], best.spared[:] = 0, 0
    for lo in range(400, 8000, 400):
        best.offer(np.arange(lo, lo + 400), rows[lo : lo + 400])
    assert best.spared.sum() > 0.8 * 50 * 7600
    got = {(q, int(i)) for q, _, i in best.settle()}
    assert got == {(q, int(i)) for q in range(50) for i in np.argsort(-(rows @ ask[q]), kind="stable")[:5]}


def test_scaling_leaves_out_what_is_not_finite(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, []), (7, [0.999])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.v for r in vectors.select("vec_id", topk.scaled(F.col("embedding"), 256).alias("v")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: None, 7: [255]}


def test_extra_columns_and_long_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.randint(-50, 50) for _ in range(5000)], "kept", 1.0) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>, score string, rank double")
    got = topk.top_k(vectors, vectors.filter("vec_id < 4"), 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain([r[:2] for r in rows], lambda i: i < 4, 5)


def test_empty_tables(spark):
    vectors = spark.createDataFrame([], "vec_id long, v array<long>, score string")
    assert topk.top_k(vectors, vectors).count() == 0
