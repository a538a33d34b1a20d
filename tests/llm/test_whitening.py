import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import feast, whitening
from stockloom.llm.queries import QUERIES


def plain(rows, k):
    """n, deviations, eigenvalues (falling) and eigenvectors of exact covariances, by a full decomposition."""
    n, sums = len(rows), [sum(c) for c in zip(*rows)]
    off = [[n * x - s for x, s in zip(r, sums)] for r in rows]
    covariance = np.array([[sum(r[i] * r[j] for r in off) / n**3 for j in range(len(sums))] for i in range(len(sums))])
    values, vectors = np.linalg.eigh(covariance)
    return n, [sum(v * v for v in r) for r in off], values[::-1][:k], vectors[:, ::-1][:, :k], covariance


def spectrum(values, seed=0):
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (basis * np.array(values, float)) @ basis.T


CASES = {
    "spread": [100, 50, 20, 10, 9, 8, 7, 6, 5.9, 5, 4, 3, 2, 1],
    "one far": [1e6] + [1 + i * 1e-3 for i in range(30)],
    "close": [5 + 1e-6 * i for i in range(25)],
    "many equal": [9.0] * 10 + [1.0] * 20,
    "three only": [7, 5, 3] + [0] * 20,
    "decay": [10.0**-i for i in range(20)],
    "alone": [4.0],
}


@pytest.mark.parametrize("name", CASES)
def test_greatest_eigenpairs(name):
    a = spectrum(CASES[name])
    a = (a + a.T) / 2
    values, vectors = feast.greatest(a, 8)
    want = np.sort(CASES[name])[::-1][:8]
    want = want[want > 1e-11 * want[0]] if name != "decay" else want
    assert len(values) == len(want) and np.allclose(values, want, rtol=0, atol=1e-12 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * want[0]


@pytest.mark.parametrize("seed", range(20))
def test_inertia_counts(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 12))
    a = rng.integers(-3, 4, (n, n)).astype(float)
    a += a.T
    if seed % 4 == 0:
        np.fill_diagonal(a, 0)  # only pivots of two
    for shift in (-2.37, 0.21, 3.13):
        assert feast.below(a, shift) == (np.linalg.eigvalsh(a) < shift).sum()


def test_no_components_without_variance():
    assert len(feast.greatest(np.zeros((5, 5)), 8)[0]) == 0 and len(feast.greatest(np.zeros((0, 0)), 8)[0]) == 0


def test_projection_keeps_what_lies_inside():
    a = spectrum([10, 9, 4, 3, 2, 1])
    out = feast.project(a, 8, 12, np.eye(6), nodes=16)
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(out, vectors[:, values > 8] @ vectors[:, values > 8].T, atol=1e-6)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, r, "kept", 1.5) for i, r in rows], "vec_id long, x array<long>, whitened string, deviation double")


@pytest.mark.parametrize("offset", [0, 100_000, 10**12])
def test_against_full_decomposition(spark, offset):
    rng = random.Random(4)
    rows = [[offset + rng.randint(-400 // (j + 1), 500 // (j + 1)) for j in range(12)] for _ in range(200)]
    rows += [rows[0]] * 60
    data = vectors_of(spark, enumerate(rows)).repartition(5)
    model = whitening.fit(data, 8)
    n, deviation, values, columns, _ = plain(rows, 8)
    assert model.n == n and model.sums == [sum(c) for c in zip(*rows)]
    assert np.allclose(model.variances, values, rtol=1e-11)
    out, names = whitening.whitened(data, model)
    got = {r["vec_id"]: r for r in out.collect()}
    assert [got[i][names["deviation"]] for i in range(n)] == deviation
    assert all(r["whitened"] == "kept" and r["deviation"] == 1.5 for r in got.values())
    w = np.array([got[i][names["whitened"]] for i in range(n)])
    want = np.array([[x - offset for x in r] for r in rows], float)
    want = (want - want.mean(0)) @ columns / np.sqrt(values)
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-8
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9


def test_deviations_beyond_64_bits_are_held(spark):
    rows = [[10**11, 0], [0, 1], [5, 7]]
    data = vectors_of(spark, enumerate(rows))
    out, names = whitening.whitened(data, whitening.fit(data, 2))
    got = {r.vec_id: r[names["deviation"]] for r in out.collect()}
    assert [got[i] for i in range(3)] == [min(v, 2**63 - 1) for v in plain(rows, 2)[1]]


def test_awkward_vectors(spark):
    rows = [
        (1, [0.5, -0.001]), (None, [0.25, 1.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, []), (7, [1.0]),
        (8, [0.0, 3e38]), (1, [0.5, -0.001]), (9, [0.0, 0.0]),
    ]
    source = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = whitening.commonest(source.select("vec_id", whitening.whole(F.col("embedding"), 1024, 100_000).alias("x")))
    got = sorted(((r.vec_id, r.x) for r in kept.collect()), key=str)
    assert got == sorted([
        (1, [100512, 99998]), (1, [100512, 99998]), (None, [100256, 101024]), (8, [100000, 2**61]), (9, [100000, 100000]),
    ], key=str)
    assert whitening.fit(kept, 8).n == 5


def write(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "")], [(i, [0.5, 0.25], 0, "") for i in range(5)]])
def test_no_variance_gives_no_rows(spark, tmp_path, rows):
    got = QUERIES["op11_whitening"](spark, write(spark, rows, tmp_path))
    assert got.count() == 0 and {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"} == set(got.columns)


def test_query_on_a_table_of_copies(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 / (j + 1)) for j in range(9)], 0, "") for i in range(100)]
    rows += [(7, rows[7][1], 0, "")] * 50
    check_query(spark, write(spark, rows, tmp_path), [(i, [np.float32(x) for x in v]) for i, v, *_ in rows])


def test_query_against_full_decomposition(spark):
    folder = "/root/testdata/sf0.001"
    check_query(spark, folder, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()])


def check_query(spark, folder, source):
    rows = [[math.floor(1024 * float(x)) + 100_000 for x in v] for _, v in source]
    n, deviation, values, columns, covariance = plain(rows, 8)
    got = QUERIES["op11_whitening"](spark, folder).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i, _ in source for c in range(1, len(values) + 1))
    assert {r.n for r in got} == {n} and {(r.vec_id, r.deviation) for r in got} == {(i, d) for (i, _), d in zip(source, deviation)}
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[c + 1] for c in range(len(values))], values / np.trace(covariance), rtol=1e-10)
    (error,) = {r.identity_error for r in got}
    assert 0 <= error < 1e-10
    exact = np.array(rows, float)
    want = (exact - exact.mean(0)) @ columns / np.sqrt(values)
    of = {i: k for k, (i, _) in enumerate(source)}
    signs = np.ones(len(values))
    for r in got:
        k, c = of[r.vec_id], r.component - 1
        if k == 0:
            signs[c] = np.sign(r.whitened * want[k, c])
    for r in got:
        assert abs(r.whitened - signs[r.component - 1] * want[of[r.vec_id], r.component - 1]) < 1e-7
