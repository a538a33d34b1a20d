import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from stockloom.operators import kmeans

XY = ["x", "y"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    data = [(i, rng.gauss(5 * (i % 6), 1), rng.gauss(3 * (i % 4), 0.7)) for i in range(1500)]
    return kmeans.stored_rows(spark.createDataFrame(data, "id long, x double, y double").repartition(5), "id", XY)


def test_as_good_as_single_fits(points):
    fits = kmeans.fit_many(points, "id", XY, [2, 4, 7], restarts=5, sample=300)
    vectors = VectorAssembler(inputCols=XY, outputCol="features").transform(points)
    for k, fit in fits.items():
        single = min(KMeans(k=k, seed=s, maxIter=300).fit(vectors).summary.trainingCost for s in range(3))
        assert fit.k == k and len(fit.centers) == k and fit.inertia <= single * 1.001


def test_sets_together_are_what_each_is_alone(points):
    both = kmeans.fit_many(points, "id", XY, [3, 5], restarts=3, sample=200)
    for k in (3, 5):
        alone = kmeans.fit_many(points, "id", XY, [k], restarts=3, sample=200)[k]
        assert alone.restart == both[k].restart and np.allclose(alone.centers, both[k].centers) and alone.inertia == pytest.approx(both[k].inertia)


def test_inertia_and_labels_are_those_of_the_centres(points):
    fit = kmeans.fit_many(points, "id", XY, [4], restarts=2, sample=100)[4]
    x = np.array([(r.x, r.y) for r in points.orderBy("id").collect()])
    own, away = kmeans.nearest(x, fit.centers)
    assert fit.inertia == pytest.approx(away.sum())
    assert [r.at for r in points.orderBy("id").select(kmeans.label(XY, fit.centers).alias("at")).collect()] == own.tolist()
    means = np.stack([x[own == i].mean(0) for i in range(4)])
    assert np.abs(means - fit.centers).max() < 1e-3


def test_rows_are_read_once_a_round_for_all_sets(points, monkeypatch):
    passes, whole = [], kmeans._totals
    monkeypatch.setattr(kmeans, "_totals", lambda rows, features, sets: passes.append(len(sets)) or whole(rows, features, sets))
    kmeans.fit_many(points, "id", XY, [2, 3, 4, 5, 6], restarts=4, sample=200)
    assert passes[0] == 20 and passes[-1] == 20  # all begin, all are told their inertia
    assert passes[:-1] == sorted(passes[:-1], reverse=True) and len(passes) < 80  # and leave as they settle


def test_few_different_points(spark):
    rows = kmeans.stored_rows(spark.createDataFrame([(i, float(i % 2), 0.0) for i in range(10)], "id long, x double, y double"), "id", XY)
    fit = kmeans.fit_many(rows, "id", XY, [4], restarts=2)[4]
    assert fit.inertia == 0 and len(fit.centers) == 2
    with pytest.raises(ValueError):
        kmeans.fit_many(rows.filter(F.lit(False)), "id", XY, [2])
