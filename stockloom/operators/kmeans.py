"""K-means of many sets of centres at once.

A set is one restart for one number of clusters. Every round hands the centres of all sets that still
move to the tasks; each batch of rows is read once and met with all of them, tasks add up members per
set and cluster, and one aggregate brings the new centres. A set leaves when none of its centres moves
further than a tolerance. A last pass tells the inertia of every set. Rounds are so many as the slowest set
needs, not the sum over sets.

Sets begin at the outcome of k-means on a sample of rows chosen by hash, at most ``sample`` of them, which every
task gets; the sets are dealt over tasks. What is left for the full data are few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockloom.functions.skew import shuffle_tasks
from stockloom.session import cut_lineage


@dataclass(frozen=True)
class Fit:
    """The centres of a set in rows and the sum of squared distances of all rows to their nearest."""

    k: int
    restart: int
    centers: np.ndarray
    inertia: float


def seeds(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """``k`` rows, each chosen in proportion to its squared distance to the nearest before it; fewer if rows are."""
    at = [int(draw.integers(len(x)))]
    away = np.square(x - x[at[0]]).sum(1)
    while len(at) < k and away.sum() > 0:
        at.append(int(draw.choice(len(x), p=away / away.sum())))
        away = np.minimum(away, np.square(x - x[at[-1]]).sum(1))
    return x[at].copy()


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its nearest centre (ties to the first) and the squared distance to it."""
    own = (np.square(centers).sum(1) - 2 * (x @ centers.T)).argmin(1)
    return own, np.square(x - centers[own]).sum(1)


def members(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per cluster the number and the sum of its rows; and the inertia."""
    own, away = nearest(x, centers)
    sums = np.stack([np.bincount(own, weights=column, minlength=len(centers)) for column in x.T], 1)
    return np.bincount(own, minlength=len(centers)), sums, float(away.sum())


def moved(centers: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means of the members; a centre without members stays."""
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)


def settled_on(x: np.ndarray, centers: np.ndarray, tolerance: float, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        new = moved(centers, *members(x, centers)[:2])
        still = np.square(new - centers).sum(1).max() <= tolerance**2
        centers = new
        if still:
            break
    return centers


def _begun(sample: DataFrame, features: list[str], names: list[tuple[int, int]], seed: int, tolerance: float, rounds: int) -> dict[int, np.ndarray]:
    """The centres each set (k and restart) begins with: k-means on the sample, a set in one task."""
    spark, d = sample.sparkSession, len(features)
    x = np.array([list(r) for r in sample.select(*features).collect()], float)
    if not len(x):
        raise ValueError("no rows to fit on")
    held = spark.sparkContext.broadcast(x)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(0).to_pylist()
            begin = (seeds(held.value, names[s][0], np.random.default_rng([seed, *names[s]])) for s in sets)
            found = [settled_on(held.value, c, tolerance, rounds).ravel() for c in begin]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["set", "centers"])

    tasks = min(len(names), shuffle_tasks(spark))
    rows = spark.range(0, len(names), 1, tasks).mapInArrow(fit, "set long, centers array<double>").collect()
    held.destroy()
    return {r["set"]: np.array(r["centers"]).reshape(-1, d) for r in rows}


def _totals(rows: DataFrame, features: list[str], sets: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """``members`` of all sets over all rows, in one pass."""
    d = len(features)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: [np.zeros(len(c), np.int64), np.zeros((len(c), d)), 0.0] for s, c in sets.items()}
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)], 1)
            for s, centers in sets.items():
                for n, part in enumerate(members(x, centers)):
                    total[s][n] = total[s][n] + part
        # a row for each cluster; the inertia goes with the first
        parts = [(s, i, int(n[i]), *map(float, sums[i]), inertia if i == 0 else 0.0) for s, (n, sums, inertia) in total.items() for i in range(len(n))]
        columns = [pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * (d + 1)))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["set", "cluster", "n", *(f"sum_{i}" for i in range(d)), "inertia"]
    schema = "set int, cluster int, n long, " + ", ".join(f"{c} double" for c in names[3:])
    added = rows.select(*features).mapInArrow(scan, schema).groupBy("set", "cluster").agg(*(F.sum(c).alias(c) for c in names[2:]))
    out = {s: [np.zeros(len(c), np.int64), np.zeros((len(c), d)), 0.0] for s, c in sets.items()}
    for r in added.collect():  # a row per centre
        n, sums, _ = out[r["set"]]
        n[r["cluster"]], sums[r["cluster"]] = r["n"], [r[f"sum_{i}"] for i in range(d)]
        out[r["set"]][2] += r["inertia"]
    return {s: tuple(v) for s, v in out.items()}


def fit_many(
    rows: DataFrame, key: str, features: list[str], ks: list[int], restarts: int = 10, seed: int = 42, tolerance: float = 1e-4,
    rounds: int = 300, sample: int = 16_384,
) -> dict[int, Fit]:
    """For each of ``ks`` the fit of least inertia among its restarts (ties to the first restart).

    ``rows`` are read once a round: store them if they are costly to compute.
    """
    draw = F.xxhash64(F.col(key), F.lit(seed))
    names = [(k, r) for k in ks for r in range(restarts)]
    found = _begun(rows.orderBy(draw, key).limit(sample), features, names, seed, tolerance, rounds)
    moving = set(found)
    for _ in range(rounds):
        if not moving:
            break
        for s, (counts, sums, _) in _totals(rows, features, {s: found[s] for s in sorted(moving)}).items():
            new = moved(found[s], counts, sums)
            if np.square(new - found[s]).sum(1).max() <= tolerance**2:
                moving.discard(s)
            found[s] = new
    best: dict[int, Fit] = {}
    for s, (_, _, inertia) in _totals(rows, features, found).items():
        k, restart = names[s]
        if k not in best or (inertia, restart) < (best[k].inertia, best[k].restart):
            best[k] = Fit(k, restart, found[s], inertia)
    return best


def label(features: list[str], centers: np.ndarray) -> Column:
    """The number of the nearest centre, ties to the first."""
    away = lambda c: sum((F.col(f) - F.lit(float(v))) ** 2 for f, v in zip(features, c))
    return F.array_min(F.array(*(F.struct(away(c).alias("away"), F.lit(i).alias("at")) for i, c in enumerate(centers))))["at"]


def stored_rows(rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """The key and features as doubles, stored."""
    return cut_lineage(rows.select(key, *(F.col(f).cast("double").alias(f) for f in features)))
