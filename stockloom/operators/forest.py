"""A fitted forest of regression trees as arrays, to be walked in numpy by whole batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from stockloom.session import run_dir


@dataclass(frozen=True)
class Forest:
    """All nodes of all trees, one after the other. A leaf leads to itself. Values are first brought to the
    scale the trees were grown on: less ``means``, times ``scales``."""

    means: np.ndarray
    scales: np.ndarray
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @property
    def size(self) -> int:
        """Bytes of all arrays."""
        return sum(x.nbytes for x in vars(self).values())

    def predict(self, x: np.ndarray, step: int = 4096) -> np.ndarray:
        """The mean of the trees' values for each row."""
        out = np.empty(len(x))
        for lo in range(0, len(x), step):
            rows = (x[lo : lo + step] - self.means) * self.scales
            at = np.repeat(self.roots[None, :], len(rows), 0)
            here = np.arange(len(rows))[:, None]
            while True:
                inner = self.left[at] != at
                if not inner.any():
                    break
                below = rows[here, self.feature[at]] <= self.threshold[at]
                at = np.where(below, self.left[at], self.right[at])
            out[lo : lo + step] = np.add.accumulate(self.value[at], axis=1)[:, -1] / len(self.roots)
        return out


def flattened(spark: SparkSession, pipeline: PipelineModel, max_bytes: int = 256 << 20) -> Forest:
    """The arrays of a pipeline of assembler, scaler, factors and forest. The forest's own table of nodes is
    written and read, so nodes come in one go; ``max_bytes`` bounds what is handed to every task."""
    _, scaler, factors, trees = pipeline.stages
    path = run_dir(spark, "forest")
    trees.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories",
    )
    n = nodes.count()
    if n * 40 > max_bytes:
        raise ValueError(f"a forest of {n} nodes is too large to broadcast")
    rows = nodes.toPandas().sort_values(["treeID", "id"]).reset_index(drop=True)
    if (rows["numCategories"] >= 0).any():
        raise ValueError("splits by category are not supported")
    first = rows.groupby("treeID").cumcount().eq(0)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    inner = rows["leftChild"].to_numpy() >= 0
    child = lambda c: np.where(inner, start + rows[c].to_numpy(), np.arange(n))
    cut = np.array([v[0] if len(v) else 0.0 for v in rows["leftCategoriesOrThreshold"]])
    deviations = scaler.std.toArray()
    scales = np.where(deviations > 0, 1.0 / np.where(deviations > 0, deviations, 1.0), 0.0) * factors.getScalingVec().toArray()
    return Forest(
        scaler.mean.toArray(), scales, np.flatnonzero(first), np.maximum(rows["featureIndex"].to_numpy(), 0), cut,
        child("leftChild"), child("rightChild"), rows["prediction"].to_numpy(),
    )
