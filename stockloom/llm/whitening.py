"""Whitening of embeddings along their principal components, found by contour integration.

Vectors of whole numbers are summed per dimension, exactly, and their products after centring; both
sums are taken in numpy within a task, and one row per task and dimension is left to add up. Products
are centred on the mean rounded to a whole number, which makes them small and exact, and what rounding
moved is taken off exactly at the end. The covariance, whose size is the number of dimensions and not of
rows, goes to the driver, where ``feast`` finds its greatest eigenpairs and proves by inertia that none is
missed. One more pass projects the vectors, and a last one takes the covariance of what came out.

Defined cases: a vector that is null, empty or holds null or non-finite components takes no part, nor
does one whose length is not the commonest (of equally common ones the least); components beyond 2^61
are held there; a null vec_id is kept; repeated rows count as often as they occur; components without
variance, up to rounding, are left out, so constant vectors and an empty table give no rows; equal
eigenvalues share an arbitrary basis; deviations beyond 64 bits are held at the greatest number;
whatever other columns there are passes unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stockloom.llm import feast
from stockloom.llm.common import fresh, query, stored, table
from stockloom.llm.topk import scaled

HELD = 1 << 61
#: Numbers that a slice of a batch holds at most.
SLICE = 1 << 20


@dataclass
class Whitening:
    """What whitens a vector: its dimensions' sums over ``n`` vectors, components as rows, and their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def shift(self) -> np.ndarray:
        """The mean of each dimension, rounded to a whole number."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def past(self) -> list[int]:
        """n times what the mean exceeds the shift by."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.shift)]


def whole(embedding: Column, scale: int, added: int) -> Column:
    """floor(scale * x) + added of every component; null unless all are finite numbers."""
    held = lambda x: F.greatest(F.least(x, F.lit(HELD - added)), F.lit(-HELD - added))
    return F.transform(scaled(embedding, scale), lambda x: held(x) + F.lit(added).cast("long"))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with their vectors, which are of one length, as a matrix."""
    if not batch.num_rows:
        return
    width = len(batch.column(column)[0])
    step = max(1, SLICE // width)
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def totals(vectors: DataFrame, d: int) -> list[int]:
    """Exact sums of each dimension of the vectors ``x``, all of length ``d``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            for _, x in slices(batch, "x"):
                fits = float(np.abs(x).max()) * len(x) < HELD
                total = [a + int(b) for a, b in zip(total, x.sum(0) if fits else x.astype(object).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], names=["i", "total"])

    sums = vectors.select("x").mapInArrow(rows, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["i"]: int(r["total"]) for r in sums.collect()}  # d rows
    return [found[i] for i in range(d)]


def products(vectors: DataFrame, column: str, shift: np.ndarray) -> np.ndarray:
    """Sums of the products of all pairs of dimensions of ``column`` minus ``shift``. Whole numbers stay exact below 2^53."""
    d = len(shift)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for _, x in slices(batch, column):
                y = (x - shift).astype(float)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "products"])

    parts = vectors.select(column).mapInArrow(rows, "i int, products array<double>").select("i", F.posexplode("products").alias("j", "p"))
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("p").alias("p")).collect():  # d x d rows
        out[r["i"], r["j"]] = r["p"]
    return out


def fit(vectors: DataFrame, k: int = 8, max_d: int = 2048) -> Whitening | None:
    """The ``k`` components of most variance of the vectors ``x`` (whole numbers, of one length); None without vectors.

    The covariance of up to ``max_d`` dimensions, d x d numbers, fits a driver.
    """
    found = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return None
    if len(found) > 1 or found[0]["d"] > max_d:
        raise ValueError(f"vectors are not of one length of at most {max_d}")
    d, n = found[0]["d"], found[0]["n"]
    out = Whitening(n, totals(vectors, d), np.zeros((0, d)), np.zeros(0), 0.0)
    sums, past = products(vectors, "x", out.shift), out.past
    covariance = np.array([[(n * int(sums[i, j]) - past[i] * past[j]) / (n * n) for j in range(d)] for i in range(d)])
    out.variances, columns = feast.greatest(covariance, k)
    out.components, out.trace = columns.T, float(np.trace(covariance))
    return out


def whitened(vectors: DataFrame, model: Whitening) -> tuple[DataFrame, dict[str, str]]:
    """``vectors`` with columns for whitened (the projections over their deviations) and deviation (the sum
    over dimensions of (n * x - sum)^2); and the names those columns got, as ``vectors`` may use any."""
    names = fresh(vectors, ["whitened", "deviation"])
    schema = T.StructType([*vectors.schema.fields, T.StructField(names["whitened"], T.ArrayType(T.DoubleType())), T.StructField(names["deviation"], T.LongType())])
    n, shift, past = model.n, model.shift, model.past
    small = np.array([s / n for s in past])
    across = (model.components / np.sqrt(model.variances)[:, None]).T
    greatest = (1 << 63) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in slices(batch, "x"):
                y = x - shift
                out = (y - small) @ across
                reach = n * float(np.abs(y).max()) + max(map(abs, past))
                if reach * reach * len(shift) < HELD:
                    deviation = np.square(n * y - np.array(past, np.int64)).sum(1)
                else:
                    exact = np.square(n * y.astype(object) - np.array(past, object)).sum(1)
                    deviation = np.array([min(v, greatest) for v in exact], np.int64)
                columns = [*part.columns, pa.array(list(out), pa.list_(pa.float64())), pa.array(deviation, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vectors.mapInArrow(rows, schema), names


def commonest(vectors: DataFrame) -> DataFrame:
    """The vectors ``x`` of the commonest length, stored."""
    kept = stored(vectors.filter("x is not null"), "whole-vectors")
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), "d").first()
    return kept if first is None else kept.filter(F.size("x") == first["d"])


@query("op11_whitening")
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    source = table(spark, folder, "embeddings").select("vec_id", whole(F.col("embedding"), 1024, 100_000).alias("x"))
    vectors = commonest(source)
    model = fit(vectors, 8)
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return spark.createDataFrame([], empty)
    found, names = whitened(vectors, model)
    out = stored(found.select("vec_id", *names.values()), "whitened")
    k = len(model.variances)
    covariance = products(out, names["whitened"], np.zeros(k)) / model.n  # their mean is zero
    error = float(np.abs(covariance - np.eye(k)).max())
    share = F.array(*(F.lit(float(v / model.trace)) for v in model.variances))
    return out.select("vec_id", F.posexplode(names["whitened"]).alias("at", "value"), names["deviation"]).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col(names["deviation"]).alias("deviation"),
        F.col("value").alias("whitened"), F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
