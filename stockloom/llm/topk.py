"""Exact search for the highest inner products, pruned by segment statistics at several resolutions.

A vector is cut into segments, each summed up by its mean and deviation. For two vectors the part
of the inner product within a segment is at most its length times the product of the means plus
the product of the deviations, which is the same as a lower bound of their distance there. Bounds
are taken over one segment, then over more and more, at last over single components for a half and
three quarters of the vector and pairs for the rest; a pair goes on only while its bound reaches the query's
k-th best score so far, and the scores of those left are computed exactly, pair by pair once few are left.

The queries are a stated set and are taken in blocks of ``block`` vectors, a size that memory bounds. Blocks
run one after the other, each broadcast for one pass over all vectors, its result stored, and released, so
neither driver nor executors hold more than one. A first threshold per query comes from a bounded
number of vectors; being scores of real candidates it excludes nothing that belongs to the answer.
Each task keeps the k best of each query, so that no group grows with the data.

Defined cases: a vector that is null, empty, or holds null or non-finite components takes no part, nor
does a row without vec_id; only vectors of one length are compared; rows with the query's own
vec_id are no candidates; of several rows with a query's vec_id the smallest vector asks; other
repeated candidates count as often as they occur; ties go to the smaller vec_id; scores beyond 64
bits are held at the ends of that range; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from stockloom.llm.common import query, stored, table

#: Segments of a level in the first share of the vector, and what share of it is taken component by component.
LEVELS = ((1, 0.0), (4, 0.0), (16, 0.0), (32, 0.0), (32, 0.5), (32, 0.75))
#: Below this share of live pairs, pairs are looked at one by one.
FEW = 0.125
#: Rounding of a bound, as a share of the product of the lengths of both vectors.
ROUNDING = 1e-12
EXACT = float(1 << 53)


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, null unless all are finite numbers."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine & (F.size(embedding) > 0), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


def statistics(rows: np.ndarray, level: tuple[int, float]) -> np.ndarray:
    """The first components as they are, then the means and deviations of the segments of the rest side by
    side, weighted so that a product of two such rows is the bound."""
    parts, share = level
    d = rows.shape[1]
    width, alone = -(-d // min(parts, d)), int(d * share)
    padded = np.zeros((len(rows), -(-(d - alone) // width) * width))
    padded[:, : d - alone] = rows[:, alone:]
    cut = padded.reshape(len(rows), -1, width)
    mean = cut.mean(2)
    deviation = np.sqrt(np.square(cut - mean[:, :, None]).mean(2))
    return np.concatenate([rows[:, :alone], mean * np.sqrt(width), deviation * np.sqrt(width)], 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    big = np.dot(a.astype(object), b.T.astype(object))
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def pairwise(a: np.ndarray, b: np.ndarray, q: np.ndarray, c: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Products of the rows ``q`` of ``a`` with the rows ``c`` of ``b``, pair by pair."""
    if not len(q):
        return np.zeros(0, a.dtype)
    return np.concatenate([np.einsum("ij,ij->i", a[q[i : i + step]], b[c[i : i + step]]) for i in range(0, len(q), step)])


class Best:
    """The k best of each query so far, all of one vector length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.rows, self.k = ids, rows, k
        self.levels = [statistics(rows, level) for level in LEVELS]
        self.lengths = np.sqrt(np.square(rows.astype(float)).sum(1))
        self.seen, self.spared = np.zeros(len(LEVELS), np.int64), np.zeros(len(LEVELS), np.int64)  # pairs that reach a level, and that end there
        self.floor = floor.copy()  # a score below it can't be among the best
        self.known = np.zeros(len(ids), bool)  # whether the floor is a score, not just the lowest number
        self.known |= floor > np.iinfo(np.int64).min
        self.found = [np.empty((0, 3), np.int64)]

    def offer(self, ids: np.ndarray, rows: np.ndarray) -> None:
        live = self.ids[:, None] != ids[None, :]
        longest = np.sqrt(np.square(rows.astype(float)).sum(1).max(initial=0))
        least = np.where(self.known, self.floor.astype(float), -np.inf) - ROUNDING * (np.abs(self.floor.astype(float)) + self.lengths * longest)
        for n, own in enumerate(self.levels):  # coarse to fine, on what is left
            before = np.count_nonzero(live)
            if not before:
                return
            other = statistics(rows, LEVELS[n])
            if before > FEW * live.size:
                live &= own @ other.T >= least[:, None]
            else:
                q, c = np.nonzero(live)
                live[q, c] = pairwise(own, other, q, c) >= least[q]
            self.seen[n] += before
            self.spared[n] += before - np.count_nonzero(live)
        left = np.count_nonzero(live)
        safe = float(np.abs(self.rows).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1] < EXACT
        if left > FEW * live.size or not safe:
            q, c = np.flatnonzero(live.any(1)), np.flatnonzero(live.any(0))
            scores = products(self.rows[q], rows[c])
            take = live[np.ix_(q, c)] & (scores >= self.floor[q, None])
            if scores.shape[1] > self.k:  # no score below the k-th of this block either
                masked = np.where(take, scores, np.iinfo(np.int64).min)
                take &= scores >= np.partition(masked, -self.k, axis=1)[:, -self.k, None]
            at, which = np.nonzero(take)
            self.found.append(np.stack([q[at], scores[at, which], ids[c][which]], 1))
        else:
            q, c = np.nonzero(live)
            scores = pairwise(self.rows, rows, q, c)
            take = scores >= self.floor[q]
            self.found.append(np.stack([q[take], scores[take], ids[c[take]]], 1))
        if sum(map(len, self.found)) > 4 * self.k * len(self.ids):
            self.settle()

    def settle(self) -> np.ndarray:
        """Keep the k best of each query and raise the floors."""
        rows = np.concatenate(self.found)
        rows = rows[np.lexsort((rows[:, 2], ~rows[:, 1], rows[:, 0]))]  # ~x falls as x rises, at both ends too
        first = np.searchsorted(rows[:, 0], np.arange(len(self.ids)))
        rank = np.arange(len(rows)) - first[rows[:, 0]]
        rows = rows[rank < self.k]
        last = rank[rank < self.k] == self.k - 1
        self.floor[rows[last, 0]] = np.maximum(self.floor[rows[last, 0]], rows[last, 1])
        self.known[rows[last, 0]] = True
        self.found = [rows]
        return rows


def matrices(ids: list[int], vectors: list[list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by vector length."""
    by: dict[int, list[int]] = defaultdict(list)
    for i, v in enumerate(vectors):
        by[len(v)].append(i)
    return {n: (np.array([ids[i] for i in at], np.int64), np.array([vectors[i] for i in at], np.int64)) for n, at in by.items()}


def batch_matrices(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    if len(set(sizes.tolist())) == 1:
        return {int(sizes[0]): (ids.astype(np.int64), flat.reshape(len(ids), -1))}
    return matrices(ids.tolist(), lists.to_pylist())


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, seeds: int = 2048) -> DataFrame:
    """The ``k`` highest inner products of each query: query_id, rank, vec_id, score.

    ``vectors`` and ``queries``: vec_id and v, an array of whole numbers. ``seeds``: vectors for first
    thresholds, of which a twentieth of all is the most.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").filter("vec_id is not null and size(v) > 0"), "vectors")
    asking = queries.filter("vec_id is not null and size(v) > 0")
    asking = stored(asking.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v")), "queries")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(seeds, rows.count() // 20)).collect()
    first = matrices([r["vec_id"] for r in sample], [r["v"] for r in sample])
    blocks, parts = max(1, -(-asking.count() // block)), []
    low = np.iinfo(np.int64).min
    for n in range(blocks):
        part = asking.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()
        sets = {}
        for size, (ids, own) in matrices([r["vec_id"] for r in part], [r["v"] for r in part]).items():
            floor = np.full(len(ids), low, np.int64)
            if size in first:
                start = Best(ids, own, k, floor)
                start.offer(*first[size])
                start.settle()
                floor = start.floor
            sets[size] = (ids, own, floor)
        held = spark.sparkContext.broadcast(sets)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best = {size: Best(ids, own, k, floor) for size, (ids, own, floor) in held.value.items()}
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    for size, found in batch_matrices(batch.slice(lo, 1024)).items():
                        if size in best:
                            best[size].offer(*found)
            for one in best.values():
                rows = one.settle()
                columns = [pa.array(one.ids[rows[:, 0]]), pa.array(rows[:, 2]), pa.array(rows[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(scan, "query_id long, vec_id long, score long")
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(stored(best, "top-k"))
        held.destroy()
    return reduce(DataFrame.unionByName, parts)


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op4_topk", SQL)
def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", scaled(F.col("embedding"), 256).alias("v"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)
