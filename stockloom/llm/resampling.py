"""Importance resampling: documents drawn so that they look like a target set.

Features are all runs of 1 to ``order`` words, hashed into buckets. A bucket's gain is the logarithm of
how much more often the target has it than all documents have, a document's weight the sum of its
features' gains, and adding Gumbel noise to weights and keeping the highest scores draws without
replacement in proportion to their exponentials.

Both passes over the documents intern the n-grams of a batch in an open-addressed numpy table
(``ngram_table``). The first sums the counts of its slots by bucket, one row per bucket and task; the
second gives each slot its bucket's gain, and the occurrences gather gains by their slots. What the
driver holds is one number per bucket. The order of scores comes from a distributed sort whose
partitions are counted, so no task ranks all documents.

Defined cases: a null or empty text has no features, weight 0, and is never drawn as long as
``min_words`` is over 0; texts of any length are taken in parts; an empty target has no counts; rows
that repeat are weighed and drawn one by one, a null doc_id is hashed as an empty text and comes
first among ties; weights are whole thousandths, floors go down; columns of any name pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from stockloom.llm.common import fresh, query, stored, table
from stockloom.llm.decontaminate import words
from stockloom.llm.ngram_table import interned


def texts_of(batch: pa.RecordBatch, column: str = "text", most: int = 256) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of a batch with the words of their texts."""
    for lo in range(0, batch.num_rows, most):
        part = batch.slice(lo, most)
        yield part, [words(x) for x in part.column(column).to_pylist()]


def bucket_counts(texts: DataFrame, order: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in texts_of(batch):
                for found, _ in interned(some, order):
                    # sums stay below 2^53 by far, so they are exact in doubles
                    total += np.bincount(found.buckets(buckets), weights=found.counts, minlength=buckets).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    counted = texts.select("text").filter("text is not null").mapInArrow(rows, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of shares, bucket by bucket."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = (float((int(b) + 1) * (s + n)) / float((int(a) + 1) * (t + n)) for a, b in zip(source, target))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, order: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns for n_words, n_features and weight; and the names those columns got."""
    names = fresh(docs, ["n_words", "n_features", "weight"])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[c], T.LongType()) for c in names)])
    buckets = len(gain)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in texts_of(batch):
                n_words = np.array([len(ws) for ws in some], np.int64)
                weight = np.zeros(len(some), np.int64)
                for found, of in interned(some, order):
                    slot_gain = gain[found.buckets(buckets)]
                    weight += np.bincount(of, weights=slot_gain[found.rows], minlength=len(some)).astype(np.int64)
                n_features = sum(np.maximum(n_words - k, 0) for k in range(order))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, (n_words, n_features, weight))], names=schema.names)

    return docs.mapInArrow(rows, schema), names


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, by a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(
    docs: DataFrame, target: DataFrame, order: int = 3, buckets: int = 10_000, seed: int = 42, keep: list[str] | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """A stored table of ``docs`` (the columns ``keep``, by default all) with n_words, n_features, weight,
    score and row, a number for each row; and the names those columns got, as ``docs`` may use any."""
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    found, names = weighed(docs, gain, order)
    names |= fresh(found, ["score", "row"])
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    out = found.select(
        *kept, *(names[c] for c in ("n_words", "n_features", "weight")),
        (F.col(names["weight"]) + noise(F.col("doc_id"), seed)).alias(names["score"]), F.monotonically_increasing_id().alias(names["row"]),
    )
    return stored(out, "scored"), names


def ranked(found: DataFrame, names: dict[str, str], percent: int = 5, min_words: int = 20) -> tuple[DataFrame, int]:
    """The rows of ``scored`` with rank (1, 2, 3, ... for those drawn, else null), and how many are drawn.

    Of the documents with ``min_words`` words, ``percent`` in a hundred are drawn, the highest scores first.
    """
    more = fresh(found, ["rank", "able", "part", "place"])
    able, part, place = (more[x] for x in ("able", "part", "place"))
    # the row number tells rows apart that repeat, so that no range of the sort holds them all
    order = [F.desc(able), F.desc(names["score"]), "doc_id", names["row"]]
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = stored(
        found.withColumn(able, F.col(names["n_words"]) >= min_words).orderBy(*order).withColumns({part: F.spark_partition_id(), place: in_part}), "sorted"
    )
    sizes = stored(sorted_rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(able).cast("long")).alias("able")), "sizes")
    quota = (sizes.agg(F.sum("able")).first()[0] or 0) * percent // 100
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row for each task of the sort
    starts = sizes.select(F.col(part).alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.col(place) + F.col("before") + 1
    out = sorted_rows.join(F.broadcast(starts), F.col(part) == F.col("of"))
    kept = [F.col(f"`{c}`") for c in found.columns]
    return out.select(*kept, F.when(F.col(able) & (rank <= quota), rank).cast("long").alias(more["rank"])), quota


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, **more) -> DataFrame:
    """The drawn rows of ``docs``; takes the parameters of ``scored``.

    Only ids and scores are sorted. The last row drawn then serves as the limit for whole rows.
    """
    found, names = scored(docs, target, **more)
    narrow = found.select(F.col("doc_id"), *names.values())
    order, quota = ranked(narrow, names, percent, min_words)
    last = order.filter(F.col(order.columns[-1]) == quota).first()
    if last is None:
        return docs.filter(F.lit(False))
    score, doc_id, row = (F.lit(last[c]) for c in (names["score"], "doc_id", names["row"]))
    later = F.when(F.col("doc_id").eqNullSafe(doc_id), F.col(names["row"]) > row).otherwise(
        F.when(F.col("doc_id").isNull(), False).when(doc_id.isNull(), True).otherwise(F.col("doc_id") > doc_id)
    )
    left_out = (F.col(names["score"]) < score) | ((F.col(names["score"]) == score) & later)
    return found.filter((F.col(names["n_words"]) >= min_words) & ~left_out).select(*(F.col(f"`{c}`") for c in docs.columns))


@query("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found, names = scored(docs, table(spark, folder, "benchmark"), keep=["doc_id"])
    return ranked(found, names, percent=5, min_words=20)[0].drop(names["n_words"], names["row"])
