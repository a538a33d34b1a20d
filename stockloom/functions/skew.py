"""Splitting keys that hold too many rows for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.session import cut_lineage


def shuffle_tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle. Stated where a few bytes unfold to many rows, as the planner would
    otherwise judge by the bytes and merge the tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def big_keys(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    """Keys with more than ``max_rows`` rows and the number of parts each needs.

    Counts combine before the shuffle. The (usually empty) answer is stored, so that callers can
    ask whether there is any and leave out the extra join when there is none.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    big = sizes.filter(F.col("n") > max_rows).select(key, F.ceil(F.col("n") / max_rows).alias("parts"))
    return cut_lineage(big)


#: A key with more than this share of all rows is split, so at most 1000 keys are.
HOT_SHARE = 0.001


def hot_join(
    left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame, spread: list[str], how: str = "inner",
    merge: bool = False, share: float = HOT_SHARE,
) -> DataFrame:
    """Join ``left`` with ``right``, splitting the keys that many rows of ``left`` share.

    ``sizes``: a stored table of the keys and ``n``, the rows of ``left`` with each. Keys above
    ``share`` of all rows (1 / share at most, so that list is broadcast) are dealt over as many
    salts as they exceed it, by a hash of the columns ``spread``; ``right`` repeats their rows for
    each salt. Null keys match nothing. ``right`` is broadcast only where Spark finds it small;
    with ``merge`` never, for sides that are about as many as ``left``. ``how``: inner or left.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    fair = max(1.0, total * share)
    hot = sizes.filter(F.col("n") > fair).select(*keys, F.ceil(F.col("n") / fair).cast("int").alias("_salts"))
    known = F.coalesce("_salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), known.cast("long")).cast("int"))
    copies = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), known - 1))).drop("_salts")
    return dealt.drop("_salts").join(copies.hint("merge") if merge else copies, [*keys, "_salt"], how).drop("_salt")
