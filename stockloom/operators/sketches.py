"""Heavy hitters: Count-Min and Space-Saving summaries, and exact counts."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# The small hash family works modulo this fixed value.
HASH_RANGE = 1_000_000


def hash_parameters(depth: int = 5, seed: int = 42) -> list[tuple[int, int]]:
    """(a, b) of each row's hash, drawn from a generator of its own."""
    draw = random.Random(seed)
    return [(draw.randint(1, HASH_RANGE), draw.randint(0, HASH_RANGE)) for _ in range(depth)]


def buckets(item: Column, width: int, depth: int, seed: int, hashing: str) -> list[Column]:
    """The bucket of an item in each row.

    ``mixed`` hashes items of any type by 64 bits, anew for each row. ``modular`` is (a x + b)
    modulo HASH_RANGE modulo the width, for whole numbers; ids that are equal modulo HASH_RANGE
    share all buckets, so it suits small ids only.
    """
    if hashing == "modular":
        x = F.pmod(item.cast("long"), F.lit(HASH_RANGE).cast("long"))
        whole = [F.pmod(F.lit(a).cast("long") * x + F.lit(b).cast("long"), F.lit(HASH_RANGE).cast("long")) for a, b in hash_parameters(depth, seed)]
    elif hashing == "mixed":
        whole = [F.xxhash64(item, F.lit(seed), F.lit(row)) for row in range(depth)]
    else:
        raise ValueError(f"unknown hashing {hashing}")
    return [F.pmod(h, F.lit(width).cast("long")) for h in whole]


def _cells(item: str, width: int, depth: int, seed: int, hashing: str) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(row).alias("row"), bucket.alias("bucket"))
        for row, bucket in enumerate(buckets(F.col(item), width, depth, seed, hashing))
    ]))


def cells(df: DataFrame, item: str, weight: str, width: int, depth: int, seed: int, hashing: str = "mixed") -> DataFrame:
    """The cells (row, bucket) that each row adds its weight ``w`` to."""
    return df.select(F.col(weight).alias("w"), _cells(item, width, depth, seed, hashing).alias("cell"))


def count_min(
    df: DataFrame, item: str = "product_id", weight: str = "quantity",
    width: int = 1000, depth: int = 5, seed: int = 42, hashing: str = "mixed",
) -> DataFrame:
    """The sketch as (row, bucket, total). Never more than width * depth rows, combined before
    the shuffle. Sketches of parts add up: union them and sum again."""
    hits = cells(df, item, weight, width, depth, seed, hashing)
    return hits.groupBy("cell.row", "cell.bucket").agg(F.sum("w").alias("total"))


def merge_count_min(*sketches: DataFrame) -> DataFrame:
    whole = sketches[0]
    for sketch in sketches[1:]:
        whole = whole.unionByName(sketch)
    return whole.groupBy("row", "bucket").agg(F.sum("total").alias("total"))


def count_min_estimate(
    items: DataFrame, sketch: DataFrame, item: str = "product_id", width: int = 1000, depth: int = 5, seed: int = 42,
    hashing: str = "mixed",
) -> DataFrame:
    """Estimated weight of each distinct item; never below the true one, 0 if never hit.

    The sketch has at most width * depth rows, so it is sent to all tasks.
    """
    distinct = items.select(item).distinct()
    probes = distinct.select(item, _cells(item, width, depth, seed, hashing).alias("cell")).select(
        item, "cell.row", "cell.bucket"
    )
    small = F.broadcast(sketch) if width * depth <= 1_000_000 else sketch
    return (
        probes.join(small, ["row", "bucket"], "left")
        .groupBy(item).agg(F.min(F.coalesce("total", F.lit(0))).alias("estimate"))
    )


def count_min_heavy_hitters(
    items: DataFrame, sketch: DataFrame, threshold: int = 0, top_n: int | None = None,
    item: str = "product_id", width: int = 1000, depth: int = 5, seed: int = 42, hashing: str = "mixed",
) -> DataFrame:
    """Items (not bucket numbers) whose estimate lies above the threshold, greatest first."""
    found = count_min_estimate(items, sketch, item, width, depth, seed, hashing).filter(F.col("estimate") > threshold)
    found = found.orderBy(F.desc("estimate"), item)
    return found if top_n is None else found.limit(top_n)


def merge_summaries(parts: pd.DataFrame, k: int) -> pd.DataFrame:
    """Merge Space-Saving summaries and keep k counters.

    ``part`` tells summaries apart. A summary's ``floor`` is the most that an item it does not
    hold may have had. Count and error of an item therefore grow by the floor of every summary
    that lacks it. What is dropped raises the floor of the result. A missing item is an item like
    any other.
    """
    floors = parts.groupby("part")["floor"].first()
    base = floors.sum()
    own_floor = parts["part"].map(floors)
    held = parts.assign(gain=parts["count"] - own_floor, slack=parts["error"] - own_floor)
    total = held.groupby("item", as_index=False, dropna=False)[["gain", "slack"]].sum()
    total = total.sort_values(["gain", "item"], ascending=[False, True], kind="stable", na_position="first")
    dropped = total["gain"].iloc[k] if len(total) > k else 0
    kept = total.head(k)
    return pd.DataFrame({"item": kept["item"], "count": kept["gain"] + base, "error": kept["slack"] + base, "floor": base + dropped})


def _summary_schema(weight: str) -> str:
    return f"item string, count {weight}, error {weight}, floor {weight}"


def _merge_all(parts: DataFrame, k: int, weight: str, group: Column, numbered: bool) -> DataFrame:
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        merged = merge_summaries(rows, k)
        return merged.assign(part=int(rows["part"].iloc[0])) if numbered else merged

    schema = _summary_schema(weight) + (", part long" if numbered else "")
    return parts.groupBy(group.alias("g")).applyInPandas(merge, schema)


def space_saving(
    df: DataFrame, k: int = 100, item: str = "product_id", weight: str = "quantity", fan_in: int = 256
) -> DataFrame:
    """Weighted Space-Saving summary: item, count, error, floor; at most k rows.

    True weight lies between count - error and count; error and floor are at most total / k.
    Items of any simple type, null among them, come back as they are; whole weights stay whole,
    others are doubles, and missing weights count nothing. Each task folds its rows to one summary
    of k counters, then summaries merge ``fan_in`` at a time, so no step sees more than fan_in * k rows.
    """
    kinds = dict(df.dtypes)
    number = "long" if kinds[weight] in ("tinyint", "smallint", "int", "bigint") else "double"
    known = F.coalesce(F.col(weight).cast(number), F.lit(0).cast(number))
    # text stands for any type and keeps it: pandas would turn whole numbers next to a null into floats
    rows = df.select(F.col(item).cast("string").alias("item"), known.alias("weight"))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        summary = None
        for batch in batches:
            exact = batch.groupby("item", as_index=False, dropna=False)["weight"].sum()
            fresh = pd.DataFrame({"item": exact["item"], "count": exact["weight"], "error": 0, "floor": 0, "part": 1})
            both = fresh if summary is None else pd.concat([summary.assign(part=0), fresh])
            if not both.empty:
                summary = merge_summaries(both, k)
        if summary is not None:
            yield summary.astype({"item": object}).assign(part=TaskContext.get().partitionId())

    parts = rows.mapInPandas(summarise, _summary_schema(number) + ", part long")
    # Three levels take in fan_in ** 3 tasks.
    for level in (1, 2):
        parts = _merge_all(parts, k, number, F.floor(F.col("part") / fan_in**level), True)
    merged = _merge_all(parts, k, number, F.lit(0), False)
    return merged.withColumn("item", F.col("item").cast(kinds[item]))


def merge_space_saving(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Two summaries (at most k rows each) as one."""
    kinds = dict(a.dtypes)
    both = a.withColumn("part", F.lit(0).cast("long")).unionByName(b.withColumn("part", F.lit(1).cast("long")))
    merged = _merge_all(both.withColumn("item", F.col("item").cast("string")), k, {"bigint": "long"}.get(kinds["count"], "double"), F.lit(0), False)
    return merged.withColumn("item", F.col("item").cast(kinds["item"]))


def frequent_products(
    lines: DataFrame, top_n: int = 10, algorithm: str = "space_saving", k: int = 100,
    width: int = 1000, depth: int = 5, hashing: str = "mixed",
) -> DataFrame:
    """The products sold most, by ``space_saving``, ``count_min_sketch`` or exact counts."""
    if algorithm == "space_saving":
        found = space_saving(lines, k).select(F.col("item").alias("product_id"), "count", "error")
    elif algorithm == "count_min_sketch":
        sketch = count_min(lines, width=width, depth=depth, hashing=hashing)
        found = count_min_heavy_hitters(lines, sketch, width=width, depth=depth, hashing=hashing).select(
            "product_id", F.col("estimate").alias("count"), F.lit(None).cast("long").alias("error")
        )
    else:
        found = product_counts(lines).select(
            "product_id", F.col("units").alias("count"), F.lit(0).cast("long").alias("error")
        )
    return found.orderBy(F.desc("count"), "product_id").limit(top_n)


def product_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("product_id").agg(F.sum("quantity").alias("units"))


def category_totals(lines: DataFrame, top_n: int | None = None) -> DataFrame:
    totals = lines.groupBy("category").agg(F.sum("quantity").alias("units")).orderBy(F.desc("units"), "category")
    return totals if top_n is None else totals.limit(top_n)
