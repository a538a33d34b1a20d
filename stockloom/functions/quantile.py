"""Exact quantiles without gathering a column in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def exact_quantile(df: DataFrame, column: str, q: float, bins: int = 4096, small: int = 20_000) -> float:
    """The ``q`` quantile with linear interpolation between neighbours.

    Each pass counts values per bin of an ever smaller range, and at most ``small`` values of the
    last range come to the driver. Nulls and NaN are left out. Cache ``df`` if it is costly to compute.
    """
    df = df.filter(~F.isnan(F.col(column).cast("double")))
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0:
        raise ValueError("quantile of no values")
    position = q * (n - 1)
    first = int(position)
    lower = _nth(df, column, first, low, high, bins, small)
    if position == first:
        return lower
    upper = _nth(df, column, first + 1, low, high, bins, small)
    return lower + (upper - lower) * (position - first)


def _nth(df: DataFrame, column: str, nth: int, low: float, high: float, bins: int, small: int) -> float:
    """The ``nth`` smallest value, from 0."""
    value = F.col(column)
    below = 0
    while low < high:
        inside = df.filter((value >= low) & (value <= high))
        width = (high - low) / bins
        fine = width > 0 and low + width > low
        # A range too narrow to divide holds few different values: count them one by one.
        slot = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("double") if fine else value
        counts = (
            inside.groupBy(slot.alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
            .orderBy("slot").collect()
        )
        for row in counts:
            if nth < below + row["n"]:
                low, high, rows = row["lo"], row["hi"], row["n"]
                break
            below += row["n"]
        if low < high and rows <= small:
            last = df.filter((value >= low) & (value <= high)).orderBy(value).select(value.alias("v"))
            return last.collect()[nth - below]["v"]
    return low
