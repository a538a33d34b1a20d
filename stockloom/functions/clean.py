"""Cleaning rules: what becomes of values that do not parse."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, needed: Iterable[str], what: str) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} misses columns: {', '.join(missing)}")


def _is_string(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def valid_timestamps(df: DataFrame, name: str) -> DataFrame:
    """Parse ``name`` where it is text and drop the rows that hold no valid time."""
    if _is_string(df, name):
        df = df.withColumn(name, F.try_to_timestamp(F.col(name)))
    return df.filter(F.col(name).isNotNull())


def whole_number_or_zero(df: DataFrame, name: str) -> DataFrame:
    """Parse as a number, cut to a whole one; what does not parse counts as 0 (model features)."""
    number = F.col(name).try_cast("double") if _is_string(df, name) else F.col(name)
    return df.withColumn(name, F.coalesce(number.cast("long"), F.lit(0).cast("long")))


def numbers_or_dropped(df: DataFrame, names: list[str]) -> DataFrame:
    """Parse as numbers; rows where one does not parse are dropped (customer scores)."""
    for name in names:
        if _is_string(df, name):
            df = df.withColumn(name, F.col(name).try_cast("double"))
    return df.na.drop(subset=names)


def name_or_default(name: Column, product_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("Product "), product_id.cast("string")))


def category_or_default(category: Column) -> Column:
    return F.coalesce(category, F.lit("Unknown"))


def ordered_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns in this order; a missing one is null."""
    return df.select([F.col(n) if n in df.columns else F.lit(None).alias(n) for n in names])
