"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockloom.functions.skew import hot_join
from stockloom.session import run_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL where SQL can express it."""

    def register(plan: Query) -> Query:
        QUERIES[name] = plan
        if sql is not None:
            TWINS[name] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, and a known size."""
    spark = df.sparkSession
    path = run_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words of a line as the number of single spaces plus one; none in an empty line."""
    return F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], rows: str, spread: list[str], how: str, merge: bool = False
) -> DataFrame:
    """``hot_join`` with a stored table of one row per key that tells, in ``rows``, how many rows of ``left`` have that key."""
    return hot_join(left, right.drop(rows), keys, right.select(*keys, F.col(rows).alias("n")), spread, how, merge)


def fresh(df: DataFrame, names: list[str]) -> dict[str, str]:
    """A column name that ``df`` doesn't use for each of ``names``."""
    used, out = {c.lower() for c in df.columns}, {}
    for name in names:
        new = name
        while new.lower() in used:
            new = f"_{new}"
        out[name] = new
        used.add(new.lower())
    return out
