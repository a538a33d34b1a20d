"""Counters over the transaction stream, as batch operators: totals per hour and day, top lists
with their empty hours, rate, and the newest transactions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stockloom.functions.dates import period_key
from stockloom.session import cut_lineage

_STEP = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def _now(items: DataFrame, as_of: datetime | None) -> Column:
    if as_of is not None:
        return F.lit(as_of)
    return items.agg(F.max("timestamp").alias("now")).scalar()


def product_totals(items: DataFrame, period: str) -> DataFrame:
    """Units per hour or day and product."""
    return items.groupBy(period_key(F.col("timestamp"), period).alias(period), "product_id").agg(
        F.sum("quantity").alias("units")
    )


def top_per_period(totals: DataFrame, period: str, top_n: int = 10) -> DataFrame:
    """The products sold most in each hour or day. Each task keeps its own top before the shuffle."""
    order = W.partitionBy(period).orderBy(F.desc("units"), "product_id")
    return totals.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top_n)


def last_periods(items: DataFrame, period: str, count: int, as_of: datetime | None = None) -> DataFrame:
    """The keys of the last ``count`` hours or days up to ``as_of``."""
    now = _now(items, as_of)
    spark = items.sparkSession
    back = F.expr(_STEP[period]) * F.col("id").cast("int")
    return spark.range(count).select(period_key(now - back, period).alias(period))


def since(items: DataFrame, period: str, count: int, as_of: datetime | None = None) -> DataFrame:
    """Rows of the last ``count`` hours or days and of up to one period before them, which may have
    begun earlier. The bound is on the timestamp itself, so that it reaches the scan; keys of
    periods sort out the rest."""
    return items.filter(F.col("timestamp") >= _now(items, as_of) - F.expr(_STEP[period]) * F.lit(count + 1))


def retained(totals: DataFrame, items: DataFrame, period: str, count: int, as_of: datetime | None = None) -> DataFrame:
    """Totals without the periods older than ``count`` hours or days before ``as_of``."""
    oldest = period_key(_now(items, as_of) - F.expr(_STEP[period]) * F.lit(count), period)
    return totals.filter(F.col(period) >= oldest)


def top_per_period_filled(
    items: DataFrame, period: str, count: int, top_n: int = 10, as_of: datetime | None = None
) -> DataFrame:
    """Top lists of the last hours or days; one without a sale stays as a row without a product."""
    keys = last_periods(items, period, count, as_of)
    wanted = product_totals(since(items, period, count, as_of), period).join(F.broadcast(keys), period, "left_semi")
    return keys.join(top_per_period(wanted, period, top_n), period, "left")


def transaction_rate(transactions: DataFrame, minutes: int = 5, as_of: datetime | None = None) -> DataFrame:
    """One row: transactions per minute over the last ``minutes``."""
    start = _now(transactions, as_of) - F.make_dt_interval(mins=F.lit(minutes))
    recent = transactions.filter(F.col("timestamp") >= start)
    return recent.agg((F.count(F.lit(1)) / minutes).alias("per_minute"))


def recent(transactions: DataFrame, n: int = 100) -> DataFrame:
    return transactions.orderBy(F.desc("timestamp"), F.desc("transaction_id")).limit(n)


def hourly_series(
    items: DataFrame, hours: int = 12, per_hour: int | None = 10, top_n: int = 5, as_of: datetime | None = None
) -> DataFrame:
    """Units per hour of the products that lead over the last hours: hour, position, product, units.

    Leaders are summed from each hour's own top list, as the live chart does; ``per_hour=None``
    sums all sales instead. Only hours in which a leader sold appear.
    """
    keys = last_periods(items, "hour", hours, as_of)
    totals = product_totals(since(items, "hour", hours, as_of), "hour").join(F.broadcast(keys), "hour", "left_semi")
    if per_hour is not None:
        totals = top_per_period(totals, "hour", per_hour).drop("position")
    totals = cut_lineage(totals)  # read twice
    leaders = (
        totals.groupBy("product_id").agg(F.sum("units").alias("all_units"))
        .orderBy(F.desc("all_units"), "product_id").limit(top_n)
        .withColumn("leader", F.row_number().over(W.orderBy(F.desc("all_units"), "product_id")))
    )
    return totals.join(F.broadcast(leaders), "product_id").select("hour", "leader", "product_id", "units")


def hourly_top_products(series: DataFrame, top_n: int = 5) -> DataFrame:
    """The hourly series as one column per leader, missing hours 0."""
    positions = list(range(1, top_n + 1))
    wide = series.groupBy("hour").pivot("leader", positions).agg(F.sum("units"))
    return wide.select("hour", *[F.coalesce(F.col(str(p)), F.lit(0)).alias(f"top_{p}") for p in positions])
