"""Stock ledger and stock-out alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from stockloom.functions.clean import require_columns, valid_timestamps, whole_number_or_zero


def stock_after_sales(inventory: DataFrame, batch: DataFrame, floor: int = 10) -> DataFrame:
    """The stock snapshot after a batch of sales; nothing falls below ``floor``."""
    sold = batch.groupBy("product_id").agg(F.sum("quantity").alias("sold"))
    left = F.col("quantity") - F.coalesce("sold", F.lit(0))
    return (
        inventory.join(sold, "product_id", "left")
        .withColumn("quantity", F.greatest(left, F.lit(floor)))
        .drop("sold")
    )


def one_stock_row(inventory: DataFrame) -> DataFrame:
    """One quantity per product: the one with the lowest inventory id where there is one."""
    inventory = whole_number_or_zero(inventory, "quantity")
    if "inventory_id" not in inventory.columns:
        return inventory.groupBy("product_id").agg(F.min("quantity").alias("quantity"))
    return inventory.groupBy("product_id").agg(F.min_by("quantity", "inventory_id").alias("quantity"))


def daily_forecast(predictions: DataFrame) -> DataFrame:
    """Predictions summed per product and day, on every forecast day (0 where a day is missing)."""
    require_columns(predictions, {"product_id", "date", "predicted_sales"}, "predictions")
    clean = valid_timestamps(predictions, "date").withColumn("date", F.to_date("date"))
    per_day = clean.groupBy("product_id", "date").agg(
        F.sum(F.coalesce("predicted_sales", F.lit(0.0))).alias("demand")
    )
    # The horizon is a handful of days.
    horizon = clean.agg(F.array_sort(F.collect_set("date")).alias("days")).scalar()
    grid = per_day.select("product_id").distinct().select("product_id", F.explode(horizon).alias("date"))
    return grid.join(per_day, ["product_id", "date"], "left").na.fill(0.0, ["demand"])


def cumulative_demand(predictions: DataFrame) -> DataFrame:
    """Running demand per product with the number of the day in the horizon."""
    by_day = W.partitionBy("product_id").orderBy("date")
    return daily_forecast(predictions).select(
        "product_id", "date", "demand",
        F.row_number().over(by_day).alias("day_number"),
        F.sum("demand").over(by_day.rowsBetween(W.unboundedPreceding, 0)).alias("cumulative"),
    )


def stockout_day(inventory: DataFrame, predictions: DataFrame) -> DataFrame:
    """First forecast day on which the running demand passes the stock; others are left out.

    ``avg_daily_sales`` is the mean demand of a day, ``avg_cumulative_sales`` the mean of the
    running totals.
    """
    require_columns(inventory, {"product_id", "quantity"}, "inventory")
    out = F.col("quantity") < F.col("cumulative")
    return (
        cumulative_demand(predictions)
        .join(one_stock_row(inventory), "product_id")
        .groupBy("product_id", F.col("quantity").alias("current_inventory"))
        .agg(
            F.avg("demand").alias("avg_daily_sales"),
            F.avg("cumulative").alias("avg_cumulative_sales"),
            F.min(F.when(out, F.col("day_number"))).alias("days_until_stockout"),
            F.min(F.when(out, F.col("date"))).alias("stockout_date"),
        )
        .filter(F.col("days_until_stockout").isNotNull())
    )


def low_stock(inventory: DataFrame, predictions: DataFrame, threshold_days: int = 3) -> DataFrame:
    """Products that run out within ``threshold_days``, soonest first."""
    return (
        stockout_day(inventory, predictions)
        .filter(F.col("days_until_stockout") <= threshold_days)
        .orderBy("days_until_stockout", "product_id")
    )


def mean_demand_forecast(sales: DataFrame, days: int = 7, start: datetime | None = None) -> DataFrame:
    """A plain forecast: each product's mean units per day of the whole span, for the next days."""
    span = sales.agg(
        F.to_date(F.min("transaction_date")).alias("first"), F.to_date(F.max("transaction_date")).alias("last")
    )
    first, last = span.select("first").scalar(), span.select("last").scalar()
    begin = F.lit(start).cast("date") if start is not None else last
    total = sales.groupBy("product_id").agg(F.sum("quantity").alias("units"))
    return total.select(
        "product_id",
        F.explode(F.sequence(F.date_add(begin, 1), F.date_add(begin, days))).alias("date"),
        (F.col("units") / (F.date_diff(last, first) + 1)).alias("predicted_sales"),
    )
