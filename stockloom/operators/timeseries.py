"""Daily demand series on a dense grid, and the features of the demand model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from stockloom.functions.clean import (
    category_or_default, require_columns, valid_timestamps, whole_number_or_zero,
)
from stockloom.functions.dates import calendar_parts
from stockloom.operators.joins import one_hot
from stockloom.operators.sales import daily_sales
from stockloom.operators.stock import one_stock_row
from stockloom.session import cut_lineage

LAGS = (1, 2, 3, 7)
ROLLING = (3, 7, 14)
BASE_FEATURES = ["day_of_week", "day_of_month", "month", "current_inventory"]


def product_day_grid(daily: DataFrame) -> DataFrame:
    """Every product of the daily sales on every day between the first and the last of all.

    Each product row unfolds the day range by itself, so nothing is crossed.
    """
    span = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = F.sequence(span.select("first").scalar(), span.select("last").scalar())
    return daily.select("product_id").distinct().select("product_id", F.explode(days).alias("day"))


def observed_days(sales: DataFrame) -> DataFrame:
    """Units per product and day with a sale, cleaned and stored: much smaller than the sales,
    which are then read once."""
    require_columns(sales, {"transaction_date", "product_id", "quantity"}, "sales")
    sales = whole_number_or_zero(valid_timestamps(sales, "transaction_date"), "quantity")
    return cut_lineage(daily_sales(sales))


def dense_daily(sales: DataFrame) -> DataFrame:
    """Units per product and day on the dense grid, 0 where nothing was sold.

    Zero rows are appended and summed away instead of joined. The rows are laid out by product,
    each with the same number of days; that one shuffle also serves the windows that follow.
    """
    daily = observed_days(sales)
    zeros = product_day_grid(daily).withColumn("units", F.lit(0).cast("long"))
    return (
        daily.unionByName(zeros).repartition("product_id")
        .groupBy("product_id", "day").agg(F.sum("units").alias("quantity"))
    )


def with_lags(daily: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    by_day = W.partitionBy("product_id").orderBy("day")
    return daily.withColumns({
        f"lag_{n}": F.coalesce(F.lag("quantity", n).over(by_day), F.lit(0).cast("long")) for n in lags
    })


def with_rolling_means(daily: DataFrame, sizes: tuple[int, ...] = ROLLING) -> DataFrame:
    """Mean of the last n days, today included; fewer at the start."""
    by_day = W.partitionBy("product_id").orderBy("day")
    return daily.withColumns({
        f"rolling_mean_{n}": F.avg("quantity").over(by_day.rowsBetween(1 - n, 0)) for n in sizes
    })


def with_next_day(daily: DataFrame) -> DataFrame:
    """Next day's units as the target; the last day has none and goes."""
    by_day = W.partitionBy("product_id").orderBy("day")
    target = F.lead("quantity", 1).over(by_day)
    return daily.withColumn("next_day_sales", target).filter(F.col("next_day_sales").isNotNull())


def feature_names(categories: list[str]) -> list[str]:
    """Feature order: calendar, stock, lags, rolling means, categories."""
    return (
        BASE_FEATURES + [f"lag_{n}" for n in LAGS] + [f"rolling_mean_{n}" for n in ROLLING]
        + [f"category_{c}" for c in sorted(categories)]
    )


def forecast_features(
    sales: DataFrame, inventory: DataFrame, categories: list[str] | None = None, labelled: bool = True
) -> DataFrame:
    """Model rows: (product, day), features in ``feature_names`` order, and the next day's units.

    ``labelled=False`` keeps the last day too, with a null target.
    """
    require_columns(inventory, {"product_id", "quantity"}, "inventory")
    daily = with_rolling_means(with_lags(dense_daily(sales)))
    if labelled:
        daily = with_next_day(daily)
    else:
        by_day = W.partitionBy("product_id").orderBy("day")
        daily = daily.withColumn("next_day_sales", F.lead("quantity", 1).over(by_day))
    stock = one_stock_row(inventory).withColumnRenamed("quantity", "current_inventory")
    rows = (
        daily.withColumns(calendar_parts(F.col("day")))
        .join(stock, "product_id", "left")
        .na.fill(0, ["current_inventory"])
    )
    names = feature_names([])
    if "category" in sales.columns and categories is not None:
        kinds = sales.groupBy("product_id").agg(F.min("category").alias("category"))
        rows = rows.join(kinds, "product_id", "left").withColumn(
            "category", category_or_default(F.col("category"))
        )
        rows = one_hot(rows, "category", categories)
        names = feature_names(categories)
    return rows.select("product_id", "day", *names, "next_day_sales")


def chronological_split(rows: DataFrame, test_share: float = 0.2, day: str = "day") -> tuple[DataFrame, DataFrame]:
    """Train on the earlier days, test on the later ones.

    The cut is the last day whose rows, with all before, still fit in the training share; a day
    is never divided. Days are counted first, so the ordered pass sees one row per day.
    """
    cut = _cut_day(rows, test_share, day)
    return rows.filter(F.col(day) <= cut.scalar()), rows.filter(F.col(day) > cut.scalar())


def _cut_day(rows: DataFrame, test_share: float, day: str) -> DataFrame:
    per_day = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    in_order = W.orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    running = per_day.select(
        day, F.sum("n").over(in_order).alias("seen"), F.sum("n").over(everything).alias("total")
    )
    return running.filter(F.col("seen") <= F.floor(F.col("total") * (1 - test_share))).agg(F.max(day))
