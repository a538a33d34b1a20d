"""Sales aggregates.

Facts are summed on the product key before any name is joined: partial sums absorb hot products
and the join sees one row per product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.functions import dates
from stockloom.sources.tables import Retail


def units_by_product(retail: Retail) -> DataFrame:
    sold = retail.items.groupBy("product_id").agg(F.sum("quantity").alias("units"))
    names = retail.products.select("product_id", F.col("name").alias("product_name"), "category")
    return sold.join(names, "product_id")


def top_products(retail: Retail, n: int = 10) -> DataFrame:
    """The ``n`` products with most units sold, ties to the smaller id."""
    return (
        units_by_product(retail)
        .select("product_id", "product_name", "units")
        .orderBy(F.desc("units"), "product_id")
        .limit(n)
    )


def top_categories(retail: Retail, n: int = 5) -> DataFrame:
    return (
        units_by_product(retail)
        .groupBy("category")
        .agg(F.sum("units").alias("units"))
        .orderBy(F.desc("units"), "category")
        .limit(n)
    )


def dashboard_kpis(retail: Retail, low_stock_below: int = 20) -> DataFrame:
    """One row: products, units in stock, transactions, items low on stock."""
    spark = retail.products.sparkSession
    stock = retail.inventory.agg(
        F.sum("quantity").alias("units"),
        F.count_if(F.col("quantity") < low_stock_below).alias("low"),
    )
    return spark.range(1).select(
        retail.products.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_products"),
        stock.select("units").scalar().alias("units_in_stock"),
        retail.transactions.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_transactions"),
        stock.select("low").scalar().alias("low_stock_items"),
    )


def low_stock_simple(inventory: DataFrame, below: int = 20) -> DataFrame:
    return inventory.filter(F.col("quantity") < below)


def sales_by_period(
    sales: DataFrame, period: str, categories: list[str] | None = None, last_days: int | None = None
) -> DataFrame:
    """Units per period key and category, optionally for some categories or the last days only."""
    if categories is not None:
        sales = sales.filter(F.col("category").isin(categories))
    if last_days is not None:
        newest = sales.agg(F.max("transaction_date").alias("newest")).scalar()
        sales = sales.filter(F.col("transaction_date") >= newest - F.make_dt_interval(F.lit(last_days)))
    return sales.groupBy(
        dates.period_key(F.col("transaction_date"), period).alias("period"), "category"
    ).agg(F.sum("quantity").alias("units"))


def sales_pivot(by_period: DataFrame, categories: list[str]) -> DataFrame:
    """Period rows by category columns, missing cells 0, columns in sorted order."""
    wanted = sorted(categories)
    wide = by_period.groupBy("period").pivot("category", wanted).agg(F.sum("units"))
    return wide.na.fill(0, wanted)


def sales_by_daypart(items: DataFrame, ts: str = "timestamp") -> DataFrame:
    return items.groupBy(dates.daypart(F.col(ts)).alias("daypart"), "category").agg(
        F.sum("quantity").alias("units")
    )


def demand_index(items: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Units per product as sold, and adjusted for how busy the moments of sale usually are."""
    factor = dates.demand_factor(F.col(ts))
    return items.groupBy("product_id").agg(
        F.sum("quantity").alias("units"),
        F.avg(factor).alias("mean_index"),
        F.sum(F.col("quantity") / factor).alias("adjusted_units"),
    )


def daily_sales(sales: DataFrame) -> DataFrame:
    """Units per product and day, days with a sale only."""
    return sales.groupBy("product_id", F.to_date("transaction_date").alias("day")).agg(
        F.sum("quantity").alias("units")
    )


def spread_of_daily(sales: DataFrame, value: Column, name: str) -> DataFrame:
    """Sample deviation over days of a product's daily ``value``; 0 with a single day."""
    daily = sales.groupBy("product_id", F.to_date("transaction_date").alias("day")).agg(
        value.alias("value")
    )
    return daily.groupBy("product_id").agg(
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias(name)
    )


def sales_consistency(sales: DataFrame) -> DataFrame:
    return spread_of_daily(sales, F.sum("quantity"), "sales_consistency")


def price_variability(sales: DataFrame) -> DataFrame:
    return spread_of_daily(
        sales.filter(F.col("price_per_unit").isNotNull()), F.avg("price_per_unit"), "price_changes"
    )


def latest_row(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` per key, by a max that combines before the shuffle."""
    rest = [c for c in df.columns if c not in (key, order)]
    newest = F.max(F.struct(order, *rest)).alias("newest")
    return df.groupBy(key).agg(newest).select(key, "newest.*")


def first_row(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key in the stated order."""
    rest = [c for c in df.columns if c != key and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return df.groupBy(key).agg(first).select(key, "first.*")
