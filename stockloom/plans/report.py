"""Report and dashboard datasets put together from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.functions.clean import category_or_default, name_or_default, require_columns
from stockloom.functions.dates import period_key
from stockloom.operators import sales, sketches, ticker
from stockloom.session import cut_lineage
from stockloom.sources.tables import Retail

MISSING = "N/A"
URGENT_DAYS = 3
URGENT_SCORE = 0.6


def _text(value: Column, places: int) -> Column:
    return F.coalesce(F.format_number(value, places), F.lit(MISSING))


def inventory_report(low_stock: DataFrame, spoilt: DataFrame, products: DataFrame) -> DataFrame:
    """Rows of the stock report: a section of products about to run out, one of spoilt ones.

    Numbers are text as printed, with N/A where there is none. ``urgent`` marks a stock-out
    within three days or an anomaly score above 0.6.
    """
    require_columns(low_stock, ["product_id", "current_inventory", "avg_daily_sales", "days_until_stockout", "stockout_date"], "low stock")
    require_columns(spoilt, ["product_id", "anomaly_score", "current_inventory", "days_since_last_transaction"], "spoilt items")
    info = products.select("product_id", "name", "category")
    none = F.lit(MISSING)
    running_out = (
        low_stock.select("product_id", "current_inventory", "avg_daily_sales", "days_until_stockout", "stockout_date")
        .join(info, "product_id", "left")
        .select(
            F.lit("low stock").alias("section"), "product_id",
            name_or_default(F.col("name"), F.col("product_id")).alias("name"),
            category_or_default(F.col("category")).alias("category"),
            _text(F.col("current_inventory"), 0).alias("inventory"),
            _text(F.col("avg_daily_sales"), 1).alias("avg_sales"),
            _text(F.col("days_until_stockout"), 0).alias("days_out"),
            F.coalesce(F.date_format("stockout_date", "yyyy-MM-dd"), none).alias("date_out"),
            none.alias("days_since_sale"), none.alias("anomaly_score"),
            (F.col("days_until_stockout") <= URGENT_DAYS).alias("urgent"),
        )
    )
    days = F.when(F.col("days_since_last_transaction") != -1, F.col("days_since_last_transaction"))
    spoiling = (
        spoilt.select("product_id", "anomaly_score", "current_inventory", "days_since_last_transaction")
        .join(info, "product_id", "left")
        .select(
            F.lit("spoilt").alias("section"), "product_id",
            name_or_default(F.col("name"), F.col("product_id")).alias("name"),
            category_or_default(F.col("category")).alias("category"),
            _text(F.col("current_inventory"), 0).alias("inventory"),
            none.alias("avg_sales"), none.alias("days_out"), none.alias("date_out"),
            _text(days, 0).alias("days_since_sale"),
            _text(F.col("anomaly_score"), 4).alias("anomaly_score"),
            (F.col("anomaly_score") > URGENT_SCORE).alias("urgent"),
        )
    )
    return running_out.unionByName(spoiling)


@dataclass(frozen=True)
class Dashboard:
    kpis: DataFrame
    daily: DataFrame
    top_products: DataFrame
    top_categories: DataFrame


def sales_sets(retail: Retail) -> DataFrame:
    """Units by (period, category), by (product_id, product_name) and by category, one below the other, told
    apart by ``dataset``. Lines are read once: they are summed per day and product before names are
    joined, and the three groupings share those sums."""
    days = retail.transactions.select("transaction_id", period_key(F.col("transaction_date"), "day").alias("period"))
    names = retail.products.select("product_id", F.col("name").alias("product_name"), "category")
    daily = retail.items.join(days, "transaction_id", "left").groupBy("period", "product_id").agg(F.sum("quantity").alias("units"))
    keys = ["period", "category", "product_id", "product_name"]
    sets = [["period", "category"], ["product_id", "product_name"], ["category"]]
    held = daily.join(names, "product_id")
    found = held.groupingSets([[F.col(c) for c in some] for some in sets], *keys).agg(F.sum("units").alias("units"), F.grouping_id().alias("set"))
    number = [sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in some) for some in sets]
    dataset = F.when(F.col("set") == number[0], "day").when(F.col("set") == number[1], "product").otherwise("category")
    return found.withColumn("dataset", dataset).drop("set").filter("dataset <> 'day' or period is not null")


def dashboard(retail: Retail, last_days: int | None = None) -> Dashboard:
    """The four datasets of the start page. All but the numbers of the stock come from one scan of the lines;
    ``last_days`` cuts the daily one by the time of sale, which takes a scan of its own."""
    sets = cut_lineage(sales_sets(retail))
    of = lambda name, *columns: sets.filter(F.col("dataset") == name).select(*columns, "units")
    daily = of("day", "period", "category") if last_days is None else sales.sales_by_period(retail.sales(), "day", last_days=last_days)
    return Dashboard(
        sales.dashboard_kpis(retail), daily,
        of("product", "product_id", "product_name").orderBy(F.desc("units"), "product_id").limit(10),
        of("category", "category").orderBy(F.desc("units"), "category").limit(5),
    )


@dataclass(frozen=True)
class StreamPanel:
    products: DataFrame
    categories: DataFrame
    hourly: DataFrame


def stream_panel(items: DataFrame, top_n: int = 10, hours: int = 12, algorithm: str = "space_saving") -> StreamPanel:
    """The three datasets of the live page: the first ``top_n`` products, all categories, and the last hours."""
    return StreamPanel(
        sketches.frequent_products(items, top_n, algorithm),
        sketches.category_totals(items),
        ticker.hourly_series(items, hours),
    )
