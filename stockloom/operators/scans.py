"""Lookups and joined views of the retail tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from stockloom.functions.clean import category_or_default
from stockloom.sources.tables import Retail


def product(retail: Retail, product_id: int) -> DataFrame:
    """One product by key; empty when unknown. The filter reaches the scan."""
    return retail.products.filter(F.col("product_id") == product_id)


def inventory_view(retail: Retail) -> DataFrame:
    """Stock with product name, category and supplier."""
    names = retail.products.select(
        "product_id", F.col("name").alias("product_name"), "category", "supplier"
    )
    columns = ["inventory_id", "product_id", "product_name", "category", "supplier", "quantity"]
    if "last_updated" in retail.inventory.columns:
        columns.append("last_updated")
    return retail.inventory.join(names, "product_id").select(columns)


def recent_transactions(
    retail: Retail, as_of: datetime | None = None, days: int = 30, limit: int | None = None
) -> DataFrame:
    """Transactions of known customers in the last ``days`` before ``as_of``, newest first.

    ``as_of`` defaults to the newest transaction. Ties on time go to the larger id. All of them,
    unless a ``limit`` is asked for.
    """
    txns = retail.transactions
    if as_of is None:
        newest = txns.agg(F.max("transaction_date").alias("newest")).scalar()
    else:
        newest = F.lit(as_of)
    names = retail.customers.select("customer_id", F.col("name").alias("customer_name"))
    recent = (
        txns.filter(F.col("transaction_date") >= newest - F.make_dt_interval(F.lit(days)))
        .join(names, "customer_id")
        .select("transaction_id", "transaction_date", "customer_id", "customer_name")
        .orderBy(F.desc("transaction_date"), F.desc("transaction_id"))
    )
    return recent if limit is None else recent.limit(limit)


def transaction_items(
    retail: Retail, transaction_id: int | None = None, limit: int | None = None
) -> DataFrame:
    """Lines with product name and line total: those of one transaction, or a preview of all.

    The preview has a stated order, as a limit alone would pick any rows.
    """
    names = retail.products.select("product_id", F.col("name").alias("product_name"))
    lines = retail.items
    if transaction_id is not None:
        lines = lines.filter(F.col("transaction_id") == transaction_id)
    lines = lines.withColumn("total_price", F.col("quantity") * F.col("price_per_unit"))
    if transaction_id is None and limit is not None:
        known = lines.join(names.select("product_id"), "product_id", "left_semi")
        order = ["transaction_id", "product_id", "quantity", "price_per_unit"]
        lines = known.orderBy(*order).limit(limit)
    keep = [c for c in ("item_id",) if c in lines.columns]
    return lines.join(names, "product_id").select(
        *keep, "transaction_id", "product_id", "product_name", "quantity", "price_per_unit", "total_price"
    )


def baskets(items: DataFrame) -> DataFrame:
    """The sorted set of products of every transaction, one row each. Sets combine before the shuffle."""
    return items.groupBy("transaction_id").agg(F.sort_array(F.collect_set("product_id")).alias("items"))


def flat_items(transactions: DataFrame) -> DataFrame:
    """One row per nested item; a missing quantity counts 1, a missing category is Unknown."""
    return transactions.select(
        "transaction_id", "timestamp", "customer_id", F.explode("items").alias("item")
    ).select(
        "transaction_id", "timestamp", "customer_id", F.col("item.product_id").alias("product_id"),
        category_or_default(F.col("item.category")).alias("category"),
        F.coalesce(F.col("item.quantity"), F.lit(1).cast("long")).alias("quantity"),
        F.col("item.price").alias("price"),
    )


def nested_transactions(sales: DataFrame) -> DataFrame:
    """Sales folded to one row per transaction with its lines nested, its total and line count.

    ``promotion_applied`` is kept where present.
    """
    line = ["product_id", "product_name", "category", "quantity", "price", "total"]
    if "promotion_applied" in sales.columns:
        line.append("promotion_applied")
    lines = sales.withColumnsRenamed({"price_per_unit": "price", "transaction_date": "timestamp"})
    lines = lines.withColumn("total", F.col("quantity") * F.col("price"))
    return lines.groupBy("transaction_id", "customer_id", "timestamp").agg(
        F.sort_array(F.collect_list(F.struct(*line))).alias("items"),
        F.sum("total").alias("total"),
        F.count(F.lit(1)).alias("n_items"),
    )
