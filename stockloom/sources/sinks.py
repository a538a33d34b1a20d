"""Writing results: CSV, parquet, nested JSON, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockloom.operators.graph import Graph, with_product_info
from stockloom.sources.tables import Retail


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write a folder of part files. CSV gets a header in every part."""
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def export_tables(retail: Retail, folder: str, format: str = "csv") -> dict[str, str]:
    """Products, stock, transactions and lines with the names a reader wants beside the ids."""
    names = retail.products.select("product_id", F.col("name").alias("product_name"), "category")
    people = retail.customers.select("customer_id", F.col("name").alias("customer_name"))
    tables = {
        "products": retail.products,
        "inventory": retail.inventory.join(names, "product_id"),
        "transactions": retail.transactions.join(people, "customer_id"),
        "transaction_items": retail.items.join(names, "product_id"),
    }
    return {name: write_table(df, f"{folder}/{name}", format) for name, df in tables.items()}


def write_nested_json(transactions: DataFrame, path: str) -> str:
    """Nested transactions as JSON lines with ISO times."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    writer = transactions.write.mode("overwrite").option("timestampFormat", iso).option("timestampNTZFormat", iso)
    writer.json(path)
    return path


def export_graph(graph: Graph, products: DataFrame, folder: str, format: str = "parquet") -> dict[str, str]:
    """Nodes with name and category, and weighted edges."""
    return {
        "nodes": write_table(with_product_info(graph.nodes, products), f"{folder}/nodes", format),
        "edges": write_table(graph.edges, f"{folder}/edges", format),
    }
