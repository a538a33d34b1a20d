"""Constraint checks: required values, unique keys, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stockloom.sources.tables import SCHEMAS, Retail

# Column, table it refers to.
REFERENCES = {
    "inventory": [("product_id", "products")],
    "transaction_items": [("transaction_id", "transactions"), ("product_id", "products")],
}
KEYS = {
    "products": "product_id", "inventory": "inventory_id", "transactions": "transaction_id",
    "transaction_items": "item_id", "customers": "customer_id",
}


def _tables(retail: Retail) -> dict[str, DataFrame]:
    return {
        "products": retail.products, "inventory": retail.inventory, "transactions": retail.transactions,
        "transaction_items": retail.items, "customers": retail.customers,
    }


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def null_violations(retail: Retail) -> DataFrame:
    """table, column, violations for each column that must not be null. One scan per table."""
    parts = []
    for name, df in _tables(retail).items():
        required = [f.name for f in SCHEMAS[name].fields if not f.nullable and f.name in df.columns]
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in required])
        parts.append(counts.select(F.lit(name).alias("table"), F.inline(pairs)))
    return _union(parts)


def pk_duplicates(retail: Retail) -> DataFrame:
    """table, duplicates: keys that occur more than once. Counts combine before the shuffle."""
    parts = []
    for name, df in _tables(retail).items():
        key = KEYS[name]
        if key not in df.columns:
            continue
        repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        parts.append(repeated.agg(F.count(F.lit(1)).alias("duplicates")).select(F.lit(name).alias("table"), "duplicates"))
    return _union(parts)


def fk_orphans(retail: Retail) -> DataFrame:
    """table, column, orphans: rows that refer to a key that does not exist.

    References are counted per value first, so a hot value is one row in the join.
    """
    tables = _tables(retail)
    parts = []
    for name, refs in REFERENCES.items():
        for column, target in refs:
            used = tables[name].groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            lost = used.join(tables[target].select(column), column, "left_anti")
            parts.append(lost.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("orphans")).select(
                F.lit(name).alias("table"), F.lit(column).alias("column"), "orphans"
            ))
    return _union(parts)
