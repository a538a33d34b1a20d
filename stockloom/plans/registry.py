"""Registered queries: a Spark plan by name, and where SQL can say the same, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}

# The retail tables in SQL, as the Spark side maps them.
VIEWS = r"""
products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_retailprice AS price,
         p_brand AS supplier, concat_ws(' ', p_name, p_type, p_brand) AS description
  FROM part),
inventory AS (
  SELECT p_partkey AS inventory_id, p_partkey AS product_id, CAST(p_size AS BIGINT) AS quantity FROM part),
transactions AS (
  SELECT o_orderkey AS transaction_id, o_orderdate AS transaction_date, o_custkey AS customer_id FROM orders),
items AS (
  SELECT l_orderkey AS transaction_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
         l_extendedprice / l_quantity AS price_per_unit
  FROM lineitem),
customers AS (SELECT c_custkey AS customer_id, c_name AS name FROM customer),
sales AS (
  SELECT i.transaction_id, t.transaction_date, i.product_id, p.name AS product_name, p.category,
         i.quantity, i.price_per_unit, t.customer_id
  FROM items i JOIN transactions t USING (transaction_id) JOIN products p USING (product_id)),
brand_of AS (
  SELECT product_id, CAST(regexp_extract(supplier, '(\d+)', 1) AS BIGINT) AS brand_id, supplier, category, price
  FROM products),
brand_items AS (
  SELECT i.transaction_id, b.brand_id AS product_id, i.quantity, i.price_per_unit
  FROM items i JOIN brand_of b USING (product_id)),
brands AS (
  SELECT brand_id AS product_id, supplier AS name, min(category) AS category FROM brand_of GROUP BY 1, 2),
brand_stock AS (
  SELECT b.brand_id AS product_id, CAST(sum(v.quantity) AS BIGINT) AS quantity
  FROM inventory v JOIN brand_of b USING (product_id) GROUP BY 1),
brand_sales AS (
  SELECT i.*, t.transaction_date, t.customer_id, b.category
  FROM brand_items i JOIN transactions t USING (transaction_id) JOIN brands b USING (product_id)),
stream AS (
  SELECT event_id AS transaction_id, ts, user_id AS customer_id,
         CAST(regexp_extract(props, '"k": *(\d+)', 1) AS BIGINT) AS product_id,
         event_type AS category, CAST(1 AS BIGINT) AS quantity, value AS price
  FROM events)
"""


def with_views(body: str) -> str:
    """Prefix SQL with the retail views; ``body`` may open with more of its own after WITH."""
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {VIEWS.strip()},\n{body[5:]}"
    return f"WITH {VIEWS.strip()}\n{body}"


def with_info(body: str, key: str = "product_id", table: str = "products") -> str:
    """SQL of a recommendation with the name and category of the product in ``key``."""
    return f"SELECT q.*, p.name, p.category FROM ({body}) q JOIN {table} p ON p.product_id = q.{key}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(plan: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            TWINS[name] = with_views(sql)
        return plan

    return register
