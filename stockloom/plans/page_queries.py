"""Datasets of the start page and the live page, and what comes back from written files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.operators import graph, recommend, scans
from stockloom.plans import report
from stockloom.plans.registry import query
from stockloom.plans.stream_queries import _HOURLY, events
from stockloom.session import run_dir
from stockloom.sources import sinks, snapshots
from stockloom.sources.tables import csv_rejects, open_retail, read_csv_table


@query("dashboard", """
SELECT 'kpi' AS dataset, 'products' AS label, (SELECT count(*) FROM products) AS value
UNION ALL SELECT 'kpi', 'units in stock', (SELECT CAST(sum(quantity) AS BIGINT) FROM inventory)
UNION ALL SELECT 'kpi', 'transactions', (SELECT count(*) FROM transactions)
UNION ALL SELECT 'kpi', 'low stock', (SELECT count(*) FROM inventory WHERE quantity < 20)
UNION ALL SELECT 'day', strftime(transaction_date, '%Y-%m-%d') || ' ' || category, CAST(sum(quantity) AS BIGINT) FROM sales GROUP BY transaction_date, category
UNION ALL (SELECT 'product', CAST(product_id AS VARCHAR), CAST(sum(quantity) AS BIGINT) AS units FROM sales GROUP BY product_id ORDER BY units DESC, product_id LIMIT 10)
UNION ALL (SELECT 'category', category, CAST(sum(quantity) AS BIGINT) AS units FROM sales GROUP BY category ORDER BY units DESC, category LIMIT 5)""")
def dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """The four datasets of the start page, one below the other."""
    page = report.dashboard(open_retail(spark, folder))
    kpi = page.kpis.select(F.inline(F.array(*[
        F.struct(F.lit("kpi").alias("dataset"), F.lit(label).alias("label"), F.col(c).cast("long").alias("value"))
        for label, c in (("products", "total_products"), ("units in stock", "units_in_stock"), ("transactions", "total_transactions"), ("low stock", "low_stock_items"))
    ])))
    rows = lambda name, df, label, value: df.select(F.lit(name).alias("dataset"), label.cast("string").alias("label"), F.col(value).cast("long").alias("value"))
    period, value = page.daily.columns[0], page.daily.columns[-1]
    return (
        kpi.unionByName(rows("day", page.daily, F.concat_ws(" ", F.col(period).cast("string"), "category"), value))
        .unionByName(rows("product", page.top_products, F.col("product_id"), "units"))
        .unionByName(rows("category", page.top_categories, F.col("category"), "units"))
    )


@query("stream_panel", f"""WITH totals AS ({_HOURLY}),
keys AS (SELECT strftime((SELECT max(ts) FROM stream) - to_hours(CAST(i AS INTEGER)), '%Y-%m-%d %H:00') AS hour FROM range(12) r(i)),
placed AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY units DESC, product_id) AS position FROM totals WHERE hour IN (SELECT hour FROM keys)),
kept AS (SELECT hour, product_id, units FROM placed WHERE position <= 10),
leaders AS (SELECT product_id, row_number() OVER (ORDER BY sum(units) DESC, product_id) AS leader FROM kept GROUP BY 1)
SELECT 'product' AS dataset, CAST(product_id AS VARCHAR) AS label, units FROM (
  SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units FROM stream GROUP BY 1 ORDER BY units DESC, product_id LIMIT 10)
UNION ALL SELECT 'category', category, CAST(sum(quantity) AS BIGINT) FROM stream GROUP BY category
UNION ALL SELECT 'hour', k.hour || ' ' || k.product_id, k.units FROM kept k JOIN leaders l USING (product_id) WHERE l.leader <= 5""")
def stream_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The three datasets of the live page, one below the other."""
    panel = report.stream_panel(events(spark, folder), 10, 12, "exact")
    rows = lambda name, df, label, value: df.select(F.lit(name).alias("dataset"), label.cast("string").alias("label"), F.col(value).alias("units"))
    return (
        rows("product", panel.products, F.col("product_id"), "count")
        .unionByName(rows("category", panel.categories, F.col("category"), "units"))
        .unionByName(rows("hour", panel.hourly, F.concat_ws(" ", "hour", F.col("product_id").cast("string")), "units"))
    )


@query("csv_round_trip", """SELECT inventory_id, product_id, quantity FROM inventory""")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Stock exported to CSV with names beside the ids, and read again by its declared schema."""
    paths = sinks.export_tables(open_retail(spark, folder), run_dir(spark, "csv"))
    return read_csv_table(spark, "inventory", paths["inventory"]).select("inventory_id", "product_id", "quantity")


@query("csv_lines_round_trip", """
SELECT transaction_id, product_id, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units, round(sum(quantity * price_per_unit), 2) AS paid
FROM items GROUP BY 1, 2""")
def csv_lines_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The lines exported to CSV with names, read again and summed up."""
    retail = open_retail(spark, folder)
    numbered = replace(retail, items=retail.items.withColumn("item_id", F.monotonically_increasing_id()))
    paths = sinks.export_tables(numbered, run_dir(spark, "csv"))
    back = read_csv_table(spark, "transaction_items", paths["transaction_items"])
    return back.groupBy("transaction_id", "product_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.round(F.sum(F.col("quantity") * F.col("price_per_unit")), 2).alias("paid")
    )


@query("csv_rejects", """
SELECT 'quantity' AS bad, count(*) AS rows FROM inventory WHERE quantity % 10 = 0
UNION ALL SELECT 'taken', count(*) FROM inventory WHERE quantity % 10 <> 0""")
def rejected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Stock written with texts for some numbers: the rows that are told as bad, and those that are taken."""
    stock = open_retail(spark, folder).inventory
    spoilt = stock.withColumn("quantity", F.when(F.col("quantity") % 10 == 0, "some").otherwise(F.col("quantity").cast("string")))
    path = sinks.write_table(spoilt, run_dir(spark, "csv-bad"), "csv")
    bad = csv_rejects(spark, "inventory", path).select(F.explode("bad").alias("bad"))
    taken = read_csv_table(spark, "inventory", path, on_bad="drop").filter("quantity is not null").select(F.lit("taken").alias("bad"))
    return bad.unionByName(taken).groupBy("bad").agg(F.count(F.lit(1)).alias("rows"))


@query("stock_ledger_batches", """
WITH sold AS (
  SELECT product_id, sum(quantity) FILTER (WHERE transaction_date < TIMESTAMP '1998-01-01') AS a,
         sum(quantity) FILTER (WHERE transaction_date >= TIMESTAMP '1998-01-01') AS b FROM sales GROUP BY 1)
SELECT product_id, CAST(greatest(greatest(quantity * 30 - coalesce(a, 0), 10) - coalesce(b, 0), 10) AS BIGINT) AS quantity
FROM inventory LEFT JOIN sold USING (product_id)""")
def stock_ledger_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger after two batches of sales, the second of them handed in twice."""
    retail, ledger = open_retail(spark, folder), run_dir(spark, "ledger")
    dated = retail.items.join(retail.transactions, "transaction_id")
    early = F.col("transaction_date") < F.lit("1998-01-01").cast("timestamp_ntz")
    snapshots.open_ledger(retail.inventory.withColumn("quantity", F.col("quantity") * 30), ledger)
    snapshots.take_in(dated.filter(early), ledger, 1)
    for _ in range(2):
        snapshots.take_in(dated.filter(~early), ledger, 2)
    return snapshots.snapshot(spark, ledger).select("product_id", "quantity")


@query("sales_by_month_folders", """
SELECT strftime(transaction_date, '%Y-%m') AS period, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units FROM sales GROUP BY 1""")
def sales_by_month_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Sales exported by month, the months of one year a second time, and summed up from what lies there."""
    sales, path = open_retail(spark, folder).sales(), run_dir(spark, "months")
    snapshots.export_periods(sales, "transaction_date", path, "month")
    months = spark.createDataFrame([(f"1997-{m:02d}",) for m in range(1, 13)], "period string")
    snapshots.export_periods(sales, "transaction_date", path, "month", months)
    back = spark.read.schema(sales.schema.add("period", "string")).parquet(path)
    return back.groupBy("period").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))


@query("json_round_trip", """
SELECT transaction_id, count(*) AS lines, round(sum(quantity * price_per_unit), 2) AS total, CAST(sum(quantity) AS BIGINT) AS units FROM sales GROUP BY 1""")
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Nested transactions written as JSON lines and summed up from what is read back."""
    nested = scans.nested_transactions(open_retail(spark, folder).sales())
    back = spark.read.schema(nested.schema).json(sinks.write_nested_json(nested, run_dir(spark, "json")))
    units = F.aggregate(F.transform("items", lambda i: i["quantity"]), F.lit(0).cast("long"), lambda a, q: a + q)
    return back.select("transaction_id", F.size("items").cast("long").alias("lines"), F.round("total", 2).alias("total"), units.alias("units"))


@query("graph_round_trip", """
WITH lines AS (SELECT DISTINCT transaction_id AS t, product_id AS p FROM items),
edges AS (SELECT a.p AS src, b.p AS dst, count(*) AS weight FROM lines a JOIN lines b ON a.t = b.t AND a.p <> b.p GROUP BY 1, 2)
SELECT e.src AS product_id, p.name, p.category, count(*) AS neighbours, CAST(sum(weight) AS BIGINT) AS weight
FROM edges e JOIN products p ON p.product_id = e.src GROUP BY 1, 2, 3""")
def graph_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The co-purchase graph written as nodes and edges and put together again."""
    retail = open_retail(spark, folder)
    paths = sinks.export_graph(graph.co_purchase_graph(retail.items), retail.products, run_dir(spark, "graph"))
    edges = spark.read.parquet(paths["edges"]).groupBy(F.col("src").alias("product_id")).agg(
        F.count(F.lit(1)).alias("neighbours"), F.sum("weight").alias("weight")
    )
    return spark.read.parquet(paths["nodes"]).join(edges, "product_id").select("product_id", "name", "category", "neighbours", "weight")


@query("chart_scores", """
SELECT 'rank' AS kind, product_id, CAST(price AS DOUBLE) AS chart_score FROM products
UNION ALL SELECT 'none', product_id, 1.0 FROM inventory""")
def chart_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The measure a chart draws: the first a row has, else 1."""
    retail = open_retail(spark, folder)
    scored = recommend.chart_score(retail.products.select("product_id", F.col("price").alias("rank")))
    bare = recommend.chart_score(retail.inventory.select("product_id"))
    pick = lambda kind, df: df.select(F.lit(kind).alias("kind"), "product_id", F.col("chart_score").cast("double").alias("chart_score"))
    return pick("rank", scored).unionByName(pick("none", bare))
