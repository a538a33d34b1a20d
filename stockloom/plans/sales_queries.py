"""Scans, joins, aggregates, cleaning and stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockloom.functions import clean, dates
from stockloom.operators import joins, sales, scans, segments, stock
from stockloom.plans.registry import query
from stockloom.sources import checks
from stockloom.sources.tables import open_events, open_retail

# Fixed values of the test warehouse: the part types.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def lower_columns(values: list[str]) -> dict[str, str]:
    return {v: v.lower() for v in values}


def text_day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd")


@query("scan_products", "SELECT * FROM products")
def scan_products(spark: SparkSession, folder: str) -> DataFrame:
    return open_retail(spark, folder).products


@query("product_lookup", "SELECT * FROM products WHERE product_id = 42")
def product_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return scans.product(open_retail(spark, folder), 42)


@query("inventory_view", """
SELECT v.inventory_id, v.product_id, p.name AS product_name, p.category, p.supplier, v.quantity
FROM inventory v JOIN products p USING (product_id)""")
def inventory_view(spark: SparkSession, folder: str) -> DataFrame:
    return scans.inventory_view(open_retail(spark, folder))


@query("recent_transactions", """
SELECT t.transaction_id, strftime(t.transaction_date, '%Y-%m-%d') AS transaction_date, t.customer_id,
       c.name AS customer_name
FROM transactions t JOIN customers c USING (customer_id)
WHERE t.transaction_date >= (SELECT max(transaction_date) FROM transactions) - INTERVAL 30 DAY
ORDER BY t.transaction_date DESC, t.transaction_id DESC""")
def recent_transactions(spark: SparkSession, folder: str) -> DataFrame:
    found = scans.recent_transactions(open_retail(spark, folder))
    return found.withColumn("transaction_date", text_day("transaction_date"))


_ITEM_COLUMNS = """i.transaction_id, i.product_id, p.name AS product_name, i.quantity,
  i.price_per_unit, i.quantity * i.price_per_unit AS total_price"""


@query("transaction_items_view", f"""
SELECT {_ITEM_COLUMNS} FROM items i JOIN products p USING (product_id)""")
def transaction_items_view(spark: SparkSession, folder: str) -> DataFrame:
    return scans.transaction_items(open_retail(spark, folder))


@query("transaction_items_of", f"""
SELECT {_ITEM_COLUMNS} FROM items i JOIN products p USING (product_id) WHERE i.transaction_id = 0""")
def transaction_items_of(spark: SparkSession, folder: str) -> DataFrame:
    return scans.transaction_items(open_retail(spark, folder), 0)


@query("baskets", """
SELECT transaction_id, string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY product_id) AS items
FROM (SELECT DISTINCT transaction_id, product_id FROM items) GROUP BY transaction_id""")
def baskets(spark: SparkSession, folder: str) -> DataFrame:
    found = scans.baskets(open_retail(spark, folder).items)
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query("flat_fact", """
SELECT transaction_id, strftime(transaction_date, '%Y-%m-%d') AS transaction_date, product_id, product_name,
       category, quantity, price_per_unit, customer_id
FROM sales""")
def flat_fact(spark: SparkSession, folder: str) -> DataFrame:
    return open_retail(spark, folder).sales().withColumn("transaction_date", text_day("transaction_date"))


@query("nested_transactions", """
SELECT transaction_id, customer_id, strftime(transaction_date, '%Y-%m-%d') AS sold_on,
       CAST(count(*) AS BIGINT) AS n_items, round(sum(quantity * price_per_unit), 2) AS total,
       string_agg(product_id || 'x' || quantity, ',' ORDER BY product_id, quantity) AS lines
FROM sales GROUP BY 1, 2, 3""")
def nested_transactions(spark: SparkSession, folder: str) -> DataFrame:
    nested = scans.nested_transactions(open_retail(spark, folder).sales())
    line = F.array_sort(F.transform("items", lambda i: F.struct(i["product_id"], i["quantity"])))
    text = F.transform(line, lambda i: F.concat(i["product_id"].cast("string"), F.lit("x"), i["quantity"].cast("string")))
    return nested.select(
        "transaction_id", "customer_id", text_day("timestamp").alias("sold_on"), "n_items",
        F.round("total", 2).alias("total"), F.array_join(text, ",").alias("lines"),
    )


@query("fk_orphans", """
SELECT 'inventory' AS "table", 'product_id' AS "column", count(*) AS orphans FROM inventory
WHERE product_id NOT IN (SELECT product_id FROM products)
UNION ALL SELECT 'transaction_items', 'transaction_id', count(*) FROM items
WHERE transaction_id NOT IN (SELECT transaction_id FROM transactions)
UNION ALL SELECT 'transaction_items', 'product_id', count(*) FROM items
WHERE product_id NOT IN (SELECT product_id FROM products)""")
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return checks.fk_orphans(open_retail(spark, folder))


@query("pk_duplicates", """
SELECT 'products' AS "table", count(*) AS duplicates FROM (SELECT product_id FROM products GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'inventory', count(*) FROM (SELECT inventory_id FROM inventory GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'transactions', count(*) FROM (SELECT transaction_id FROM transactions GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'customers', count(*) FROM (SELECT customer_id FROM customers GROUP BY 1 HAVING count(*) > 1)""")
def pk_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return checks.pk_duplicates(open_retail(spark, folder))


def _null_sql() -> str:
    required = {
        "products": ["product_id", "name", "category", "price", "supplier"],
        "inventory": ["inventory_id", "product_id", "quantity"],
        "transactions": ["transaction_id"],
        "items": ["transaction_id", "product_id", "quantity", "price_per_unit"],
        "customers": ["customer_id", "name"],
    }
    label = {"items": "transaction_items"}
    return "\nUNION ALL ".join(
        f"""SELECT '{label.get(t, t)}' AS "table", '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS violations FROM {t}"""
        for t, columns in required.items() for c in columns
    )


@query("null_violations", _null_sql())
def null_violations(spark: SparkSession, folder: str) -> DataFrame:
    return checks.null_violations(open_retail(spark, folder))


@query("stock_after_sales", """
SELECT v.inventory_id, v.product_id, greatest(v.quantity * 30 - coalesce(s.sold, 0), 10) AS quantity
FROM inventory v LEFT JOIN (SELECT product_id, CAST(sum(quantity) AS BIGINT) AS sold FROM items GROUP BY 1) s USING (product_id)""")
def stock_after_sales(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    opening = retail.inventory.withColumn("quantity", F.col("quantity") * 30)
    return stock.stock_after_sales(opening, retail.items)


@query("clean_events", """
SELECT transaction_id, date_trunc('second', ts) AS sold_at, CAST(floor(price) AS BIGINT) AS whole_price
FROM stream WHERE ts IS NOT NULL""")
def clean_events(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("event_id").alias("transaction_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("sold_at"),
        F.col("value").cast("string").alias("whole_price"),
    )
    return clean.whole_number_or_zero(clean.valid_timestamps(events, "sold_at"), "whole_price")


@query("calendar_features", """
SELECT transaction_id, CAST(isodow(transaction_date) - 1 AS INTEGER) AS day_of_week,
       CAST(day(transaction_date) AS INTEGER) AS day_of_month, CAST(month(transaction_date) AS INTEGER) AS month
FROM transactions""")
def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    txns = open_retail(spark, folder).transactions
    return txns.select("transaction_id", *[c.alias(n) for n, c in dates.calendar_parts(F.col("transaction_date")).items()])


_PERIOD_SQL = {"hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "week": "%Y-%U", "month": "%Y-%m"}


def _register_periods() -> None:
    for period, pattern in _PERIOD_SQL.items():
        if period == "hour":
            source, ts = "stream", "ts"
        else:
            source, ts = "sales", "transaction_date"

        def plan(spark: SparkSession, folder: str, period: str = period) -> DataFrame:
            if period == "hour":
                lines = scans.flat_items(open_events(spark, folder)).withColumnRenamed("timestamp", "transaction_date")
            else:
                lines = open_retail(spark, folder).sales()
            return sales.sales_by_period(lines, period)

        query(f"sales_by_period_{period}", f"""
SELECT strftime({ts}, '{pattern}') AS period, category, CAST(sum(quantity) AS BIGINT) AS units
FROM {source} GROUP BY 1, 2""")(plan)


_register_periods()


@query("explode_items", """
SELECT transaction_id, customer_id, product_id, coalesce(category, 'Unknown') AS category,
       coalesce(quantity, 1) AS quantity, price FROM stream""")
def explode_items(spark: SparkSession, folder: str) -> DataFrame:
    return scans.flat_items(open_events(spark, folder)).drop("timestamp")


@query("low_stock_simple", "SELECT * FROM inventory WHERE quantity < 20")
def low_stock_simple(spark: SparkSession, folder: str) -> DataFrame:
    return sales.low_stock_simple(open_retail(spark, folder).inventory)


@query("in_stock_sales", """
SELECT product_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(quantity) AS BIGINT) AS units
FROM items WHERE product_id NOT IN (SELECT product_id FROM inventory WHERE quantity < 5) GROUP BY 1""")
def in_stock_sales(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    kept = joins.in_stock_sales(retail.items, retail.inventory, F.col("quantity") < 5)
    return kept.groupBy("product_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))


def _list(values: list[float]) -> str:
    return "[" + ", ".join(str(v) for v in values) + "]"


@query("demand_index", f"""
SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units, round(avg(f), 6) AS mean_index,
       round(sum(quantity / f), 6) AS adjusted_units
FROM (SELECT *, CAST({_list(dates.MONTH_FACTORS)}[month(ts)] AS DOUBLE)
  * (CAST({_list(dates.WEEKDAY_FACTORS)}[isodow(ts)] AS DOUBLE) * CAST({_list(dates.HOUR_FACTORS)}[hour(ts) + 1] AS DOUBLE)) AS f
  FROM stream)
GROUP BY 1""")
def demand_index(spark: SparkSession, folder: str) -> DataFrame:
    found = sales.demand_index(scans.flat_items(open_events(spark, folder)))
    return found.withColumns({
        "mean_index": F.round("mean_index", 6), "adjusted_units": F.round("adjusted_units", 6),
    })


@query("sales_by_daypart", """
SELECT CASE WHEN hour(ts) BETWEEN 5 AND 9 THEN 'morning' WHEN hour(ts) BETWEEN 11 AND 13 THEN 'lunch'
            WHEN hour(ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'other' END AS daypart,
       category, CAST(sum(quantity) AS BIGINT) AS units
FROM stream GROUP BY 1, 2""")
def sales_by_daypart(spark: SparkSession, folder: str) -> DataFrame:
    return sales.sales_by_daypart(scans.flat_items(open_events(spark, folder)))


@query("join_inner", """
SELECT i.transaction_id, i.product_id, p.name, p.category, i.quantity FROM items i JOIN products p USING (product_id)""")
def join_inner(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    return retail.items.join(retail.products, "product_id").select(
        "transaction_id", "product_id", "name", "category", "quantity"
    )


@query("join_star", """
SELECT category, customer_id, CAST(sum(quantity) AS BIGINT) AS units, round(sum(quantity * price_per_unit), 2) AS money
FROM sales GROUP BY 1, 2""")
def join_star(spark: SparkSession, folder: str) -> DataFrame:
    return open_retail(spark, folder).sales().groupBy("category", "customer_id").agg(
        F.sum("quantity").alias("units"),
        F.round(F.sum(F.col("quantity") * F.col("price_per_unit")), 2).alias("money"),
    )


@query("lookup_left_join", """
SELECT v.product_id, v.quantity, coalesce(p.name, 'Product ' || v.product_id) AS name,
       coalesce(p.category, 'Unknown') AS category
FROM inventory v LEFT JOIN products p USING (product_id)""")
def lookup_left_join(spark: SparkSession, folder: str) -> DataFrame:
    return joins.stock_with_names(open_retail(spark, folder))


@query("aligned_ratio", """
SELECT coalesce(s.product_id, v.product_id) AS product_id,
       round(coalesce(s.units / greatest(v.quantity, 1), 0), 6) AS turnover
FROM (SELECT product_id, CAST(sum(quantity) AS DOUBLE) AS units FROM items GROUP BY 1) s
FULL JOIN inventory v ON s.product_id = v.product_id""")
def aligned_ratio(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    sold = retail.items.groupBy("product_id").agg(F.sum("quantity").alias("units"))
    found = joins.aligned_ratio(sold, retail.inventory, "product_id", "units", "quantity", "turnover")
    return found.withColumn("turnover", F.round("turnover", 6))


@query("join_semi", """
SELECT t.transaction_id, t.customer_id FROM transactions t
WHERE EXISTS (SELECT 1 FROM items i WHERE i.transaction_id = t.transaction_id AND i.quantity >= 45)""")
def join_semi(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    bulk = retail.items.filter(F.col("quantity") >= 45).select("transaction_id")
    return retail.transactions.join(bulk, "transaction_id", "left_semi").select("transaction_id", "customer_id")


@query("correlated_sum", """
SELECT p.product_id, (SELECT CAST(sum(i.quantity) AS BIGINT) FROM items i
                      WHERE i.product_id = p.product_id AND i.transaction_id > 100) AS sold
FROM products p
WHERE EXISTS (SELECT 1 FROM items i WHERE i.product_id = p.product_id AND i.transaction_id > 100)""")
def correlated_sum(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    return joins.units_since(retail.items, retail.products, 100, "transaction_id")


@query("join_anti", """
SELECT t.transaction_id, t.customer_id FROM transactions t
WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.transaction_id = t.transaction_id)""")
def join_anti(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    return retail.transactions.join(retail.items.select("transaction_id"), "transaction_id", "left_anti").select(
        "transaction_id", "customer_id"
    )


@query("promo_price", """
WITH promos AS (
  SELECT product_id, TIMESTAMP '1996-01-01' AS start_time, TIMESTAMP '1996-01-01' + to_days(CAST(quantity * 30 AS INTEGER)) AS end_time
  FROM inventory JOIN products USING (product_id) WHERE category = 'PROMO')
SELECT s.product_id, (m.product_id IS NOT NULL) AS promotion_applied, CAST(count(*) AS BIGINT) AS lines,
       round(sum(s.price_per_unit * CASE WHEN m.product_id IS NULL THEN 1.0 ELSE CAST(0.8 AS DOUBLE) END), 2) AS price
FROM sales s LEFT JOIN promos m ON m.product_id = s.product_id
  AND s.transaction_date BETWEEN m.start_time AND m.end_time
GROUP BY 1, 2""")
def promo_price(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    start = F.lit("1996-01-01").cast("timestamp_ntz")
    on_offer = retail.products.filter(F.col("category") == "PROMO").select("product_id")
    promotions = retail.inventory.join(on_offer, "product_id").select(
        "product_id", start.alias("start_time"),
        (start + F.make_dt_interval(F.col("quantity").cast("int") * 30)).alias("end_time"),
        F.lit(0.8).alias("discount_factor"),
    )
    dated = retail.items.join(retail.transactions, "transaction_id")
    priced = joins.promo_price(dated, promotions)
    return priced.groupBy("product_id", "promotion_applied").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("price"), 2).alias("price")
    )


@query("category_fallback", """
WITH own AS (SELECT product_id, category FROM products WHERE category <> 'SMALL'),
sold AS (SELECT product_id, min(category) AS category FROM sales GROUP BY 1)
SELECT v.product_id, coalesce(o.category, s.category, 'Unknown') AS category
FROM inventory v LEFT JOIN own o USING (product_id) LEFT JOIN sold s USING (product_id)""")
def category_fallback(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    incomplete = retail.products.filter(F.col("category") != "SMALL")
    sold = retail.items.join(retail.products, "product_id")
    return joins.category_fallback(retail.inventory.select("product_id"), incomplete, sold)


@query("top_products", """
SELECT product_id, product_name, CAST(sum(quantity) AS BIGINT) AS units FROM sales
GROUP BY 1, 2 ORDER BY units DESC, product_id LIMIT 10""")
def top_products(spark: SparkSession, folder: str) -> DataFrame:
    return sales.top_products(open_retail(spark, folder), 10)


@query("top_categories", """
SELECT category, CAST(sum(quantity) AS BIGINT) AS units FROM sales GROUP BY 1 ORDER BY units DESC, category LIMIT 5""")
def top_categories(spark: SparkSession, folder: str) -> DataFrame:
    return sales.top_categories(open_retail(spark, folder), 5)


@query("dashboard_kpis", """
SELECT (SELECT count(*) FROM products) AS total_products,
       (SELECT CAST(sum(quantity) AS BIGINT) FROM inventory) AS units_in_stock,
       (SELECT count(*) FROM transactions) AS total_transactions,
       (SELECT count(*) FROM inventory WHERE quantity < 20) AS low_stock_items""")
def dashboard_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return sales.dashboard_kpis(open_retail(spark, folder))


@query("daily_sales", """
SELECT product_id, strftime(transaction_date, '%Y-%m-%d') AS day, CAST(sum(quantity) AS BIGINT) AS units
FROM sales GROUP BY 1, 2""")
def daily_sales(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    dated = retail.items.join(retail.transactions, "transaction_id")
    return sales.daily_sales(dated).withColumn("day", text_day("day"))


@query("sales_consistency", """
SELECT product_id, round(coalesce(stddev_samp(units), 0), 6) AS sales_consistency
FROM (SELECT product_id, transaction_date, sum(quantity) AS units FROM sales GROUP BY 1, 2) GROUP BY 1""")
def sales_consistency(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    dated = retail.items.join(retail.transactions, "transaction_id")
    return sales.sales_consistency(dated).withColumn("sales_consistency", F.round("sales_consistency", 6))


@query("price_variability", """
SELECT product_id, round(coalesce(stddev_samp(price), 0), 4) AS price_changes
FROM (SELECT product_id, transaction_date, avg(price_per_unit) AS price FROM sales GROUP BY 1, 2) GROUP BY 1""")
def price_variability(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    dated = retail.items.join(retail.transactions, "transaction_id")
    return sales.price_variability(dated).withColumn("price_changes", F.round("price_changes", 4))


_RFM_SQL = """
rfm AS (
  SELECT customer_id,
         CAST(date_diff('day', max(transaction_date), (SELECT max(transaction_date) + INTERVAL 1 DAY FROM sales)) AS BIGINT) AS recency,
         CAST(count(DISTINCT transaction_id) AS BIGINT) AS frequency,
         sum(quantity * price_per_unit) AS monetary_value
  FROM sales GROUP BY 1)"""


def sold_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with date and customer, without the product columns."""
    retail = open_retail(spark, folder)
    return retail.items.join(retail.transactions, "transaction_id")


def customer_scores(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    return segments.rfm_of(retail.items, retail.transactions)


@query("rfm", f"""WITH {_RFM_SQL.strip()}
SELECT customer_id, recency, frequency, round(monetary_value, 2) AS monetary_value FROM rfm""")
def rfm(spark: SparkSession, folder: str) -> DataFrame:
    return customer_scores(spark, folder).withColumn("monetary_value", F.round("monetary_value", 2))


@query("rfm_scaled", f"""WITH {_RFM_SQL.strip()},
s AS (SELECT avg(recency) ar, stddev_pop(recency) dr, avg(frequency) af, stddev_pop(frequency) df,
             avg(monetary_value) am, stddev_pop(monetary_value) dm FROM rfm)
SELECT customer_id, round((recency - ar) / dr, 6) AS recency, round((frequency - af) / df, 6) AS frequency,
       round((monetary_value - am) / dm, 6) AS monetary_value
FROM rfm, s""")
def rfm_scaled(spark: SparkSession, folder: str) -> DataFrame:
    found = segments.scaled(customer_scores(spark, folder))
    return found.select("customer_id", *[F.round(c, 6).alias(c) for c in segments.FEATURES])


@query("elbow_one", f"""WITH {_RFM_SQL.strip()}
SELECT 1 AS k, round(CAST(3 * count(*) AS DOUBLE), 4) AS inertia FROM rfm""")
def elbow_one(spark: SparkSession, folder: str) -> DataFrame:
    found = segments.inertia_of_one(segments.scaled(customer_scores(spark, folder)))
    return found.withColumn("inertia", F.round("inertia", 4))


@query("sales_by_day_of_some", """
SELECT strftime(transaction_date, '%Y-%m-%d') AS period, category, CAST(sum(quantity) AS BIGINT) AS units FROM sales
WHERE category IN ('PROMO', 'SMALL') GROUP BY 1, 2""")
def sales_by_day_of_some(spark: SparkSession, folder: str) -> DataFrame:
    """Units per day of chosen categories only."""
    return sales.sales_by_period(open_retail(spark, folder).sales(), "day", categories=["PROMO", "SMALL"])


@query("sales_pivot", "SELECT strftime(transaction_date, '%Y-%m') AS period, " + ", ".join(
    f"CAST(coalesce(sum(quantity) FILTER (WHERE category = '{c}'), 0) AS BIGINT) AS {c.lower()}" for c in CATEGORIES
) + " FROM sales GROUP BY 1")
def sales_pivot(spark: SparkSession, folder: str) -> DataFrame:
    by_month = sales.sales_by_period(open_retail(spark, folder).sales(), "month")
    return sales.sales_pivot(by_month, CATEGORIES).withColumnsRenamed(lower_columns(CATEGORIES))


@query("category_onehot", "SELECT product_id, " + ", ".join(
    f"CAST(category = '{c}' AS INTEGER) AS category_{c.lower()}" for c in CATEGORIES
) + " FROM products")
def category_onehot(spark: SparkSession, folder: str) -> DataFrame:
    products = open_retail(spark, folder).products.select("product_id", F.lower("category").alias("category"))
    return joins.one_hot(products, "category", [c.lower() for c in CATEGORIES]).drop("category")


@query("latest_row", """
SELECT product_id, strftime(day, '%Y-%m-%d') AS day, units FROM (
  SELECT product_id, transaction_date AS day, CAST(sum(quantity) AS BIGINT) AS units,
         row_number() OVER (PARTITION BY product_id ORDER BY transaction_date DESC) AS nth
  FROM sales GROUP BY 1, 2) WHERE nth = 1""")
def latest_row(spark: SparkSession, folder: str) -> DataFrame:
    daily = sales.daily_sales(sold_lines(spark, folder))
    return sales.latest_row(daily, "product_id", "day").withColumn("day", text_day("day"))


@query("union_sections", """
SELECT 'low stock' AS section, product_id FROM inventory WHERE quantity < 5
UNION ALL SELECT 'never sold', product_id FROM products WHERE product_id NOT IN (SELECT product_id FROM items)""")
def union_sections(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    low = retail.inventory.filter(F.col("quantity") < 5).select(F.lit("low stock").alias("section"), "product_id")
    unsold = retail.products.join(retail.items, "product_id", "left_anti")
    return low.unionByName(unsold.select(F.lit("never sold").alias("section"), "product_id"))


@query("distinct_products", "SELECT DISTINCT product_id FROM items")
def distinct_products(spark: SparkSession, folder: str) -> DataFrame:
    return open_retail(spark, folder).items.select("product_id").distinct()


@query("first_per_key", """
SELECT customer_id, transaction_id, strftime(transaction_date, '%Y-%m-%d') AS transaction_date FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY transaction_id) AS nth FROM transactions) WHERE nth = 1""")
def first_per_key(spark: SparkSession, folder: str) -> DataFrame:
    txns = open_retail(spark, folder).transactions
    first = sales.first_row(txns, "customer_id", ["transaction_id"])
    return first.withColumn("transaction_date", text_day("transaction_date"))
