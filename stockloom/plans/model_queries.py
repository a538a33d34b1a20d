"""Forecast, spoilage and segmentation models, and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from stockloom.operators import forecast, segments, spoilage, stock
from stockloom.plans import report
from stockloom.plans.registry import query
from stockloom.plans.sales_queries import CATEGORIES, customer_scores, sold_lines
from stockloom.plans.series_queries import DEMAND, brand_sales, features, mean_demand
from stockloom.session import cut_lineage
from stockloom.sources import kept
from stockloom.sources.tables import Retail, open_retail

CONTAMINATION = 0.05


def _key(retail: Retail, **parameters) -> str | None:
    return kept.fingerprint([retail.items, retail.transactions, retail.products, retail.inventory], **parameters)


def trained(spark: SparkSession, folder: str) -> forecast.Trained:
    """The forest of daily demand, trained once per data set."""
    key = _key(open_retail(spark, folder), trees=100, version=1)
    return kept.keep(spark, "demand", key, forecast.Trained.load, lambda: forecast.Trained(*forecast.train(features(spark, folder), trees=100)))


@query("forecast_quality")
def forecast_quality(spark: SparkSession, folder: str) -> DataFrame:
    """One row per feature with its importance, and the model's error on the later days."""
    quality = trained(spark, folder).quality
    return quality.importance.withColumns({"rmse": F.lit(quality.rmse), "r2": F.lit(quality.r2)})


@query("forecast_7d")
def forecast_7d(spark: SparkSession, folder: str) -> DataFrame:
    model = trained(spark, folder).model
    return forecast.predict_future(model, cut_lineage(forecast.latest_state(features(spark, folder))), 7)


def stock_left(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier's stock after all sales."""
    dated, inventory = brand_sales(spark, folder)
    return stock.stock_after_sales(inventory.withColumn("quantity", F.col("quantity") * 30), dated)


@query("forecast_low_stock")
def forecast_low_stock(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers whose stock, after all sales, runs out within five days by the forest's forecast."""
    return stock.low_stock(stock_left(spark, folder), forecast_7d(spark, folder), threshold_days=5)


def product_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of all stocked products, made once per data set."""
    retail = open_retail(spark, folder)
    make = lambda: spoilage.spoilage_features(sold_lines(spark, folder), retail.inventory, retail.products, CATEGORIES)
    return kept.keep_table(spark, "product-features", _key(retail, version=1), make)


_FEATURE_SQL = """
WITH today AS (SELECT max(transaction_date) AS t FROM sales),
daily AS (
  SELECT product_id, transaction_date AS day, sum(quantity) AS units, avg(price_per_unit) AS price FROM sales GROUP BY 1, 2),
sold AS (
  SELECT product_id, date_diff('day', max(day), (SELECT t FROM today)) AS last, date_diff('day', min(day), (SELECT t FROM today)) AS first,
         sum(units) AS units, count(*) AS days, stddev_samp(units) AS consistency, stddev_samp(price) AS prices
  FROM daily GROUP BY 1)
SELECT v.product_id, coalesce(s.last, 0) AS days_since_last_transaction, round(coalesce(s.units / s.days, 0), 6) AS sales_velocity,
       round(coalesce(s.consistency, 0), 6) AS sales_consistency, round(coalesce(s.units / greatest(v.quantity, 1), 0), 6) AS inventory_turnover,
       coalesce(s.first, 0) AS inventory_age, v.quantity AS current_inventory, round(coalesce(s.prices, 0), 4) AS price_changes,
       """ + ", ".join(f"CAST(p.category = '{c}' AS INTEGER) AS category_{c}" for c in CATEGORIES) + """
FROM inventory v LEFT JOIN sold s USING (product_id) JOIN products p USING (product_id)"""


@query("spoilage_features", _FEATURE_SQL)
def spoilage_features(spark: SparkSession, folder: str) -> DataFrame:
    found = product_features(spark, folder)
    return found.withColumns({
        "sales_velocity": F.round("sales_velocity", 6), "sales_consistency": F.round("sales_consistency", 6),
        "inventory_turnover": F.round("inventory_turnover", 6), "price_changes": F.round("price_changes", 4),
    })


def scored(spark: SparkSession, folder: str) -> spoilage.Scored:
    """The isolation forest and what it says of all products, made once per data set."""
    key = _key(open_retail(spark, folder), contamination=CONTAMINATION, version=1)
    make = lambda: spoilage.Scored(*spoilage.IsolationForest.fit_predict(product_features(spark, folder), contamination=CONTAMINATION))
    return kept.keep(spark, "spoilage", key, spoilage.Scored.load, make)


@query("anomaly_score")
def anomaly_score(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).predictions


@query("top_anomalies")
def top_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return spoilage.top_anomalies(anomaly_score(spark, folder), 20)


@query("spoilt_items")
def spoilt_items(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    found = scored(spark, folder)
    rows = product_features(spark, folder)
    return spoilage.spoilt_items(found.forest, rows, retail.inventory, retail.products, predictions=found.predictions)


@query("inventory_report")
def inventory_report(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder)
    demand, inventory = mean_demand(spark, folder)
    low = stock.low_stock(inventory, demand, threshold_days=5)
    return report.inventory_report(low, spoilt_items(spark, folder), retail.products)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(customer_scores(spark, folder))


@query("elbow")
def elbow(spark: SparkSession, folder: str) -> DataFrame:
    return segments.elbow(segments.scaled(scores(spark, folder)))


def in_segments(spark: SparkSession, folder: str) -> segments.Segmentation:
    """Customers in four segments, found once per data set."""
    key = _key(open_retail(spark, folder), k=4, version=1)
    return kept.keep(spark, "segments", key, segments.Segmentation.load, lambda: segments.segment(scores(spark, folder), k=4))


@query("segments")
def segmented(spark: SparkSession, folder: str) -> DataFrame:
    return in_segments(spark, folder).customers


@query("segment_sizes")
def segment_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return in_segments(spark, folder).sizes()


@query("segment_centers")
def segment_centers(spark: SparkSession, folder: str) -> DataFrame:
    return in_segments(spark, folder).centers


# What must hold of the models above, whatever they have learned: each check has a SQL twin.

_SOLD_BRANDS = "(SELECT count(DISTINCT product_id) FROM brand_sales)"


@query("forecast_checks", f"""
SELECT CAST(7 * {_SOLD_BRANDS} AS BIGINT) AS forecasts, CAST(7 AS BIGINT) AS days, CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS repeated,
       strftime(max(transaction_date), '%Y-%m-%d') AS first_day FROM brand_sales""")
def forecast_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every supplier has one forecast for each of the seven days after the newest labelled feature row,
    which is that of the last day but one, and none is below 0."""
    found = cut_lineage(forecast_7d(spark, folder))
    return found.agg(
        F.count(F.lit(1)).alias("forecasts"), F.count_distinct("date").alias("days"), F.count_if(F.col("predicted_sales") < 0).alias("negative"),
        (F.count(F.lit(1)) - F.count_distinct("product_id", "date")).alias("repeated"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_day"),
    )


@query("forecast_quality_checks", """
SELECT CAST(1 AS BIGINT) AS importances_sum_to_one, CAST(0 AS BIGINT) AS negative, CAST(1 AS BIGINT) AS error_is_a_number""")
def forecast_quality_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Importances are shares, and the error on the later days is a number above 0."""
    return forecast_quality(spark, folder).agg(
        F.round(F.sum("importance"), 6).cast("long").alias("importances_sum_to_one"), F.count_if(F.col("importance") < 0).alias("negative"),
        F.min(((F.col("rmse") > 0) & (F.col("rmse") < float("inf")) & (F.col("r2") <= 1)).cast("long")).alias("error_is_a_number"),
    )


@query("forecast_low_stock_checks", """
SELECT CAST(0 AS BIGINT) AS late, CAST(0 AS BIGINT) AS not_short, CAST(0 AS BIGINT) AS missing,
       (SELECT count(DISTINCT product_id) FROM brand_sales JOIN brand_stock USING (product_id)) AS compared""")
def forecast_low_stock_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every alert falls within the threshold, and its stock is below the forecast of the week. Of all suppliers with a stock
    and a forecast none is missing whose stock the forecast of five days uses up."""
    found = cut_lineage(forecast_low_stock(spark, folder))
    week = F.col("avg_daily_sales") * 7 + 1e-6
    forecasts = cut_lineage(forecast_7d(spark, folder))
    last = forecasts.agg(F.date_sub(F.max("date"), 2)).scalar()
    due = forecasts.filter(F.col("date") <= last).groupBy("product_id").agg(F.sum("predicted_sales").alias("need"))
    due = due.join(stock_left(spark, folder), "product_id").join(found.select("product_id", F.lit(True).alias("told")), "product_id", "left")
    both = due.agg(F.count_if((F.col("quantity") < F.col("need") - 1e-6) & F.col("told").isNull()).alias("missing"), F.count(F.lit(1)).alias("compared"))
    alerts = found.agg(F.count_if(F.col("days_until_stockout") > 5).alias("late"), F.count_if(F.col("current_inventory") > week).alias("not_short"))
    return alerts.join(F.broadcast(both))  # a row each


@query("anomaly_checks", f"""
SELECT count(*) AS rows, CAST(1 AS BIGINT) AS share_is_right, CAST(0 AS BIGINT) AS flag_disagrees, CAST(0 AS BIGINT) AS out_of_range FROM inventory""")
def anomaly_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every product is scored, the share asked for is flagged (but for ties at the limit), and flags say the score lies above 0."""
    found = anomaly_score(spark, folder)
    share = F.count_if("is_anomaly") / F.count(F.lit(1))
    return found.agg(
        F.count(F.lit(1)).alias("rows"), (F.abs(share - CONTAMINATION) <= 0.005).cast("long").alias("share_is_right"),
        F.count_if(F.col("is_anomaly") != (F.col("anomaly_score") > 0)).alias("flag_disagrees"),
        F.count_if(~F.col("raw_score").between(0, 1)).alias("out_of_range"),
    )


@query("top_anomalies_checks", """
SELECT CAST(least(20, count(*)) AS BIGINT) AS listed, CAST(0 AS BIGINT) AS beaten FROM inventory""")
def top_anomalies_checks(spark: SparkSession, folder: str) -> DataFrame:
    """No product outside the list scores higher than one in it."""
    scored = cut_lineage(anomaly_score(spark, folder))
    top = cut_lineage(spoilage.top_anomalies(scored, 20).select("product_id", "anomaly_score"))
    least = top.agg(F.min("anomaly_score").alias("least")).scalar()
    outside = scored.join(top.select("product_id"), "product_id", "left_anti")
    beaten = outside.agg(F.count_if(F.col("anomaly_score") > least).alias("n")).scalar()
    return top.agg(F.count(F.lit(1)).alias("listed")).withColumn("beaten", beaten)


def _share_is_right(flagged: Column, inventory: DataFrame) -> Column:
    """1 if the flagged products are the share asked for, but for ties at the limit; else 0."""
    products = inventory.agg(F.count_distinct("product_id")).scalar()
    return (F.abs(flagged / products - CONTAMINATION) <= 0.005).cast("long")


@query("inventory_report_checks", f"""WITH {DEMAND.strip()}
SELECT 'low stock' AS section, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, (SELECT count(*) FROM alerts WHERE days_until_stockout <= 5) AS due
UNION ALL SELECT 'spoilt', 0, 0, 1""")
def inventory_report_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The report holds the products of its two sources, each in its section, and no others. Of low stock as many are due as SQL
    finds; of the spoilt ``due`` is 1 if they are the share asked for."""
    retail = open_retail(spark, folder)
    demand, inventory = mean_demand(spark, folder)
    low = cut_lineage(stock.low_stock(inventory, demand, threshold_days=5))
    spoilt = cut_lineage(spoilt_items(spark, folder))
    section = lambda df, name: df.select(F.lit(name).alias("section"), "product_id", F.lit(1).alias("due"))
    due = section(low, "low stock").unionByName(section(spoilt, "spoilt"))
    shown = report.inventory_report(low, spoilt, retail.products).select("section", "product_id", F.lit(1).alias("shown"))
    names = spark.createDataFrame([("low stock",), ("spoilt",)], "section string")
    found = due.join(shown, ["section", "product_id"], "full_outer").groupBy("section").agg(
        F.count_if(F.col("shown").isNull()).alias("missing"), F.count_if(F.col("due").isNull()).alias("added"), F.count("due").alias("due")
    )
    share = _share_is_right(F.col("due"), retail.inventory)
    return names.join(found, "section", "left").na.fill(0).withColumn("due", F.when(F.col("section") == "spoilt", share).otherwise(F.col("due")))


@query("elbow_checks", """SELECT CAST(10 AS BIGINT) AS ks, CAST(0 AS BIGINT) AS rises, CAST(0 AS BIGINT) AS negative""")
def elbow_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Inertia is there for 1 to 10 clusters and doesn't rise with their number."""
    found = elbow(spark, folder)
    before = F.lag("inertia").over(W.orderBy("k"))  # ten rows
    return found.withColumn("before", before).agg(
        F.count(F.lit(1)).alias("ks"), F.count_if(F.col("inertia") > F.col("before") * 1.001).alias("rises"),
        F.count_if(F.col("inertia") < 0).alias("negative"),
    )


@query("segment_checks", """
SELECT count(DISTINCT customer_id) AS customers, CAST(4 AS BIGINT) AS segments, CAST(0 AS BIGINT) AS not_nearest, CAST(0 AS BIGINT) AS off_centre
FROM sales""")
def segment_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Segments cover all customers, each is in the segment of its nearest centre, and centres are the means of their members."""
    found = in_segments(spark, folder)
    devs = found.customers.agg(*[F.stddev_pop(c).alias(f"dev_{c}") for c in segments.FEATURES])
    centers = found.centers.select(*[F.col(c).alias("segment_" if c == "segment" else f"at_{c}") for c in found.centers.columns])
    wide = found.customers.join(F.broadcast(devs)).join(F.broadcast(centers))  # 1 row and 4 rows
    away = sum(((F.col(c) - F.col(f"at_{c}")) / F.col(f"dev_{c}")) ** 2 for c in segments.FEATURES)
    nearest = wide.groupBy("customer_id", "segment").agg(F.min(away).alias("least"), F.min(F.when(F.col("segment") == F.col("segment_"), away)).alias("own"))
    means = found.customers.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in segments.FEATURES])
    far = [F.abs(F.col(f"mean_{c}") - F.col(c)) > 0.05 * F.col(f"dev_{c}") for c in segments.FEATURES]
    centres = means.join(found.centers, "segment").join(F.broadcast(devs))
    off = centres.agg(F.count_if(far[0] | far[1] | far[2]).alias("off"), F.sum("n").alias("customers"), F.count(F.lit(1)).alias("segments"))
    wrong = nearest.agg(F.count_if(F.col("own") > F.col("least") + 1e-9).alias("n")).scalar()
    return off.select("customers", "segments", wrong.alias("not_nearest"), F.col("off").alias("off_centre"))


@query("segment_sizes_checks", """SELECT count(DISTINCT customer_id) AS customers, CAST(4 AS BIGINT) AS segments FROM sales""")
def segment_sizes_checks(spark: SparkSession, folder: str) -> DataFrame:
    return segment_sizes(spark, folder).agg(F.sum("customers").alias("customers"), F.count(F.lit(1)).alias("segments"))


@query("segment_centers_order", """SELECT CAST(4 AS BIGINT) AS segments, CAST(0 AS BIGINT) AS out_of_order""")
def segment_centers_order(spark: SparkSession, folder: str) -> DataFrame:
    """Segments are numbered by the recency of their centre."""
    before = F.lag("recency").over(W.orderBy("segment"))  # four rows
    found = segment_centers(spark, folder).withColumn("before", before)
    return found.agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("recency") < F.col("before")).alias("out_of_order"))


@query("spoilt_items_checks", """SELECT CAST(0 AS BIGINT) AS unnamed, CAST(0 AS BIGINT) AS wrong_stock, CAST(0 AS BIGINT) AS wrong_days,
CAST(1 AS BIGINT) AS share_is_right""")
def spoilt_items_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged products are the share asked for and come with their name, stock and days since the last sale."""
    retail = open_retail(spark, folder)
    rows = product_features(spark, folder)
    found = cut_lineage(spoilt_items(spark, folder))
    right = retail.inventory.select("product_id", "quantity").join(retail.products.select("product_id", F.col("name").alias("real")), "product_id")
    days = rows.select("product_id", F.col("days_since_last_transaction").alias("days"))
    both = found.join(right, "product_id", "left").join(days, "product_id", "left")
    differs = lambda a, b: F.count_if(~F.col(a).eqNullSafe(F.col(b)))
    return both.agg(
        differs("name", "real").alias("unnamed"), differs("current_inventory", "quantity").alias("wrong_stock"),
        differs("days_since_last_transaction", "days").alias("wrong_days"),
        _share_is_right(F.count(F.lit(1)), retail.inventory).alias("share_is_right"),
    )
