"""Daily series, demand features, stock-out alerts: at supplier grain where days are dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.operators import forecast, stock, timeseries
from stockloom.plans.registry import query
from stockloom.plans.sales_queries import CATEGORIES, text_day
from stockloom.sources import kept
from stockloom.sources.tables import open_retail

_GRID = """
span AS (SELECT min(transaction_date) AS a, max(transaction_date) AS b FROM brand_sales),
grid AS (SELECT product_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day
  FROM (SELECT DISTINCT product_id FROM brand_sales), span),
observed AS (SELECT product_id, transaction_date AS day, CAST(sum(quantity) AS BIGINT) AS q FROM brand_sales GROUP BY 1, 2),
daily AS MATERIALIZED (
  SELECT g.product_id, g.day, coalesce(o.q, 0) AS quantity FROM grid g LEFT JOIN observed o USING (product_id, day))"""

_LAGS = ", ".join(
    f"coalesce(lag(quantity, {n}) OVER w, 0) AS lag_{n}" for n in timeseries.LAGS
)
_MEANS = ", ".join(
    f"round(avg(quantity) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS rolling_mean_{n}"
    for n in timeseries.ROLLING
)
_WINDOW = "WINDOW w AS (PARTITION BY product_id ORDER BY day)"


def brand_sales(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Units by supplier and date with a category, and the stock. Lines meet their dates once per data set; all
    forecasts start from the kept sums, a row per supplier and date."""
    plain = open_retail(spark, folder)
    retail = plain.by_supplier()

    def make() -> DataFrame:
        dated = retail.items.select("transaction_id", "product_id", "quantity").join(retail.transactions.select("transaction_id", "transaction_date"), "transaction_id")
        return dated.groupBy("product_id", "transaction_date").agg(F.sum("quantity").alias("quantity"))

    key = kept.fingerprint([plain.items, plain.transactions, plain.products], version=1)
    kinds = retail.products.select("product_id", "category")
    return kept.keep_table(spark, "brand-days", key, make).join(kinds, "product_id"), retail.inventory


def dense(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder).by_supplier()
    return timeseries.dense_daily(retail.items.join(retail.transactions, "transaction_id"))


def days_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", text_day("day"))


def rounded_means(df: DataFrame) -> DataFrame:
    return df.withColumns({f"rolling_mean_{n}": F.round(f"rolling_mean_{n}", 6) for n in timeseries.ROLLING})


@query("product_day_grid", f"WITH {_GRID.strip()} SELECT product_id, strftime(day, '%Y-%m-%d') AS day FROM grid")
def product_day_grid(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder).by_supplier()
    daily = timeseries.observed_days(retail.items.join(retail.transactions, "transaction_id"))
    return days_as_text(timeseries.product_day_grid(daily))


@query("grid_left_join", f"WITH {_GRID.strip()} SELECT product_id, strftime(day, '%Y-%m-%d') AS day, quantity FROM daily")
def grid_left_join(spark: SparkSession, folder: str) -> DataFrame:
    return days_as_text(dense(spark, folder))


@query("sales_lags", f"WITH {_GRID.strip()} SELECT product_id, strftime(day, '%Y-%m-%d') AS day, quantity, {_LAGS} FROM daily {_WINDOW}")
def sales_lags(spark: SparkSession, folder: str) -> DataFrame:
    return days_as_text(timeseries.with_lags(dense(spark, folder)))


@query("rolling_means", f"WITH {_GRID.strip()} SELECT product_id, strftime(day, '%Y-%m-%d') AS day, quantity, {_MEANS} FROM daily")
def rolling_means(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_means(days_as_text(timeseries.with_rolling_means(dense(spark, folder))))


@query("next_day_target", f"""WITH {_GRID.strip()}
SELECT * FROM (SELECT product_id, strftime(day, '%Y-%m-%d') AS day, quantity, lead(quantity) OVER w AS next_day_sales FROM daily {_WINDOW})
WHERE next_day_sales IS NOT NULL""")
def next_day_target(spark: SparkSession, folder: str) -> DataFrame:
    return days_as_text(timeseries.with_next_day(dense(spark, folder)))


_FEATURES = f"""{_GRID},
features AS (
  SELECT * FROM (
    SELECT d.product_id, d.day, CAST(isodow(day) - 1 AS INTEGER) AS day_of_week, CAST(day(day) AS INTEGER) AS day_of_month,
           CAST(month(day) AS INTEGER) AS month, coalesce(s.quantity, 0) AS current_inventory, {{lags}}, {{means}},
           {", ".join(f"CAST(b.category = '{c}' AS INTEGER) AS category_{c}" for c in CATEGORIES)},
           lead(d.quantity) OVER w AS next_day_sales
    FROM daily d LEFT JOIN brand_stock s USING (product_id) JOIN brands b USING (product_id)
    WINDOW w AS (PARTITION BY d.product_id ORDER BY d.day))
  WHERE next_day_sales IS NOT NULL)""".format(
    lags=_LAGS.replace("lag(quantity", "lag(d.quantity"),
    means=_MEANS.replace("avg(quantity)", "avg(d.quantity)").replace("BY product_id ORDER BY day", "BY d.product_id ORDER BY d.day"),
)


def features(spark: SparkSession, folder: str) -> DataFrame:
    dated, inventory = brand_sales(spark, folder)
    return timeseries.forecast_features(dated, inventory, CATEGORIES)


@query("forecast_features", f"WITH {_FEATURES.strip()} SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM features")
def forecast_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_means(days_as_text(features(spark, folder)))


@query("chrono_split", f"""WITH {_FEATURES.strip()},
per_day AS (SELECT day, count(*) AS n FROM features GROUP BY 1),
running AS (SELECT day, sum(n) OVER (ORDER BY day) AS seen, sum(n) OVER () AS total FROM per_day),
cut AS (SELECT max(day) AS day FROM running WHERE seen <= floor(total * (1 - 0.2)))
SELECT CASE WHEN f.day <= cut.day THEN 'train' ELSE 'test' END AS side, count(*) AS rows,
       strftime(min(f.day), '%Y-%m-%d') AS first_day, strftime(max(f.day), '%Y-%m-%d') AS last_day
FROM features f, cut GROUP BY 1""")
def chrono_split(spark: SparkSession, folder: str) -> DataFrame:
    earlier, later = timeseries.chronological_split(features(spark, folder))
    both = earlier.withColumn("side", F.lit("train")).unionByName(later.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(
        F.count(F.lit(1)).alias("rows"), text_day(F.min("day")).alias("first_day"), text_day(F.max("day")).alias("last_day")
    )


# A forecast that SQL can state: each product's mean demand, for a week.
DEMAND = """
span AS (SELECT min(transaction_date) AS a, max(transaction_date) AS b FROM sales),
demand AS (
  SELECT product_id, b + to_days(CAST(d AS INTEGER)) AS date, d AS day_number,
         sum(quantity) / (date_diff('day', a, b) + 1) AS predicted
  FROM sales, span, range(1, 8) r(d) GROUP BY product_id, d, a, b),
cumulative AS (
  SELECT *, sum(predicted) OVER (PARTITION BY product_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS total FROM demand),
alerts AS (
  SELECT c.product_id, v.quantity AS current_inventory, avg(predicted) AS avg_daily_sales, avg(total) AS avg_cumulative_sales,
         min(day_number) FILTER (WHERE v.quantity < total) AS days_until_stockout,
         min(date) FILTER (WHERE v.quantity < total) AS stockout_date
  FROM cumulative c JOIN inventory v USING (product_id) GROUP BY 1, 2)"""

_ALERT = """SELECT product_id, current_inventory, round(avg_daily_sales, 6) AS avg_daily_sales,
  round(avg_cumulative_sales, 6) AS avg_cumulative_sales, CAST(days_until_stockout AS INTEGER) AS days_until_stockout,
  strftime(stockout_date, '%Y-%m-%d') AS stockout_date
FROM alerts WHERE days_until_stockout IS NOT NULL"""


def mean_demand(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    retail = open_retail(spark, folder)
    dated = retail.items.join(retail.transactions, "transaction_id")
    return stock.mean_demand_forecast(dated), retail.inventory


def _alert_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "avg_daily_sales": F.round("avg_daily_sales", 6),
        "avg_cumulative_sales": F.round("avg_cumulative_sales", 6),
        "stockout_date": text_day("stockout_date"),
    })


@query("cumulative_demand", f"""WITH {DEMAND.strip()}
SELECT product_id, strftime(date, '%Y-%m-%d') AS date, CAST(day_number AS INTEGER) AS day_number,
       round(predicted, 6) AS demand, round(total, 6) AS cumulative FROM cumulative""")
def cumulative_demand(spark: SparkSession, folder: str) -> DataFrame:
    found = stock.cumulative_demand(mean_demand(spark, folder)[0])
    return found.withColumns({
        "date": text_day("date"), "demand": F.round("demand", 6), "cumulative": F.round("cumulative", 6),
    })


@query("stock_forecast_join", f"""WITH {DEMAND.strip()}
SELECT product_id, v.quantity AS current_inventory, round(sum(predicted), 6) AS week FROM demand JOIN inventory v USING (product_id) GROUP BY 1, 2""")
def stock_forecast_join(spark: SparkSession, folder: str) -> DataFrame:
    demand, inventory = mean_demand(spark, folder)
    return (
        stock.daily_forecast(demand).join(stock.one_stock_row(inventory), "product_id")
        .groupBy("product_id", F.col("quantity").alias("current_inventory"))
        .agg(F.round(F.sum("demand"), 6).alias("week"))
    )


@query("stockout_day", f"WITH {DEMAND.strip()} {_ALERT}")
def stockout_day(spark: SparkSession, folder: str) -> DataFrame:
    demand, inventory = mean_demand(spark, folder)
    return _alert_columns(stock.stockout_day(inventory, demand))


@query("low_stock", f"WITH {DEMAND.strip()} {_ALERT} AND days_until_stockout <= 5")
def low_stock(spark: SparkSession, folder: str) -> DataFrame:
    demand, inventory = mean_demand(spark, folder)
    return _alert_columns(stock.low_stock(inventory, demand, threshold_days=5))


@query("forecast_pivot", f"WITH {DEMAND.strip()} SELECT product_id, " + ", ".join(
    f"round(sum(predicted) FILTER (WHERE day_number = {d}), 6) AS day_{d}" for d in range(1, 8)
) + " FROM demand GROUP BY 1")
def forecast_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """One column per day of the horizon; the days get their numbers as names."""
    daily = stock.daily_forecast(mean_demand(spark, folder)[0]).withColumnRenamed("demand", "predicted_sales")
    days = sorted(r["date"] for r in daily.select("date").distinct().collect())  # as many as the horizon has days
    wide = forecast.forecast_pivot(daily, days)
    numbered = [F.round(F.col(f"`{d.isoformat()}`"), 6).alias(f"day_{n}") for n, d in enumerate(days, 1)]
    return wide.select("product_id", *numbered)
