"""The event stream: batch counters, sketches, and the same as streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.operators import sketches, ticker
from stockloom.operators.scans import flat_items
from stockloom.plans.registry import query
from stockloom.session import run_dir
from stockloom.sources.tables import open_events, open_retail, stream_events
from stockloom.streaming import counters, stateful

# The counts of one item are too many for a summary of fewer counters than this to hold exactly.
SPACE_SAVING_K = 50
CMS_WIDTH, CMS_DEPTH = 1000, 5
# The hash family that SQL can state.
CMS = {"width": CMS_WIDTH, "depth": CMS_DEPTH, "hashing": "modular"}


def events(spark: SparkSession, folder: str) -> DataFrame:
    return flat_items(open_events(spark, folder))


_HOURLY = """SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, product_id, CAST(sum(quantity) AS BIGINT) AS units FROM stream GROUP BY 1, 2"""
_DAILY = """SELECT strftime(ts, '%Y-%m-%d') AS day, product_id, CAST(sum(quantity) AS BIGINT) AS units FROM stream GROUP BY 1, 2"""


@query("product_counts", "SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units FROM stream GROUP BY 1")
def product_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.product_counts(events(spark, folder))


@query("category_totals", "SELECT category, CAST(sum(quantity) AS BIGINT) AS units FROM stream GROUP BY 1")
def category_totals(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.category_totals(events(spark, folder))


@query("hourly_product_totals", _HOURLY)
def hourly_product_totals(spark: SparkSession, folder: str) -> DataFrame:
    return ticker.product_totals(events(spark, folder), "hour")


@query("daily_product_totals", _DAILY)
def daily_product_totals(spark: SparkSession, folder: str) -> DataFrame:
    return ticker.product_totals(events(spark, folder), "day")


def _top_sql(totals: str, period: str, n: int) -> str:
    return f"""WITH totals AS ({totals}),
placed AS (SELECT *, row_number() OVER (PARTITION BY {period} ORDER BY units DESC, product_id) AS position FROM totals)
SELECT {period}, product_id, units, CAST(position AS INTEGER) AS position FROM placed WHERE position <= {n}"""


@query("hourly_top_n", _top_sql(_HOURLY, "hour", 10))
def hourly_top_n(spark: SparkSession, folder: str) -> DataFrame:
    return ticker.top_per_period(ticker.product_totals(events(spark, folder), "hour"), "hour", 10)


@query("daily_top_n", _top_sql(_DAILY, "day", 10))
def daily_top_n(spark: SparkSession, folder: str) -> DataFrame:
    return ticker.top_per_period(ticker.product_totals(events(spark, folder), "day"), "day", 10)


def _filled_sql(totals: str, period: str, pattern: str, count: int, n: int) -> str:
    return f"""WITH totals AS ({totals}),
keys AS (SELECT strftime((SELECT max(ts) FROM stream) - to_{period}s(CAST(i AS INTEGER)), '{pattern}') AS {period} FROM range({count}) r(i)),
placed AS (SELECT *, row_number() OVER (PARTITION BY {period} ORDER BY units DESC, product_id) AS position FROM totals)
SELECT k.{period}, coalesce(p.product_id, -1) AS product_id, coalesce(p.units, 0) AS units, CAST(coalesce(p.position, 0) AS INTEGER) AS position
FROM keys k LEFT JOIN placed p ON p.{period} = k.{period} AND p.position <= {n}"""


def _no_gaps(df: DataFrame) -> DataFrame:
    return df.na.fill({"product_id": -1, "units": 0, "position": 0})


@query("hourly_top_n_filled", _filled_sql(_HOURLY, "hour", "%Y-%m-%d %H:00", 24, 10))
def hourly_top_n_filled(spark: SparkSession, folder: str) -> DataFrame:
    return _no_gaps(ticker.top_per_period_filled(events(spark, folder), "hour", 24, 10))


@query("daily_top_n_filled", _filled_sql(_DAILY, "day", "%Y-%m-%d", 7, 10))
def daily_top_n_filled(spark: SparkSession, folder: str) -> DataFrame:
    return _no_gaps(ticker.top_per_period_filled(events(spark, folder), "day", 7, 10))


@query("hourly_retained", f"""WITH totals AS ({_HOURLY})
SELECT * FROM totals WHERE hour >= strftime((SELECT max(ts) FROM stream) - INTERVAL 24 HOUR, '%Y-%m-%d %H:00')""")
def hourly_retained(spark: SparkSession, folder: str) -> DataFrame:
    lines = events(spark, folder)
    return ticker.retained(ticker.product_totals(ticker.since(lines, "hour", 24), "hour"), lines, "hour", 24)


@query("transaction_rate", """
SELECT count(*) / 5 AS per_minute FROM stream WHERE ts >= (SELECT max(ts) FROM stream) - INTERVAL 5 MINUTE""")
def transaction_rate(spark: SparkSession, folder: str) -> DataFrame:
    return ticker.transaction_rate(open_events(spark, folder), 5)


@query("recent_100", """
SELECT transaction_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS sold_at, customer_id, category, price
FROM stream ORDER BY ts DESC, transaction_id DESC LIMIT 100""")
def recent_100(spark: SparkSession, folder: str) -> DataFrame:
    return flat_items(ticker.recent(open_events(spark, folder), 100)).select(
        "transaction_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("sold_at"), "customer_id", "category", "price"
    )


_SERIES = f"""totals AS ({_HOURLY}),
keys AS (SELECT strftime((SELECT max(ts) FROM stream) - to_hours(CAST(i AS INTEGER)), '%Y-%m-%d %H:00') AS hour FROM range(12) r(i)),
placed AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY units DESC, product_id) AS position
  FROM totals WHERE hour IN (SELECT hour FROM keys)),
kept AS (SELECT hour, product_id, units FROM placed WHERE position <= 10),
leaders AS (SELECT product_id, row_number() OVER (ORDER BY sum(units) DESC, product_id) AS leader FROM kept GROUP BY 1),
series AS (SELECT k.hour, l.leader, k.product_id, k.units FROM kept k JOIN leaders l USING (product_id) WHERE l.leader <= 5)"""


@query("hourly_series", f"WITH {_SERIES} SELECT hour, CAST(leader AS INTEGER) AS leader, product_id, units FROM series")
def hourly_series(spark: SparkSession, folder: str) -> DataFrame:
    return ticker.hourly_series(events(spark, folder), hours=12)


@query("hourly_top_products", f"WITH {_SERIES} SELECT hour, " + ", ".join(
    f"CAST(coalesce(sum(units) FILTER (WHERE leader = {i}), 0) AS BIGINT) AS top_{i}" for i in range(1, 6)
) + " FROM series GROUP BY 1")
def hourly_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return ticker.hourly_top_products(ticker.hourly_series(events(spark, folder), hours=12))


def _estimate_sql(source: str) -> str:
    rows = ", ".join(
        f"({row}, CAST({a} AS BIGINT), CAST({b} AS BIGINT))" for row, (a, b) in enumerate(sketches.hash_parameters(CMS_DEPTH))
    )
    cell = f"((h.a * s.product_id + h.b) % {sketches.HASH_RANGE}) % {CMS_WIDTH}"
    return f"""hashes(r, a, b) AS (VALUES {rows}),
cells AS (SELECT h.r, {cell} AS bucket, CAST(sum(s.quantity) AS BIGINT) AS total FROM {source} s, hashes h GROUP BY 1, 2),
estimates AS (
  SELECT s.product_id, min(c.total) AS estimate
  FROM (SELECT DISTINCT product_id FROM {source}) s, hashes h, cells c WHERE c.r = h.r AND c.bucket = {cell} GROUP BY 1)"""


@query("cms_estimate", f"WITH {_estimate_sql('items')} SELECT product_id, estimate FROM estimates")
def cms_estimate(spark: SparkSession, folder: str) -> DataFrame:
    items = open_retail(spark, folder).items
    sketch = sketches.count_min(items, **CMS)
    return sketches.count_min_estimate(items, sketch, **CMS)


@query("cms_heavy_hitters", f"""WITH {_estimate_sql('items')}
SELECT product_id, estimate FROM estimates WHERE estimate > 1000""")
def cms_heavy_hitters(spark: SparkSession, folder: str) -> DataFrame:
    items = open_retail(spark, folder).items
    sketch = sketches.count_min(items, **CMS)
    return sketches.count_min_heavy_hitters(items, sketch, 1000, **CMS)


@query("space_saving_topk")
def space_saving_topk(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.space_saving(open_retail(spark, folder).items, SPACE_SAVING_K)


@query("space_saving_violations", f"""
SELECT CAST(0 AS BIGINT) AS violations, CAST(least({SPACE_SAVING_K}, count(DISTINCT product_id)) AS BIGINT) AS counters FROM items""")
def space_saving_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of the summary that break its promise: count - error <= true weight <= count, error <= total / k."""
    items = open_retail(spark, folder).items
    exact = items.groupBy(F.col("product_id").alias("item")).agg(F.sum("quantity").alias("units"))
    total = exact.agg(F.sum("units").alias("total")).scalar()
    kept = (F.col("units") <= F.col("count")) & (F.col("count") - F.col("error") <= F.col("units")) & (
        F.col("error") * SPACE_SAVING_K <= total
    )
    found = sketches.space_saving(items, SPACE_SAVING_K).join(exact, "item", "left")
    return found.agg(F.count_if(~F.coalesce(kept, F.lit(False))).alias("violations"), F.count(F.lit(1)).alias("counters"))


_TOP_EXACT = """SELECT product_id, CAST(sum(quantity) AS BIGINT) AS count, CAST(0 AS BIGINT) AS error
FROM stream GROUP BY 1 ORDER BY count DESC, product_id LIMIT 10"""


@query("frequent_products_exact", _TOP_EXACT)
def frequent_products_exact(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.frequent_products(events(spark, folder), 10, "exact")


@query("frequent_products_space_saving", _TOP_EXACT)
def frequent_products_space_saving(spark: SparkSession, folder: str) -> DataFrame:
    """With a counter for each of the event products the summary is exact."""
    return sketches.frequent_products(events(spark, folder), 10, "space_saving", k=100)


@query("frequent_products_count_min", f"""WITH {_estimate_sql('stream')}
SELECT product_id, estimate AS count FROM estimates ORDER BY estimate DESC, product_id LIMIT 10""")
def frequent_products_count_min(spark: SparkSession, folder: str) -> DataFrame:
    found = sketches.frequent_products(events(spark, folder), 10, "count_min_sketch", **CMS)
    return found.select("product_id", "count")


def _new_run(spark: SparkSession) -> str:
    return run_dir(spark, "stream")


@query("stream_hourly_totals", _HOURLY)
def stream_hourly_totals(spark: SparkSession, folder: str) -> DataFrame:
    out = _new_run(spark)
    counters.run(counters.start_period_totals(flat_items(stream_events(spark, folder)), "hour", out))
    return counters.newest_totals(spark, out, ["hour", "product_id"])


@query("stream_retained", f"""WITH totals AS ({_HOURLY})
SELECT * FROM totals WHERE hour >= strftime((SELECT max(ts) FROM stream) - INTERVAL 24 HOUR, '%Y-%m-%d %H:00')""")
def stream_retained(spark: SparkSession, folder: str) -> DataFrame:
    """The hours a live page shows: those past retention leave the state, and with it the result."""
    out = _new_run(spark)
    counters.run(stateful.start_open_periods(flat_items(stream_events(spark, folder)), "hour", out))
    return stateful.open_totals(spark, out, "hour")


@query("stream_retained_days", f"""WITH totals AS ({_DAILY})
SELECT * FROM totals WHERE day >= strftime((SELECT max(ts) FROM stream) - INTERVAL 30 DAY, '%Y-%m-%d')""")
def stream_retained_days(spark: SparkSession, folder: str) -> DataFrame:
    out = _new_run(spark)
    counters.run(stateful.start_open_periods(flat_items(stream_events(spark, folder)), "day", out))
    return stateful.open_totals(spark, out, "day")


@query("stream_daily_totals", _DAILY)
def stream_daily_totals(spark: SparkSession, folder: str) -> DataFrame:
    out = _new_run(spark)
    counters.run(counters.start_period_totals(flat_items(stream_events(spark, folder)), "day", out))
    return counters.newest_totals(spark, out, ["day", "product_id"])


@query("stream_category_totals", "SELECT category, CAST(sum(quantity) AS BIGINT) AS units FROM stream GROUP BY 1")
def stream_category_totals(spark: SparkSession, folder: str) -> DataFrame:
    out = _new_run(spark)
    items = flat_items(stream_events(spark, folder))
    counters.run(counters.start_totals(items, {"category": F.col("category")}, out))
    return counters.newest_totals(spark, out, ["category"])


@query("stream_product_counts", "SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units FROM stream GROUP BY 1")
def stream_product_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = _new_run(spark)
    items = flat_items(stream_events(spark, folder))
    counters.run(counters.start_totals(items, {"product_id": F.col("product_id")}, out))
    return counters.newest_totals(spark, out, ["product_id"])


@query("stream_cms_estimate", f"WITH {_estimate_sql('stream')} SELECT product_id, estimate FROM estimates")
def stream_cms_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """The sketch kept by the stream, asked for every product seen."""
    out = _new_run(spark)
    items = flat_items(stream_events(spark, folder))
    counters.run(counters.start_count_min(items, out, **CMS))
    sketch = counters.newest_totals(spark, out, ["row", "bucket"]).withColumnRenamed("units", "total")
    return sketches.count_min_estimate(events(spark, folder), sketch, **CMS)


@query("stream_space_saving", _TOP_EXACT.replace(" ORDER BY count DESC, product_id LIMIT 10", ""))
def stream_space_saving(spark: SparkSession, folder: str) -> DataFrame:
    out = _new_run(spark)
    counters.run(counters.start_space_saving(flat_items(stream_events(spark, folder)), 100, out))
    return counters.last_stored(spark, out).select(F.col("item").alias("product_id"), "count", "error")


@query("stream_recent_100", """
SELECT transaction_id, customer_id FROM stream ORDER BY ts DESC, transaction_id DESC LIMIT 100""")
def stream_recent_100(spark: SparkSession, folder: str) -> DataFrame:
    out = _new_run(spark)
    counters.run(counters.start_recent(stream_events(spark, folder), 100, out))
    return counters.last_stored(spark, out).select("transaction_id", "customer_id")


def _rate_sql(minutes: int) -> str:
    return f"""
WITH ends AS (
  SELECT date_trunc('minute', ts) + to_minutes(CAST(i AS INTEGER)) AS until FROM stream, range(1, {minutes + 1}) r(i))
SELECT strftime(until, '%Y-%m-%d %H:%M') AS until, count(*) / {minutes} AS per_minute FROM ends GROUP BY 1"""


def _rates(spark: SparkSession, folder: str, minutes: int) -> DataFrame:
    out = _new_run(spark)
    counters.run(counters.start_rate(stream_events(spark, folder), out))
    return counters.sliding_rates(spark, out, minutes).withColumn("until", F.date_format("until", "yyyy-MM-dd HH:mm"))


@query("stream_rate", _rate_sql(5))
def stream_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _rates(spark, folder, 5)


@query("stream_rate_hour", _rate_sql(60))
def stream_rate_hour(spark: SparkSession, folder: str) -> DataFrame:
    """The same over an hour: as many stored rows as for five minutes."""
    return _rates(spark, folder, 60)
