"""Customer scores (recency, frequency, monetary value) and segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.functions.clean import numbers_or_dropped, require_columns, valid_timestamps
from stockloom.functions.dates import days_between
from stockloom.operators import kmeans
from stockloom.session import cut_lineage

FEATURES = ["recency", "frequency", "monetary_value"]


def rfm(sales: DataFrame) -> DataFrame:
    """Per customer: days since the last sale, number of transactions, money spent.

    Days count from one day after the newest sale of all. Lines are summed per (customer,
    transaction) first, so a customer with very many lines is spread over tasks and the
    distinct count is a plain count.
    """
    needed = ["customer_id", "transaction_id", "transaction_date", "quantity", "price_per_unit"]
    require_columns(sales, needed, "sales")
    sales = numbers_or_dropped(valid_timestamps(sales, "transaction_date"), ["quantity", "price_per_unit"])
    visits = sales.na.drop(subset=["customer_id", "transaction_id"]).groupBy("customer_id", "transaction_id").agg(
        F.max("transaction_date").alias("last"),
        F.sum(F.col("quantity") * F.col("price_per_unit")).alias("spent"),
    )
    return _fold_visits(visits)


def rfm_of(items: DataFrame, transactions: DataFrame) -> DataFrame:
    """The same from lines and transactions: lines are summed before the join, which then sees
    one row per transaction on either side, however many lines one holds."""
    items = numbers_or_dropped(items, ["quantity", "price_per_unit"])
    spent = items.groupBy("transaction_id").agg(F.sum(F.col("quantity") * F.col("price_per_unit")).alias("spent"))
    dated = valid_timestamps(transactions, "transaction_date").na.drop(subset=["customer_id", "transaction_id"])
    visits = spent.join(dated, "transaction_id").select(
        "customer_id", F.col("transaction_date").alias("last"), "spent"
    )
    return _fold_visits(visits)


def _fold_visits(visits: DataFrame) -> DataFrame:
    """One row per customer. It is stored before the newest sale of all is asked for, so that
    the lines are read once."""
    per_customer = cut_lineage(visits.groupBy("customer_id").agg(
        F.max("last").alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum("spent").alias("monetary_value"),
    ))
    snapshot = per_customer.agg(F.max("last") + F.expr("INTERVAL 1 DAY")).scalar()
    return per_customer.select(
        "customer_id", days_between(F.col("last"), snapshot).alias("recency"), "frequency", "monetary_value"
    )


def scaled(scores: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Features as distances from their mean in population deviations; a constant one is 0."""
    stats = scores.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in features], *[F.stddev_pop(c).alias(f"dev_{c}") for c in features]
    )
    return scores.withColumns({c: zscore(c, stats) for c in features})


def zscore(column: str, stats: DataFrame):
    mean, dev = stats.select(f"mean_{column}").scalar(), stats.select(f"dev_{column}").scalar()
    return F.when(dev > 0, (F.col(column) - mean) / dev).otherwise(0.0)


def inertia_of_one(scaled_scores: DataFrame) -> DataFrame:
    """Sum of squared distances to the common mean: the inertia of a single cluster."""
    total = sum((F.var_pop(c) * F.count(c) for c in FEATURES[1:]), F.var_pop(FEATURES[0]) * F.count(FEATURES[0]))
    return scaled_scores.agg(total.alias("inertia")).select(F.lit(1).alias("k"), "inertia")


def elbow(scaled_scores: DataFrame, max_k: int = 10, seed: int = 42, restarts: int = 10) -> DataFrame:
    """Inertia for 1 to ``max_k`` clusters. All numbers of clusters and restarts pass over the rows together."""
    rows = kmeans.stored_rows(scaled_scores, "customer_id", FEATURES)
    one = inertia_of_one(rows).first()["inertia"]
    fits = kmeans.fit_many(rows, "customer_id", FEATURES, list(range(2, max_k + 1)), restarts, seed)
    found = [(1, float(one)), *((k, fits[k].inertia) for k in sorted(fits))]
    return scaled_scores.sparkSession.createDataFrame(found, "k int, inertia double")


@dataclass(frozen=True)
class Segmentation:
    """``customers``: scores with a segment. ``centers``: mean scores per segment."""

    customers: DataFrame
    centers: DataFrame
    inertia: float

    def save(self, spark: SparkSession, path: str) -> str:
        self.customers.write.mode("overwrite").parquet(f"{path}/customers")
        self.centers.withColumn("inertia", F.lit(self.inertia)).coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Segmentation":
        centers = spark.read.parquet(f"{path}/centers")
        return Segmentation(spark.read.parquet(f"{path}/customers"), centers.drop("inertia"), centers.first()["inertia"])

    def sizes(self) -> DataFrame:
        return self.customers.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))


def segment(scores: DataFrame, k: int = 4, seed: int = 42, restarts: int = 10) -> Segmentation:
    """K-means on scaled scores, best of several starts.

    Segments are numbered by the recency of their centre, so that numbers mean the same in
    every run. Centres are on the original scale.
    """
    scores = cut_lineage(scores)
    rows = kmeans.stored_rows(scaled(scores), "customer_id", FEATURES)
    best = kmeans.fit_many(rows, "customer_id", FEATURES, [k], restarts, seed)[k]
    stats = scores.agg(
        *[F.avg(c) for c in FEATURES], *[F.stddev_pop(c) for c in FEATURES]
    ).first()
    means, devs = stats[:3], [d or 0.0 for d in stats[3:]]
    original = [
        [float(v) * dev + mean for v, mean, dev in zip(center, means, devs)]
        for center in best.centers
    ]
    order = sorted(range(len(original)), key=lambda i: original[i])
    labels = rows.select("customer_id", kmeans.label(FEATURES, best.centers[order]).alias("segment"))
    customers = cut_lineage(scores.join(labels, "customer_id"))
    centers = scores.sparkSession.createDataFrame(
        [(number, *map(float, original[i])) for number, i in enumerate(order)],
        "segment int, recency double, frequency double, monetary_value double",
    )
    return Segmentation(customers, centers, best.inertia)
