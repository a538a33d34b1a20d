"""Stock that may be spoilt: features, an isolation forest on Spark, and the items it flags."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stockloom.functions.clean import (
    category_or_default, name_or_default, ordered_columns, require_columns, valid_timestamps,
    whole_number_or_zero,
)
from stockloom.functions.dates import days_between
from stockloom.functions.quantile import exact_quantile
from stockloom.operators.joins import category_fallback, one_hot
from stockloom.operators.stock import one_stock_row
from stockloom.session import cut_lineage

SPOILAGE_FEATURES = [
    "days_since_last_transaction", "sales_velocity", "sales_consistency", "inventory_turnover",
    "inventory_age", "current_inventory", "price_changes",
]
SPOILT_COLUMNS = [
    "product_id", "anomaly_score", "is_anomaly", "name", "category", "current_inventory",
    "days_since_last_transaction",
]
NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
_HASH_SPACE = 1 << 30


def spoilage_features(
    sales: DataFrame, inventory: DataFrame, products: DataFrame | None = None,
    categories: list[str] | None = None, as_of: datetime | None = None,
) -> DataFrame:
    """One row per stocked product: how long, how fast and how steadily it sells.

    Sales are read once and laid out by product; there they are summed per day and the days folded, and a row per
    product is stored. ``as_of`` defaults to the newest sale and counts from its midnight. A product that was
    never sold has 0 throughout.
    """
    require_columns(sales, {"transaction_date", "product_id", "quantity"}, "sales")
    require_columns(inventory, {"product_id", "quantity"}, "inventory")
    sales = whole_number_or_zero(valid_timestamps(sales, "transaction_date"), "quantity")
    priced = "price_per_unit" in sales.columns
    price = F.col("price_per_unit") if priced else F.lit(None).cast("double")
    lines = sales.select("product_id", "transaction_date", "quantity", price.alias("price")).repartition("product_id")
    daily = lines.groupBy("product_id", F.to_date("transaction_date").alias("day")).agg(
        F.sum("quantity").alias("units"), F.avg("price").alias("price"),
        F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last"),
    )
    folded = cut_lineage(daily.groupBy("product_id").agg(
        F.max("last").alias("last"), F.min("first").alias("first"), F.count(F.lit(1)).alias("days"),
        F.sum("units").alias("units"), F.stddev_samp("units").alias("sales_consistency"), F.stddev_samp("price").alias("price_changes"),
    ))
    if as_of is None:
        today = folded.agg(F.max("last").alias("t")).select(F.to_date("t").cast("timestamp_ntz")).scalar()
    else:
        today = F.lit(as_of).cast("date").cast("timestamp_ntz")
    sold = folded.select(
        "product_id", days_between(F.col("last").cast("timestamp_ntz"), today).alias("days_since_last_transaction"),
        (F.col("units") / F.greatest("days", F.lit(1))).alias("sales_velocity"), "sales_consistency", "units",
        days_between(F.col("first").cast("timestamp_ntz"), today).alias("inventory_age"), "price_changes",
    )
    stock = one_stock_row(inventory).withColumnRenamed("quantity", "current_inventory")
    rows = stock.join(sold, "product_id", "left").withColumn(
        "inventory_turnover", F.col("units") / F.greatest("current_inventory", F.lit(1))
    )
    names = SPOILAGE_FEATURES if priced else SPOILAGE_FEATURES[:-1]
    rows = rows.na.fill(0, names)
    if categories is not None:
        kinds = category_fallback(rows.select("product_id"), products, sales)
        rows = one_hot(rows.join(kinds, "product_id"), "category", categories)
        names = names + [f"category_{c}" for c in sorted(categories)]
    return rows.select("product_id", *names)


def _c(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    length = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, length))


def _grow(x: np.ndarray, tree: int, seed: int) -> pd.DataFrame:
    """One isolation tree on a small sample: split a random varying feature at a random value."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][5 if is_right else 4] = me
        node = [tree, me, -1, 0.0, -1, -1, len(rows), depth]
        nodes.append(node)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(low < high)
        if depth >= limit or len(varying) == 0:
            continue
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        to_left = x[rows, feature] <= cut
        if to_left.all():
            continue
        node[2], node[3] = feature, cut
        todo.append((rows[~to_left], depth + 1, me, True))
        todo.append((rows[to_left], depth + 1, me, False))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def _raw_scores(x: np.ndarray, trees: list[dict[str, np.ndarray]], sample: int) -> np.ndarray:
    """Score in (0, 1]: near 1 for points that few splits set apart."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            feature = t["feature"][at]
            inner = feature >= 0
            if not inner.any():
                break
            value = x[rows, np.where(inner, feature, 0)]
            step = np.where(value <= t["threshold"][at], t["left"][at], t["right"][at])
            at = np.where(inner, step, at)
        total += t["depth"][at] + _c(t["size"][at])
    return 2.0 ** (-(total / len(trees)) / max(float(_c(sample)), 1e-12))


@dataclass(frozen=True)
class IsolationForest:
    """A fitted forest. ``nodes`` has at most trees * 2 * sample rows, whatever was fitted on."""

    features: list[str]
    means: list[float]
    devs: list[float]
    nodes: pd.DataFrame
    sample: int
    offset: float

    @staticmethod
    def fit(rows: DataFrame, key: str = "product_id", contamination: float | str = "auto", **growth: int) -> "IsolationForest":
        """A forest on ``rows``; see ``fit_predict``."""
        if contamination == "auto":
            return IsolationForest._grown(rows, key, **growth)
        return IsolationForest.fit_predict(rows, key, contamination, **growth)[0]

    @staticmethod
    def fit_predict(
        rows: DataFrame, key: str = "product_id", contamination: float | str = "auto", **growth: int
    ) -> tuple["IsolationForest", DataFrame]:
        """A forest and its predictions for the rows it was fitted on. Rows are scored once: the limit
        that flags the share of ``contamination`` comes from the stored scores."""
        forest = IsolationForest._grown(rows, key, **growth)
        scored = cut_lineage(forest._score(rows, key))
        if contamination != "auto":
            limit = exact_quantile(scored.select((-F.col("raw_score")).alias("v")), "v", float(contamination))
            forest = replace(forest, offset=limit)
        return forest, forest._flagged(scored)

    @staticmethod
    def _grown(rows: DataFrame, key: str, trees: int = 100, max_sample: int = 256, seed: int = 42) -> "IsolationForest":
        """Each tree takes its own hash-chosen sample, grown in a task of its own."""
        features = [c for c in rows.columns if c != key]
        rows = rows.na.fill(0, features).persist()
        stats = rows.agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]
        ).first()
        n = stats[0]
        if n == 0:
            raise ValueError("no rows to fit on")
        means = [float(v) for v in stats[1:1 + len(features)]]
        devs = [float(v) for v in stats[1 + len(features):]]
        sample = min(max_sample, n)
        # Half as many again as needed, so that no tree falls short.
        share = int(min(1.0, 1.5 * sample / n) * _HASH_SPACE)
        draw = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(_HASH_SPACE).cast("long"))
        wanted = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) <= F.lit(share))
        drawn = rows.select(
            key, F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.explode(wanted).alias("tree")
        )
        order = W.partitionBy("tree").orderBy(draw(F.col("tree")), key)
        picked = drawn.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= sample)

        def grow(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("nth")
            x = _standardise(np.stack(group["x"].to_numpy()), means, devs)
            return _grow(x, int(group["tree"].iloc[0]), seed)

        grown = picked.groupBy("tree").applyInPandas(grow, NODES).toPandas()
        rows.unpersist()
        return IsolationForest(features, means, devs, grown.sort_values(["tree", "node"]), sample, -0.5)

    def _score(self, rows: DataFrame, key: str) -> DataFrame:
        spark = rows.sparkSession
        arrays = [
            {c: group[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size", "depth")}
            for _, group in self.nodes.groupby("tree")
        ]
        trees = spark.sparkContext.broadcast(arrays)
        features, means, devs, sample = self.features, self.means, self.devs, self.sample

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _standardise(batch[features].to_numpy(dtype=float), means, devs)
                yield pd.DataFrame({key: batch[key], "raw_score": _raw_scores(x, trees.value, sample)})

        require_columns(rows, features, "rows")
        kind = dict(rows.dtypes)[key]
        return rows.na.fill(0, features).select(key, *features).mapInPandas(score, f"{key} {kind}, raw_score double")

    def predict(self, rows: DataFrame, key: str = "product_id") -> DataFrame:
        """key, raw_score, anomaly_score, is_anomaly. The anomaly score is the raw score shifted
        so that flagged rows lie above 0."""
        return self._flagged(self._score(rows, key))

    def _flagged(self, scored: DataFrame) -> DataFrame:
        scored = scored.withColumn("anomaly_score", F.col("raw_score") + self.offset)
        return scored.withColumn("is_anomaly", F.col("anomaly_score") > 0)

    def save(self, spark: SparkSession, path: str) -> str:
        spark.createDataFrame(self.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = [(self.features, self.means, self.devs, self.sample, self.offset)]
        schema = "features array<string>, means array<double>, devs array<double>, sample int, offset double"
        spark.createDataFrame(about, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        about = spark.read.parquet(f"{path}/about")
        require_columns(about, ["features", "means", "devs", "sample", "offset"], "saved forest")
        row = about.first()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        return IsolationForest(
            list(row["features"]), list(row["means"]), list(row["devs"]), nodes, row["sample"], row["offset"]
        )


@dataclass(frozen=True)
class Scored:
    """A forest with its predictions for the rows it was fitted on, to be kept together."""

    forest: IsolationForest
    predictions: DataFrame

    def save(self, spark: SparkSession, path: str) -> str:
        self.forest.save(spark, f"{path}/forest")
        self.predictions.write.mode("overwrite").parquet(f"{path}/predictions")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scored":
        return Scored(IsolationForest.load(spark, f"{path}/forest"), spark.read.parquet(f"{path}/predictions"))


def _standardise(x: np.ndarray, means: list[float], devs: list[float]) -> np.ndarray:
    spread = np.where(np.asarray(devs) > 0, devs, 1.0)
    return (x - np.asarray(means)) / spread


def top_anomalies(predictions: DataFrame, n: int = 20) -> DataFrame:
    return predictions.orderBy(F.desc("anomaly_score"), "product_id").limit(n)


def spoilt_items(
    forest: IsolationForest, features: DataFrame, inventory: DataFrame, products: DataFrame,
    threshold: float | None = None, predictions: DataFrame | None = None,
) -> DataFrame:
    """Flagged products with name, category, stock and days since the last sale, worst first.

    A threshold on the anomaly score replaces the forest's own flag. ``predictions``: those of the forest
    for ``features``, if there are any already.
    """
    found = forest.predict(features) if predictions is None else predictions
    if threshold is not None:
        found = found.withColumn("is_anomaly", F.col("anomaly_score") > threshold)
    found = cut_lineage(found.filter("is_anomaly"))
    info = products.select("product_id", "name", "category")
    stock = one_stock_row(inventory).withColumnRenamed("quantity", "current_inventory")
    days = features.select("product_id", "days_since_last_transaction")
    rows = (
        found.join(info, "product_id", "left").join(stock, "product_id", "left").join(days, "product_id", "left")
        .withColumns({
            "name": name_or_default(F.col("name"), F.col("product_id")),
            "category": category_or_default(F.col("category")),
            "current_inventory": F.coalesce("current_inventory", F.lit(0).cast("long")),
            "days_since_last_transaction": F.coalesce("days_since_last_transaction", F.lit(-1).cast("long")),
        })
    )
    return ordered_columns(rows, SPOILT_COLUMNS).orderBy(F.desc("anomaly_score"), "product_id")
