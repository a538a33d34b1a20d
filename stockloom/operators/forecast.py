"""Demand forecast: a random forest on daily features, and its recursive use."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.functions.clean import require_columns
from stockloom.functions.skew import shuffle_tasks
from stockloom.operators import forest
from stockloom.operators.sales import latest_row
from stockloom.operators.timeseries import BASE_FEATURES, LAGS, ROLLING, chronological_split
from stockloom.session import cut_lineage

TARGET = "next_day_sales"
_KEYS = ["product_id", "day", TARGET]


@dataclass(frozen=True)
class Evaluation:
    """Quality on the later days: two numbers, sorted importances, predictions per row."""

    rmse: float
    r2: float
    importance: DataFrame
    predictions: DataFrame


@dataclass(frozen=True)
class DemandModel:
    pipeline: PipelineModel
    features: list[str]

    def save(self, spark: SparkSession, path: str) -> str:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        about = json.dumps({"features": self.features, "target": TARGET})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "DemandModel":
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        missing = {"features", "target"} - set(about)
        if missing:
            raise ValueError(f"saved model misses {sorted(missing)}")
        return DemandModel(PipelineModel.load(f"{path}/pipeline"), about["features"])


@dataclass(frozen=True)
class Trained:
    """A model with its quality, to be kept together."""

    model: DemandModel
    quality: Evaluation

    def save(self, spark: SparkSession, path: str) -> str:
        self.model.save(spark, f"{path}/model")
        about = json.dumps({"rmse": self.quality.rmse, "r2": self.quality.r2})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/quality")
        self.quality.importance.coalesce(1).write.mode("overwrite").parquet(f"{path}/importance")
        self.quality.predictions.write.mode("overwrite").parquet(f"{path}/predictions")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Trained":
        about = json.loads(spark.read.text(f"{path}/quality").first()["value"])
        quality = Evaluation(about["rmse"], about["r2"], spark.read.parquet(f"{path}/importance"), spark.read.parquet(f"{path}/predictions"))
        return Trained(DemandModel.load(spark, f"{path}/model"), quality)


def load_or_train(spark: SparkSession, path: str, load: Callable, train: Callable):
    """The saved model, or a newly trained one saved there when there is none yet."""
    try:
        return load(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    model = train()
    model.save(spark, path)
    return model


def fit(train: DataFrame, trees: int = 100, depth: int = 10, min_leaf: int = 5, seed: int = 42) -> DemandModel:
    """Scaled features, then a forest that looks at all features at each split.

    Features are scaled by the population deviation: the scaler divides by the sample's, which is
    larger by a factor that only the number of rows decides.
    """
    features = [c for c in train.columns if c not in _KEYS]
    # The forest passes over the rows many times: lay them out once, on as many tasks as shuffles use.
    laid_out = train.repartition(shuffle_tasks(train.sparkSession)).persist()
    n = laid_out.count()
    to_population = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    steps = [
        VectorAssembler(inputCols=features, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="by_sample", withMean=True),
        ElementwiseProduct(inputCol="by_sample", outputCol="scaled", scalingVec=Vectors.dense([to_population] * len(features))),
        RandomForestRegressor(
            featuresCol="scaled", labelCol=TARGET, predictionCol="predicted", numTrees=trees, maxDepth=depth,
            minInstancesPerNode=min_leaf, featureSubsetStrategy="all", seed=seed,
            # Room for the statistics of more nodes at a time: fewer passes over the rows.
            maxMemoryInMB=512,
        ),
    ]
    pipeline = Pipeline(stages=steps).fit(laid_out)
    laid_out.unpersist()
    return DemandModel(pipeline, features)


def regression_metrics(predictions: DataFrame) -> tuple[float, float]:
    """RMSE and R2 of (actual, predicted). A constant target scores 1 if met, else 0."""
    row = predictions.agg(
        F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)).alias("mse"), F.var_pop("actual").alias("var")
    ).first()
    if row["mse"] is None:
        raise ValueError("no rows to score")
    mse, var = float(row["mse"]), float(row["var"])
    if var > 1e-9:
        return mse**0.5, 1.0 - mse / var
    return mse**0.5, 1.0 if mse < 1e-9 else 0.0


def train(rows: DataFrame, test_share: float = 0.2, **forest) -> tuple[DemandModel, Evaluation]:
    """Fit on the earlier days, score on the later ones."""
    require_columns(rows, _KEYS, "model rows")
    rows = rows.persist()
    earlier, later = chronological_split(rows, test_share)
    if earlier.isEmpty() or later.isEmpty():
        raise ValueError("the split leaves no rows on one side")
    model = fit(earlier, **forest)
    predictions = cut_lineage(
        model.pipeline.transform(later).select(
            F.col(TARGET).alias("actual"), "predicted", "product_id", F.col("day").alias("date")
        )
    )
    rmse, r2 = regression_metrics(predictions)
    weights = model.pipeline.stages[-1].featureImportances.toArray()
    importance = rows.sparkSession.createDataFrame(
        sorted(((f, float(w)) for f, w in zip(model.features, weights)), key=lambda p: -p[1]),
        "feature string, importance double",
    )
    rows.unpersist()
    return model, Evaluation(rmse, r2, importance, predictions)


def latest_state(rows: DataFrame) -> DataFrame:
    """The newest feature row of each product (of labelled rows: the last day but one)."""
    return latest_row(rows.drop(TARGET), "product_id", "day")


def predict_future(
    model: DemandModel, state: DataFrame, days: int = 7, as_of: date | None = None, calendar_lags: bool = False
) -> DataFrame:
    """product_id, date, predicted_sales for the days after ``as_of`` (default: the newest state).

    Each day's prediction feeds the next day's lags and means. Lags move along by position
    (7 takes over from 3); ``calendar_lags`` keeps a true history instead, which starts from
    the known lags and fills unknown days with the weekly one.

    The forest goes to the tasks as arrays, and a batch of products walks through all days at once.
    """
    require_columns(state, ["product_id", *model.features], "state")
    start = as_of or state.agg(F.max("day")).first()[0]
    spark, names = state.sparkSession, list(model.features)
    trees = spark.sparkContext.broadcast(forest.flattened(spark, model.pipeline))
    rows = state.select("product_id", *[F.col(f).cast("double").alias(f) for f in names]).na.fill(0.0)
    dates = [] if start is None else [start + timedelta(n) for n in range(1, days + 1)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in names], 1)
            for day, sold in zip(dates, walked(trees.value, x, names, dates, calendar_lags)):
                columns = [batch.column("product_id"), pa.array([day] * len(x), pa.date32()), pa.array(sold)]
                yield pa.RecordBatch.from_arrays(columns, names=["product_id", "date", "predicted_sales"])

    kind = rows.schema["product_id"].dataType.simpleString()
    return rows.mapInArrow(walk, f"product_id {kind}, date date, predicted_sales double")


def walked(trees: forest.Forest, x: np.ndarray, names: list[str], dates: list[date], calendar_lags: bool) -> Iterator[np.ndarray]:
    """Predictions for the rows ``x`` (columns ``names``) day by day, each from the ones before."""
    place = {name: i for i, name in enumerate(names)}
    lags = [place[f"lag_{n}"] for n in LAGS]
    x = x.copy()
    past = np.stack([x[:, place[f"lag_{_known_lag(n)}"]] for n in range(1, 8)], 1)
    for day in dates:
        for name, value in zip(BASE_FEATURES, (day.weekday(), day.day, day.month)):
            if name in place:
                x[:, place[name]] = value
        sold = np.maximum(trees.predict(x), 0.0)
        yield sold
        for n in ROLLING:
            at = place[f"rolling_mean_{n}"]
            x[:, at] = (x[:, at] * (n - 1) + sold) / n
        if calendar_lags:
            past = np.concatenate([sold[:, None], past], 1)[:, :7]
            x[:, lags] = past[:, [n - 1 for n in LAGS]]
        else:
            x[:, lags[1:]] = x[:, lags[:-1]]
            x[:, lags[0]] = sold


def _known_lag(n: int) -> int:
    return n if n in LAGS else 7


def forecast_pivot(predictions: DataFrame, days: list[date]) -> DataFrame:
    """One row per product, one column per forecast day."""
    names = [d.isoformat() for d in days]
    keyed = predictions.withColumn("day", F.date_format("date", "yyyy-MM-dd"))
    return keyed.groupBy("product_id").pivot("day", names).agg(F.sum("predicted_sales")).na.fill(0.0)
