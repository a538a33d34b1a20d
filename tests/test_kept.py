from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.functions.dates import calendar_parts
from stockloom.operators import forecast, forest, graph, segments, spoilage, timeseries
from stockloom.session import run_dir
from stockloom.sources import kept


class Note:
    """An artefact that counts how often it was made."""

    made = 0

    def __init__(self, text):
        self.text = text

    def save(self, spark, path):
        spark.createDataFrame([(self.text,)], "value string").write.text(path)

    @staticmethod
    def load(spark, path):
        return Note(spark.read.text(path).first()["value"])


def make(text):
    Note.made += 1
    return Note(text)


def test_made_once_and_anew_when_files_change(spark):
    folder = run_dir(spark, "kept-input")
    spark.range(5).write.parquet(folder)
    read = lambda: spark.read.parquet(folder)
    first = kept.fingerprint([read()], size=1)
    assert kept.fingerprint([read()], size=1) == first
    assert kept.fingerprint([read()], size=2) != first
    before = Note.made
    assert [kept.keep(spark, "note", first, Note.load, lambda: make("a")).text for _ in range(3)] == ["a"] * 3
    assert Note.made == before + 1
    spark.range(3).write.mode("append").parquet(folder)
    second = kept.fingerprint([read()], size=1)
    assert second != first and kept.keep(spark, "note", second, Note.load, lambda: make("b")).text == "b"
    assert kept.keep(spark, "note", first, Note.load, lambda: make("c")).text == "a" and Note.made == before + 2


def test_tables_without_files_have_no_key(spark):
    assert kept.fingerprint([spark.range(3)]) is None
    before = Note.made
    for _ in range(2):
        kept.keep(spark, "note", None, Note.load, lambda: make("x"))
    assert Note.made == before + 2


def test_what_fails_leaves_nothing(spark):
    def fail():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        kept.keep(spark, "note", "broken", Note.load, fail)
    assert kept.keep(spark, "note", "broken", Note.load, lambda: make("now")).text == "now"


@pytest.fixture(scope="module")
def weekly(spark):
    days = [(p, date(2024, 1, 1) + timedelta(d), float(5 + 3 * ((d + p) % 7) + p)) for p in range(6) for d in range(60)]
    sales = spark.createDataFrame(days, "product_id long, transaction_date date, quantity double").withColumn("transaction_date", F.col("transaction_date").cast("timestamp_ntz"))
    stock = spark.createDataFrame([(p, 10 * p) for p in range(6)], "product_id long, quantity long")
    rows = timeseries.forecast_features(sales, stock).cache()
    return rows, forecast.Trained(*forecast.train(rows, trees=15, depth=6))


def test_trees_as_arrays_predict_the_same(spark, weekly):
    rows, trained = weekly
    model = trained.model
    arrays = forest.flattened(spark, model.pipeline)
    scored = model.pipeline.transform(rows).select(*model.features, "predicted").toPandas()
    assert np.abs(arrays.predict(scored[model.features].to_numpy(float), step=50) - scored["predicted"].to_numpy()).max() < 1e-9
    with pytest.raises(ValueError):
        forest.flattened(spark, model.pipeline, max_bytes=100)


@pytest.mark.parametrize("calendar_lags", [False, True])
def test_days_walked_at_once_equal_days_one_by_one(weekly, calendar_lags):
    rows, trained = weekly
    model, state = trained.model, forecast.latest_state(rows)
    got = {(r.product_id, r.date): r.predicted_sales for r in forecast.predict_future(model, state, 7, calendar_lags=calendar_lags).collect()}
    start = state.agg(F.max("day")).first()[0]
    now = state.select("product_id", *[F.col(f).cast("double").alias(f) for f in model.features]).toPandas().sort_values("product_id")
    past = {n: now[f"lag_{n if n in timeseries.LAGS else 7}"].to_numpy() for n in range(1, 8)}
    spark = rows.sparkSession
    for step in range(1, 8):
        day = start + timedelta(step)
        table = spark.createDataFrame(now).withColumns({k: v.cast("double") for k, v in calendar_parts(F.lit(day)).items()})
        sold = model.pipeline.transform(table).select("product_id", F.greatest("predicted", F.lit(0.0)).alias("p")).toPandas().sort_values("product_id")["p"].to_numpy()
        for p, value in zip(now["product_id"], sold):
            assert got[p, day] == pytest.approx(value, abs=1e-9)
        for n in timeseries.ROLLING:
            now[f"rolling_mean_{n}"] = (now[f"rolling_mean_{n}"] * (n - 1) + sold) / n
        past = {1: sold, **{n: past[n - 1] for n in range(2, 8)}}
        if calendar_lags:
            for n in timeseries.LAGS:
                now[f"lag_{n}"] = past[n]
        else:
            for later, earlier in zip(timeseries.LAGS[:0:-1], timeseries.LAGS[-2::-1]):
                now[f"lag_{later}"] = now[f"lag_{earlier}"]
            now["lag_1"] = sold
    assert len(got) == 42


def test_artefacts_survive_saving(spark, weekly, rows):
    _, trained = weekly
    back = forecast.Trained.load(spark, trained.save(spark, run_dir(spark, "trained")))
    assert (back.quality.rmse, back.quality.r2, back.model.features) == (trained.quality.rmse, trained.quality.r2, trained.model.features)
    assert rows(back.quality.importance) == rows(trained.quality.importance) and rows(back.quality.predictions) == rows(trained.quality.predictions)

    points = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(80)], "product_id long, a double, b double")
    scored = spoilage.Scored(*spoilage.IsolationForest.fit_predict(points, contamination=0.1, trees=10))
    again = spoilage.Scored.load(spark, scored.save(spark, run_dir(spark, "scored")))
    assert rows(again.predictions) == rows(scored.predictions) and rows(again.forest.predict(points)) == rows(scored.predictions)

    scores = spark.createDataFrame([(i, i % 5, i % 3, float(i)) for i in range(40)], "customer_id long, recency long, frequency long, monetary_value double")
    found = segments.segment(scores, 3, restarts=2)
    again = segments.Segmentation.load(spark, found.save(spark, run_dir(spark, "segments")))
    assert rows(again.customers) == rows(found.customers) and rows(again.centers) == rows(found.centers) and again.inertia == found.inertia

    items = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 1), (3, 3)], "transaction_id long, product_id long")
    bought = graph.co_purchase_graph(items, store=True)
    ranked = graph.RankedGraph(bought, graph.page_rank(bought))
    again = graph.RankedGraph.load(spark, ranked.save(spark, run_dir(spark, "graph")))
    assert rows(again.graph.edges) == rows(bought.edges) and rows(again.graph.nodes) == rows(bought.nodes) and rows(again.ranks) == rows(ranked.ranks)


def test_a_batch_taken_in_twice_counts_once(spark, rows):
    from stockloom.sources import snapshots

    folder = run_dir(spark, "test-ledger")
    stock = spark.createDataFrame([(1, 100), (2, 50), (3, 12)], "product_id long, quantity long")
    sold = lambda *x: spark.createDataFrame(list(x), "product_id long, quantity long")
    with pytest.raises(ValueError):
        snapshots.take_in(sold((1, 1)), folder, 1)
    assert snapshots.high_water_mark(spark, folder) is None
    snapshots.open_ledger(stock, folder)
    assert rows(snapshots.take_in(sold((1, 30), (3, 9)), folder, 1)) == [(1, 70), (2, 50), (3, 10)]
    for _ in range(2):  # the same batch, and something else under its number
        assert rows(snapshots.take_in(sold((1, 30), (3, 9)), folder, 1)) == [(1, 70), (2, 50), (3, 10)]
    assert rows(snapshots.take_in(sold((2, 5)), folder, 1)) == [(1, 70), (2, 50), (3, 10)]
    half = f"{folder}/batch=2"  # a job that died: files, but no end
    stock.write.parquet(half)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{half}/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert snapshots.high_water_mark(spark, folder) == 1
    assert rows(snapshots.take_in(sold((2, 5)), folder, 2)) == [(1, 70), (2, 45), (3, 10)]
    for n in range(3, 7):
        snapshots.take_in(sold((1, 1)), folder, n)
    assert rows(snapshots.snapshot(spark, folder)) == [(1, 66), (2, 45), (3, 10)] and snapshots._numbers(spark, folder) == [4, 5, 6]
    assert rows(snapshots.open_ledger(stock, folder)) == [(1, 66), (2, 45), (3, 10)]


def test_an_export_rewrites_touched_days_only(spark, tmp_path, rows):
    import glob
    import os

    from stockloom.sources import snapshots

    path = str(tmp_path / "days")
    sale = lambda i, d, q: (i, date(2024, 1, d), q)
    table = lambda data: spark.createDataFrame(data, "transaction_id long, sold date, quantity long")
    data = [sale(i, 1 + i % 5, i) for i in range(50)]
    snapshots.export_periods(table(data), "sold", path)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/period=*/*.parquet")}
    before = files()
    data = [(i, d, q + 100 if d.day == 3 else q) for i, d, q in data] + [sale(99, 7, 1)]
    snapshots.export_periods(table(data), "sold", path, changed=spark.createDataFrame([("2024-01-03",), ("2024-01-07",)], "period string"))
    after = files()
    assert {f for f in before if f in after} == {f for f in before if "period=2024-01-03" not in f} and all(before[f] == after[f] for f in before if f in after)
    assert rows(spark.read.parquet(path), "transaction_id", "quantity") == sorted((i, q) for i, _, q in data)
