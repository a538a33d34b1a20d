"""Properties that hold for any input, and planted patterns that must be found."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stockloom.operators import forecast, mining, segments, sketches, spoilage, timeseries
from stockloom.operators.forecast import DemandModel
from stockloom.operators.spoilage import IsolationForest
from stockloom.session import cut_lineage, run_dir
from stockloom.sources import sinks, tables
from tests.test_semantics import lines, tiny_retail


def true_weights(chunks):
    total = {}
    for chunk in chunks:
        for item, weight in chunk:
            total[item] = total.get(item, 0) + weight
    return total


weighted = st.lists(st.tuples(st.integers(0, 30), st.integers(1, 20)), min_size=1, max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(weighted, min_size=1, max_size=6), st.integers(1, 8))
def test_merged_summaries_bound_every_weight(chunks, k):
    """Summaries of parts, merged two at a time, keep the bounds of one summary of everything."""
    merged = None
    for chunk in chunks:
        exact = pd.DataFrame(chunk, columns=["item", "count"]).groupby("item", as_index=False).sum()
        fresh = sketches.merge_summaries(exact.assign(error=0, floor=0, part=0), k)
        both = fresh.assign(part=0) if merged is None else pd.concat([merged.assign(part=0), fresh.assign(part=1)])
        merged = sketches.merge_summaries(both, k)
    truth = true_weights(chunks)
    total = sum(truth.values())
    assert len(merged) <= k
    assert (merged["floor"] <= total / k).all()
    for row in merged.itertuples():
        assert row.count - row.error <= truth[row.item] <= row.count
        assert row.error <= total / k
    held = set(merged["item"])
    assert all(w <= merged["floor"].iloc[0] for item, w in truth.items() if item not in held)


def test_space_saving_on_a_table(spark):
    rng = random.Random(3)
    data = [(7 if rng.random() < 0.35 else rng.randint(100, 2000), rng.randint(1, 5)) for _ in range(20_000)]
    df = spark.createDataFrame(data, "product_id long, quantity long").repartition(13)
    found = sketches.space_saving(df, 40, fan_in=3).toPandas()
    truth = true_weights([data])
    total = sum(truth.values())
    assert found.sort_values("count")["item"].iloc[-1] == 7
    assert len(found) == 40 and (found["error"] <= total / 40).all()
    for row in found.itertuples():
        assert row.count - row.error <= truth[row.item] <= row.count


def test_count_min_never_estimates_below(spark):
    rng = random.Random(4)
    data = [(rng.randint(0, 500), rng.randint(1, 9)) for _ in range(5000)]
    df = spark.createDataFrame(data, "product_id long, quantity long")
    halves = [sketches.count_min(df.filter(f"product_id % 2 = {i}"), width=100, depth=4) for i in (0, 1)]
    whole = sketches.merge_count_min(*halves)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sketches.count_min(df, width=100, depth=4).collect()))
    truth = true_weights([data])
    for row in sketches.count_min_estimate(df, whole, width=100, depth=4).collect():
        assert row["estimate"] >= truth[row["product_id"]]


def planted_baskets(n=600):
    rng = random.Random(11)
    out = []
    for _ in range(n):
        u = rng.random()
        if u < 0.30:
            out.append([1, 2, 3] + ([4] if rng.random() < 0.4 else []))
        elif u < 0.55:
            out.append([5, 6] + ([7] if rng.random() < 0.3 else []))
        elif u < 0.75:
            out.append([8, 9, 10])
        else:
            out.append(rng.sample(range(1, 11), rng.randint(1, 5)))
    return out


def test_planted_groups_are_found(spark):
    items = lines(spark, planted_baskets())
    sets = mining.frequent_itemsets(items, 0.1)
    counts = {tuple(r["items"]): r["support_count"] for r in sets.collect()}
    assert (1, 2, 3) in counts and (8, 9, 10) in counts and (5, 6) in counts
    for s, n in counts.items():
        assert all(counts[tuple(x for x in s if x != left)] >= n for left in s if len(s) > 1)
    rules = {(tuple(r["antecedent"]), tuple(r["consequent"])): r for r in mining.association_rules(sets, 0.5).collect()}
    assert ((1, 2), (3,)) in rules
    for (a, c), r in rules.items():
        if (c, a) in rules:
            assert rules[c, a]["lift"] == pytest.approx(r["lift"])


def planted_outliers(spark):
    rng = np.random.default_rng(8)
    normal = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(95)]
    far = [(1000 + i, *map(float, rng.normal(12, 1, 3))) for i in range(5)]
    return spark.createDataFrame(normal + far, "product_id long, a double, b double, c double")


def test_outliers_score_highest(spark):
    rows = planted_outliers(spark)
    forest = IsolationForest.fit(rows, contamination=0.05)
    found = forest.predict(rows).orderBy(F.desc("anomaly_score")).collect()
    assert {r["product_id"] for r in found[:5]} == {1000 + i for i in range(5)}
    assert sum(r["is_anomaly"] for r in found) == 5
    assert all(0 < r["raw_score"] <= 1 for r in found)
    assert IsolationForest.fit(rows).offset == -0.5
    again = IsolationForest.fit(rows, contamination=0.05).predict(rows).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_forest_survives_saving(spark):
    rows = planted_outliers(spark)
    forest = IsolationForest.fit(rows, contamination=0.1, trees=20)
    path = forest.save(spark, run_dir(spark, "test-forest"))
    loaded = IsolationForest.load(spark, path)
    assert sorted(map(tuple, loaded.predict(rows).collect())) == sorted(map(tuple, forest.predict(rows).collect()))


def test_spoilt_items_by_threshold(spark):
    retail = tiny_retail(spark)
    features = spoilage.spoilage_features(retail.sales(), retail.inventory, retail.products)
    forest = IsolationForest.fit(features, trees=10)
    everything = spoilage.spoilt_items(forest, features, retail.inventory, retail.products, threshold=-2.0)
    assert everything.columns == spoilage.SPOILT_COLUMNS and everything.count() == 3
    assert spoilage.spoilt_items(forest, features, retail.inventory, retail.products, threshold=2.0).count() == 0


@pytest.fixture(scope="module")
def weekly(spark):
    """Demand with a weekly rhythm for three products."""
    sales = spark.range(3).select((F.col("id") + 1).alias("product_id")).crossJoin(
        spark.range(120).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT))").alias("transaction_date"))
    ).withColumn("quantity", (F.col("product_id") * 5 + F.when(F.weekday("transaction_date") >= 5, 20).otherwise(0)).cast("long"))
    sales = sales.withColumn("category", F.when(F.col("product_id") == 1, "a").otherwise("b"))
    inventory = spark.createDataFrame([(1, 10), (2, 20)], "product_id long, quantity long")
    rows = timeseries.forecast_features(sales, inventory, ["a", "b"]).persist()
    return rows, *forecast.train(rows, trees=20, depth=6)


def test_forecast_beats_the_mean(weekly):
    rows, _, quality = weekly
    assert rows.columns[2:-1] == timeseries.feature_names(["a", "b"])
    assert quality.r2 > 0.5 and quality.rmse > 0
    weights = [r["importance"] for r in quality.importance.collect()]
    assert weights == sorted(weights, reverse=True) and sum(weights) == pytest.approx(1.0)


@pytest.mark.parametrize("calendar_lags", [False, True])
def test_forecast_week(weekly, calendar_lags):
    rows, model, _ = weekly
    found = forecast.predict_future(model, forecast.latest_state(rows), 7, calendar_lags=calendar_lags).collect()
    assert len(found) == 21 and all(r["predicted_sales"] >= 0 for r in found)
    assert len({r["date"] for r in found}) == 7
    newest = rows.agg(F.max("day")).first()[0]
    assert min(r["date"] for r in found) > newest
    wide = forecast.forecast_pivot(forecast.predict_future(model, forecast.latest_state(rows), 2), sorted({r["date"] for r in found})[:2])
    assert wide.count() == 3 and len(wide.columns) == 3


def test_demand_model_is_trained_once(spark, weekly):
    rows, model, _ = weekly
    path = run_dir(spark, "test-model")
    calls = []

    def train():
        calls.append(1)
        return model

    for _ in range(2):
        loaded = forecast.load_or_train(spark, path, DemandModel.load, train)
    assert calls == [1] and loaded.features == model.features
    state = forecast.latest_state(rows)
    old = forecast.predict_future(model, state, 1).collect()
    assert sorted(map(tuple, forecast.predict_future(loaded, state, 1).collect())) == sorted(map(tuple, old))


def test_rolling_means_lie_between_extremes(weekly):
    rows, _, _ = weekly
    for n in timeseries.ROLLING:
        assert rows.filter((F.col(f"rolling_mean_{n}") < 5) | (F.col(f"rolling_mean_{n}") > 35)).count() == 0


def test_segments(spark):
    rng = random.Random(2)
    data = [(i, rng.randint(0, 5) + 100 * (i % 3), rng.randint(1, 3) + 50 * (i % 3), float(rng.randint(1, 9) + 900 * (i % 3))) for i in range(90)]
    scores = spark.createDataFrame(data, "customer_id long, recency long, frequency long, monetary_value double")
    found = segments.segment(scores, 3, restarts=3)
    by_group = {(r["customer_id"] % 3, r["segment"]) for r in found.customers.collect()}
    assert by_group == {(0, 0), (1, 1), (2, 2)}
    assert [r["customers"] for r in found.sizes().orderBy("segment").collect()] == [30, 30, 30]
    means = found.customers.groupBy("segment").agg(F.avg("recency"), F.avg("monetary_value")).orderBy("segment").collect()
    for center, mean in zip(found.centers.orderBy("segment").collect(), means):
        assert center["recency"] == pytest.approx(mean[1]) and center["monetary_value"] == pytest.approx(mean[2])
    inertia = [r["inertia"] for r in segments.elbow(segments.scaled(scores), max_k=4, restarts=3).orderBy("k").collect()]
    assert inertia[0] == pytest.approx(270.0)
    assert all(b <= a * 1.001 for a, b in zip(inertia, inertia[1:]))


def test_tables_survive_export(spark, rows):
    retail = tiny_retail(spark)
    folder = run_dir(spark, "test-export")
    for format in ("csv", "parquet"):
        paths = sinks.export_tables(retail, f"{folder}/{format}", format)
        assert set(paths) == {"products", "inventory", "transactions", "transaction_items"}
    back = tables.read_csv_table(spark, "products", f"{folder}/csv/products")
    assert rows(back, "product_id", "name", "price") == rows(retail.products, "product_id", "name", "price")
    assert spark.read.parquet(f"{folder}/parquet/transaction_items").count() == 4
    stock = tables.read_csv_table(spark, "inventory", f"{folder}/csv/inventory")
    assert dict(stock.dtypes)["quantity"] == "bigint" and rows(stock, "quantity") == [(0,), (5,), (30,)]


def test_nested_json_and_graph_survive_writing(spark, rows):
    from stockloom.operators import graph, scans

    retail = tiny_retail(spark)
    folder = run_dir(spark, "test-json")
    nested = scans.nested_transactions(retail.sales())
    path = sinks.write_nested_json(nested, f"{folder}/json")
    back = spark.read.json(path)
    assert rows(back, "transaction_id", "total", "n_items") == [(0, 7.0, 2), (1, 2.0, 1), (2, 36.0, 1)]
    assert back.filter("transaction_id = 0").first()["timestamp"].startswith("2024-01-01T09:00:00")
    bought = graph.co_purchase_graph(retail.items)
    paths = sinks.export_graph(bought, retail.products, f"{folder}/graph")
    assert rows(spark.read.parquet(paths["nodes"]), "product_id", "name") == [(1, "red pen"), (2, "blue pen")]
    assert spark.read.parquet(paths["edges"]).count() == 2


def test_long_transactions_are_nested_whole(spark):
    from stockloom.operators import scans

    sales = tiny_retail(spark).sales().filter("transaction_id = 2")
    sales = sales.crossJoin(spark.range(5000)).withColumn("quantity", F.col("id")).drop("id")
    found = scans.nested_transactions(sales).collect()
    assert [(len(r["items"]), r["n_items"], r["total"]) for r in found] == [(5000, 5000, 9.0 * sum(range(5000)))]


def test_long_itemsets_give_all_their_rules(spark):
    """An itemset of 21 products: only rules with one product on the right reach the confidence."""
    products = list(range(21))
    data = [(products, 21, 9)] + [([x for x in products if x != y], 20, 10) for y in products] + [([x], 1, 29) for x in products]
    sets = spark.createDataFrame([(*r, 30) for r in data], "items array<long>, k int, support_count long, n_baskets long")
    rules = mining.association_rules(sets, 0.9).collect()
    assert sorted(r["consequent"] for r in rules) == [[x] for x in products]
    assert all(sorted(r["antecedent"] + r["consequent"]) == products and r["confidence"] == 0.9 for r in rules)


def test_similar_pairs_are_all_pairs_above_the_threshold(spark):
    from stockloom.operators import similarity

    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.choices(words[: rng.randint(2, 30)], k=rng.randint(1, 12)))) for i in range(120)]
    vectors = similarity.tfidf(spark.createDataFrame(texts, "id long, text string"))
    every = {(r["product_id"], r["other_id"]): r["similarity"] for r in similarity.cosine_pairs(vectors).collect()}
    for threshold, most in ((0.3, 2000), (0.8, 2000), (0.8, 5), (1.0, 3)):
        found = {(r["id"], r["other_id"]): r["similarity"] for r in similarity.similar_pairs(vectors, threshold, most).collect()}
        assert found == {p: s for p, s in every.items() if p[0] < p[1] and s >= threshold}


@pytest.mark.parametrize(("keep", "postings"), [(1, 2000), (6, 3)])
def test_nearest_vectors_of_documents_equal_brute_force(spark, keep, postings):
    from stockloom.operators import similarity

    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(24 if postings < 2000 else 200).select(F.col("doc_id").alias("id"), "text")
    vectors = cut_lineage(similarity.tfidf(texts))
    weights = {}
    for r in vectors.collect():
        weights.setdefault(r["id"], {})[r["token"]] = r["weight"]
    want = {}
    for a, own in weights.items():
        scores = [(-round(sum(w * other[t] for t, w in own.items() if t in other), similarity.PLACES), b) for b, other in weights.items() if own.keys() & other.keys()]
        want[a] = sorted(scores)[:keep]
    got = {}
    for r in similarity.nearest_vectors(vectors, keep, postings).collect():
        got.setdefault(r["id"], []).append((-r["similarity"], r["other"]))
    assert {a: [s for s, _ in sorted(v)] for a, v in got.items()} == {a: [pytest.approx(s, abs=2e-9) for s, _ in v] for a, v in want.items()}
    clear = {a for a, v in want.items() if all(y - x > 1e-8 for (x, _), (y, _) in zip(v, v[1:]))}
    assert len(clear) > 1 and all([b for _, b in sorted(got[a])][:-1] == [b for _, b in want[a]][:-1] for a in clear)


def test_csv_keeps_line_breaks_and_tells_what_does_not_parse(spark, rows):
    folder = run_dir(spark, "test-csv")
    texts = ['plain', 'two\nlines', 'a "quoted", text', 'back\\slash', "", None]
    data = [(i, f"name {i}", "cat", 1.5 * i, "sup", t) for i, t in enumerate(texts)]
    products = spark.createDataFrame(data, "product_id long, name string, category string, price double, supplier string, description string")
    sinks.write_table(products, f"{folder}/good", "csv")
    back = tables.read_csv_table(spark, "products", f"{folder}/good")
    assert rows(back, "product_id", "name", "price") == rows(products, "product_id", "name", "price")
    assert {r["product_id"]: r["description"] or None for r in back.collect()} == {i: t or None for i, t in enumerate(texts)}
    assert tables.csv_rejects(spark, "products", f"{folder}/good").count() == 0

    bad = products.withColumns({"price": F.when(F.col("product_id") == 2, "dear").otherwise(F.col("price").cast("string")), "name": F.when(F.col("product_id") != 4, F.col("name"))})
    sinks.write_table(bad, f"{folder}/bad", "csv")
    assert {(r["product_id"], tuple(r["bad"])) for r in tables.csv_rejects(spark, "products", f"{folder}/bad").collect()} == {("2", ("price",)), ("4", ("name",))}
    assert sorted(r["product_id"] for r in tables.read_csv_table(spark, "products", f"{folder}/bad", on_bad="drop").collect()) == [0, 1, 3, 5]
    with pytest.raises(Exception, match="products.price: dear|products.name: no value"):
        tables.read_csv_table(spark, "products", f"{folder}/bad").collect()
    with pytest.raises(ValueError):
        tables.read_csv_table(spark, "products", f"{folder}/bad", on_bad="guess")


def test_the_start_page_reads_lines_once(spark, tmp_path, capsys):
    from stockloom.plans import report

    retail = tables.open_retail(spark, "/root/testdata/sf0.001")
    report.sales_sets(retail).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("lineitem.parquet") == 1 and "Expand" in plan
    page = report.dashboard(retail)
    assert page.top_products.count() == 10 and page.daily.agg(F.sum("units")).first()[0] == retail.items.agg(F.sum("quantity")).first()[0]
    assert sum(r["units"] for r in report.dashboard(retail).top_categories.collect()) <= page.daily.agg(F.sum("units")).first()[0]
    recent = report.dashboard(retail, last_days=30).daily
    assert 0 < recent.count() < page.daily.count()
