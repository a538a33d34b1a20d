"""Small tables worked out by hand, one per decision."""

import random
from datetime import date, datetime

import dataclasses

import pytest
from pyspark.sql import functions as F

from stockloom.functions import clean, dates
from stockloom.functions.quantile import exact_quantile
from stockloom.functions.text import tokens
from stockloom.operators import (
    forecast, graph, joins, mining, recommend, sales, scans, segments, similarity, sketches, spoilage,
    stock, ticker, timeseries,
)
from stockloom.plans import report
from stockloom.sources import checks
from stockloom.sources.tables import Retail


def lines(spark, baskets):
    data = [(t, p) for t, items in enumerate(baskets) for p in items]
    return spark.createDataFrame(data, "transaction_id long, product_id long")


def tiny_retail(spark):
    products = spark.createDataFrame(
        [(1, "red pen", "office", 2.0, "S#1", "a red pen"), (2, "blue pen", "office", 3.0, "S#1", "a blue pen"),
         (3, "desk lamp", "home", 9.0, "S#2", "light for the desk")],
        "product_id long, name string, category string, price double, supplier string, description string",
    )
    inventory = spark.createDataFrame([(1, 1, 30), (2, 2, 5), (3, 3, 0)], "inventory_id long, product_id long, quantity long")
    transactions = spark.createDataFrame(
        [(0, datetime(2024, 1, 1, 9), 7), (1, datetime(2024, 1, 2, 10), 8), (2, datetime(2024, 1, 2, 18), 7)],
        "transaction_id long, transaction_date timestamp_ntz, customer_id long",
    )
    items = spark.createDataFrame(
        [(0, 1, 2, 2.0), (0, 2, 1, 3.0), (1, 1, 1, 2.0), (2, 3, 4, 9.0)],
        "transaction_id long, product_id long, quantity long, price_per_unit double",
    )
    customers = spark.createDataFrame([(7, "Ann"), (8, "Bo")], "customer_id long, name string")
    return Retail(products, inventory, transactions, items, customers)


# --- mining ---------------------------------------------------------------------------------


def test_support_threshold_rounds_down(spark, rows):
    baskets = [[1, 2, 3]] * 3 + [[1, 2], [3], [4], [4]]
    found = mining.frequent_itemsets(lines(spark, baskets), 0.3)
    counts = {tuple(r["items"]): r["support_count"] for r in found.collect()}
    assert counts == {(1,): 4, (2,): 4, (3,): 4, (4,): 2, (1, 2): 4, (1, 3): 3, (2, 3): 3, (1, 2, 3): 3}
    assert {r["n_baskets"] for r in found.collect()} == {7}


def test_length_limit_agrees_with_growth(spark):
    baskets = [[1, 2, 3], [1, 2], [2, 3], [1, 2, 3, 4], [4], [2, 4]]
    every = {tuple(r["items"]): r["support_count"] for r in mining.frequent_itemsets(lines(spark, baskets), 0.2).collect()}
    for limit in (1, 2, 3, 4):
        short = mining.frequent_itemsets(lines(spark, baskets), 0.2, limit).collect()
        assert {tuple(r["items"]): r["support_count"] for r in short} == {k: v for k, v in every.items() if len(k) <= limit}


def test_repeated_item_counts_once(spark):
    found = mining.frequent_itemsets(lines(spark, [[1, 1, 2], [2, 2]]), 0.5).collect()
    assert {tuple(r["items"]): r["support_count"] for r in found} == {(1,): 1, (2,): 2, (1, 2): 1}


def test_three_items_split_six_ways(spark):
    found = mining.association_rules(mining.frequent_itemsets(lines(spark, [[1, 2, 3]] * 4), 0.9), 0.5).collect()
    of_three = [r for r in found if len(r["antecedent"]) + len(r["consequent"]) == 3]
    assert len(of_three) == 6 and {len(r["consequent"]) for r in of_three} == {1, 2}
    assert len(found) == 12
    assert all(r["confidence"] == r["lift"] == 1.0 for r in found)


def test_single_items_give_no_rules(spark):
    assert mining.association_rules(mining.frequent_itemsets(lines(spark, [[1], [2]]), 0.1), 0.1).count() == 0


def test_rule_recommendations_leave_out_own_items(spark, rows):
    baskets = [[1, 2, 3]] * 5 + [[1, 2]] + [[9]] * 4
    items = lines(spark, baskets)
    rules = mining.association_rules(mining.frequent_itemsets(items, 0.2), 0.5)
    found = mining.rule_recommendations(items, rules, 3)
    assert rows(found, "transaction_id", "product_id") == [(5, 3)]


def test_bundles_keep_both_directions(spark):
    items = lines(spark, [[1, 2]] * 3 + [[3]] * 3)
    rules = mining.association_rules(mining.frequent_itemsets(items, 0.3), 0.5)
    both = mining.bundles(rules, 1.2, 0.5, 5).collect()
    assert [(r["id"], r["products"]) for r in both] == [(1, [1, 2]), (2, [1, 2])]
    assert mining.bundles(rules, 1.2, 0.5, 5, dedupe=True).count() == 1


def test_unknown_products_get_a_default_name(spark):
    items = lines(spark, [[1, 99]] * 2)
    found = mining.itemsets_named(mining.frequent_itemsets(items, 0.5), tiny_retail(spark).products).collect()
    assert {tuple(r["items"]): r["names"] for r in found}[(1, 99)] == ["red pen", "Product 99"]


# --- graph and recommendations ----------------------------------------------------------------


def test_same_product_twice_is_a_node_without_edge(spark, rows):
    bought = graph.co_purchase_graph(lines(spark, [[1, 2], [3, 3], [4]]))
    assert rows(bought.nodes) == [(1,), (2,), (3,)]
    assert rows(bought.edges, "src", "dst", "weight") == [(1, 2, 1), (2, 1, 1)]


def test_big_baskets_give_the_same_pairs(spark, rows):
    baskets = [list(range(30)), [1, 2], [2, 3, 4], list(range(10, 25))]
    items = lines(spark, baskets)
    assert rows(graph.pair_counts(items, max_basket=4)) == rows(graph.pair_counts(items))


def test_big_baskets_are_one_row(spark):
    items = lines(spark, [list(range(100)) * 2, [1, 2]])
    found = {r["transaction_id"]: r["items"] for r in scans.baskets(items).collect()}
    assert found == {0: list(range(100)), 1: [1, 2]}


def test_no_recent_transaction_or_line_is_cut(spark):
    retail = tiny_retail(spark)
    many = retail.transactions.filter("transaction_id = 0").crossJoin(spark.range(1500).withColumnRenamed("id", "n"))
    many = many.withColumn("transaction_id", F.col("n") + 1000).drop("n")
    lots = dataclasses.replace(retail, transactions=many)
    assert scans.recent_transactions(lots).count() == 1500
    one = retail.items.filter("transaction_id = 0").limit(1).crossJoin(spark.range(1500).withColumnRenamed("id", "n")).drop("n")
    assert scans.transaction_items(dataclasses.replace(retail, items=one)).count() == 1500


def brute_rank(edges, nodes, d=0.85, tol=1e-6):
    out = {}
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    n, r = len(nodes), {v: 1 / len(nodes) for v in nodes}
    while True:
        loose = sum(r[v] for v in nodes if v not in out)
        new = {v: (1 - d) / n + d * loose / n for v in nodes}
        for s, t, w in edges:
            new[t] += d * r[s] * w / out[s]
        if sum(abs(new[v] - r[v]) for v in nodes) < n * tol:
            return new
        r = new


@pytest.mark.parametrize("fan_out", [100_000, 2])
def test_page_rank_with_loose_nodes(spark, fan_out):
    bought = graph.co_purchase_graph(lines(spark, [[1, 2], [1, 3], [1, 4], [1, 5], [2, 3], [9, 9]]))
    ranks = {r["product_id"]: r["rank"] for r in graph.page_rank(bought, max_fan_out=fan_out).collect()}
    expected = brute_rank([tuple(r) for r in bought.edges.collect()], [r[0] for r in bought.nodes.collect()])
    assert ranks == pytest.approx(expected, abs=1e-12)
    assert sum(ranks.values()) == pytest.approx(1.0)


def test_page_rank_raises_when_not_converged(spark):
    bought = graph.co_purchase_graph(lines(spark, [[1, 2], [1, 3], [1, 4]]))
    with pytest.raises(RuntimeError):
        graph.page_rank(bought, max_iter=2)


def test_collaborative_score_is_weight_times_rank(spark, rows):
    edges = spark.createDataFrame([(1, 2, 3), (1, 3, 2), (1, 4, 2)], "src long, dst long, weight long")
    ranks = spark.createDataFrame([(2, 0.1), (3, 0.2), (4, 0.2)], "product_id long, rank double")
    found = recommend.collaborative(edges, ranks, 2)
    assert rows(found, "position", "product_id") == [(1, 3), (2, 4)]


def test_hybrid_with_one_empty_side_keeps_the_order(spark, rows):
    collab = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5)], "for_product long, product_id long, score double")
    empty = spark.createDataFrame([], "product_id long, other_id long, similarity double")
    found = recommend.hybrid(collab, empty, 2)
    assert rows(found, "position", "product_id", F.round("hybrid_score", 9)) == [(1, 2, 0.63), (2, 3, 0.35)]


def test_basket_scores_add_up_without_own_items(spark, rows):
    collab = spark.createDataFrame(
        [(1, 3, 0.5), (2, 3, 0.25), (2, 1, 9.0), (1, 4, 0.6)], "for_product long, product_id long, score double"
    )
    found = recommend.for_baskets(lines(spark, [[1, 2]]), collab, 5)
    assert rows(found, "position", "product_id", "score") == [(1, 3, 0.75), (2, 4, 0.6)]


def brute_content(products, stop, n):
    """All pairs with plain loops."""
    import math
    import re

    docs = {
        p["product_id"]: [w for w in re.findall(r"\w{2,}", f"{p['name']} {p['category']} {p['description']}".lower()) if w not in stop]
        for p in products
    }
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    vec = {}
    for d, words in docs.items():
        v = {w: words.count(w) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w in set(words)}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vec[d] = {w: x / norm for w, x in v.items()}
    result = set()
    for a in docs:
        sims = [(-round(sum(x * vec[b].get(w, 0.0) for w, x in vec[a].items()), 9), b) for b in docs if b != a]
        for pos, (s, b) in enumerate(sorted(x for x in sims if x[0] < 0)[:n], 1):
            result.add((a, pos, b))
    return result


@pytest.mark.parametrize("n", [1, 3, 6])
def test_content_recommendations_match_brute_force(spark, n):
    import random

    rng = random.Random(5)
    words = ["red", "blue", "green", "desk", "lamp", "pen", "chair", "the", "oak", "steel", "mini", "set"]
    data = [
        (i, " ".join(rng.choices(words, k=rng.randint(1, 4))), rng.choice(["home", "office"]), rng.choice(["", "all sizes", "oak"]))
        for i in range(60)
    ] + [(100 + i, "red pen", "office", "") for i in range(12)] + [(200, "a", "", "")]
    products = spark.createDataFrame(data, "product_id long, name string, category string, description string")
    from stockloom.functions.text import STOP_WORDS

    expected = brute_content([r.asDict() for r in products.collect()], STOP_WORDS, n)
    found = {(r["product_id"], r["position"], r["other_id"]) for r in similarity.content_recommendations(products, n).collect()}
    assert found == expected


def test_tokens_need_two_characters_and_meaning(spark):
    row = spark.range(1).select(tokens(F.lit("The Big-red X1 a b, café no_1 and ÉTÉ")).alias("t")).first()
    assert row["t"] == ["big", "red", "x1", "café", "no_1", "été"]


def test_cosine_is_symmetric_and_bounded(spark):
    found = {(r[0], r[1]): r[2] for r in similarity.content_similarity(tiny_retail(spark).products).collect()}
    assert all(0 < s <= 1 for s in found.values())
    assert all(found[b, a] == s for (a, b), s in found.items())


def test_chart_score_takes_the_first_measure(spark):
    df = spark.createDataFrame([(1, 0.5, 0.1)], "product_id long, similarity double, rank double")
    assert recommend.chart_score(df).first()["chart_score"] == 0.5
    assert recommend.chart_score(df.select("product_id")).first()["chart_score"] == 1.0


# --- scans, cleaning, aggregates ----------------------------------------------------------------


def test_transaction_zero_is_one_transaction(spark, rows):
    assert rows(scans.transaction_items(tiny_retail(spark), 0), "product_id", "total_price") == [(1, 4.0), (2, 3.0)]


def test_unknown_product_is_empty(spark):
    assert scans.product(tiny_retail(spark), 99).count() == 0


def test_bad_values(spark, rows):
    df = spark.createDataFrame([("2024-01-01", "3"), ("soon", "4"), ("2024-01-02", "x")], "transaction_date string, quantity string")
    kept = clean.whole_number_or_zero(clean.valid_timestamps(df, "transaction_date"), "quantity")
    assert rows(kept, "quantity") == [(0,), (3,)]
    assert clean.numbers_or_dropped(df, ["quantity"]).count() == 2
    with pytest.raises(ValueError, match="misses columns: price"):
        clean.require_columns(df, ["price"], "sales")
    assert clean.ordered_columns(df, ["x", "quantity"]).columns == ["x", "quantity"]


def test_days_between_rounds_down(spark):
    a, b = F.lit(datetime(2024, 1, 2, 12)), F.lit(datetime(2024, 1, 2))
    row = spark.range(1).select(dates.days_between(a, b).alias("back"), dates.days_between(b, a).alias("on")).first()
    assert (row["back"], row["on"]) == (-1, 0)


def test_unknown_period_raises():
    with pytest.raises(ValueError):
        dates.period_key(F.col("x"), "year")


def test_week_key_matches_the_calendar(spark):
    df = spark.range(2500).select(F.date_add(F.lit("2019-12-20").cast("date"), F.col("id").cast("int")).alias("d"))
    for row in df.select("d", dates.period_key(F.col("d"), "week").alias("k")).collect():
        assert row["k"] == row["d"].strftime("%Y-%U")


def test_single_sale_day_has_no_spread(spark, rows):
    retail = tiny_retail(spark)
    found = sales.sales_consistency(retail.sales())
    assert dict(rows(found))[2] == 0.0
    assert dict(rows(found))[1] == pytest.approx(0.5**0.5)


def test_constraint_checks_find_violations(spark, rows):
    good = tiny_retail(spark)
    bad_items = good.items.unionByName(
        spark.createDataFrame([(77, 55, 1, 1.0), (77, 1, 1, 1.0)], good.items.schema)
    )
    bad = Retail(good.products.unionByName(good.products.limit(1)), good.inventory, good.transactions, bad_items, good.customers)
    assert dict(((t, c), n) for t, c, n in rows(checks.fk_orphans(bad)))[("transaction_items", "transaction_id")] == 2
    assert dict(((t, c), n) for t, c, n in rows(checks.fk_orphans(bad)))[("transaction_items", "product_id")] == 1
    assert dict(rows(checks.pk_duplicates(bad)))["products"] == 1
    assert all(n == 0 for _, _, n in rows(checks.null_violations(good)))


def test_stock_never_falls_below_the_floor(spark, rows):
    retail = tiny_retail(spark)
    assert rows(stock.stock_after_sales(retail.inventory, retail.items, 10), "product_id", "quantity") == [(1, 27), (2, 10), (3, 10)]


def test_promotion_inside_its_span_only(spark, rows):
    retail = tiny_retail(spark)
    promotions = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), datetime(2024, 1, 1, 23), 0.5), (1, datetime(2024, 1, 1), datetime(2024, 1, 1, 12), 0.8)],
        "product_id long, start_time timestamp_ntz, end_time timestamp_ntz, discount_factor double",
    )
    found = joins.promo_price(retail.sales(), promotions)
    assert rows(found, "transaction_id", "product_id", "price", "promotion_applied") == [
        (0, 1, 1.0, True), (0, 2, 3.0, False), (1, 1, 2.0, False), (2, 3, 9.0, False),
    ]


def test_exact_quantile(spark):
    import numpy as np

    for values in ([3.0], [1.0, 2.0], [5.0] * 7, list(range(100)), [0.0, 1e-12, 1e9, 5.0, 5.0, 7.5]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        for q in (0.0, 0.05, 0.5, 0.77, 1.0):
            assert exact_quantile(df, "v", q, bins=8, small=2) == pytest.approx(float(np.quantile(values, q)))


# --- series, forecast, stock-out ------------------------------------------------------------------


def test_grid_counts_sales_inside_days(spark, rows):
    data = [(1, datetime(2024, 1, 1, 9), 2), (1, datetime(2024, 1, 1, 17), 3), (1, datetime(2024, 1, 3, 8), 1), (2, datetime(2024, 1, 2, 23), 4)]
    df = spark.createDataFrame(data, "product_id long, transaction_date timestamp_ntz, quantity long")
    found = rows(timeseries.dense_daily(df), "product_id", F.dayofmonth("day"), "quantity")
    assert found == [(1, 1, 5), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, 4), (2, 3, 0)]


def test_split_cuts_at_a_day(spark):
    df = spark.createDataFrame([(d, p) for d in range(10) for p in range(3)], "day long, product_id long")
    train, test = timeseries.chronological_split(df, 0.25)
    assert train.agg(F.max("day")).first()[0] == 6 and test.count() == 9


def test_stock_runs_out_on_the_third_day(spark):
    inventory = spark.createDataFrame([(1, 5)], "product_id long, quantity long")
    demand = spark.createDataFrame([(1, date(2024, 1, d), 2.0) for d in range(1, 5)], "product_id long, date date, predicted_sales double")
    row = stock.stockout_day(inventory, demand).first()
    assert row["days_until_stockout"] == 3 and row["stockout_date"] == date(2024, 1, 3)
    assert row["avg_daily_sales"] == 2.0 and row["avg_cumulative_sales"] == 5.0
    assert stock.low_stock(inventory, demand, 2).count() == 0


def test_constant_target_scores(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "actual double, predicted double")
    assert forecast.regression_metrics(df) == (0.0, 1.0)
    off = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "actual double, predicted double")
    assert forecast.regression_metrics(off) == (1.0, 0.0)


# --- customers --------------------------------------------------------------------------------------


def test_rfm_by_hand(spark, rows):
    retail = tiny_retail(spark)
    expected = [(7, 1, 2, 43.0), (8, 1, 1, 2.0)]
    assert rows(segments.rfm(retail.sales())) == expected
    assert rows(segments.rfm_of(retail.items, retail.transactions)) == expected


def test_constant_score_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 1, 1, 1.0), (2, 1, 3, 3.0)], "customer_id long, recency long, frequency long, monetary_value double")
    assert sorted(tuple(r)[1:] for r in segments.scaled(df).collect()) == [(0.0, -1.0, -1.0), (0.0, 1.0, 1.0)]


# --- stream counters ----------------------------------------------------------------------------------


def events(spark, data):
    return spark.createDataFrame(data, "transaction_id long, timestamp timestamp_ntz, product_id long, category string, quantity long")


def test_empty_hours_stay(spark):
    items = events(spark, [(1, datetime(2024, 1, 1, 8, 30), 5, "a", 2), (2, datetime(2024, 1, 1, 10, 15), 6, "a", 1)])
    found = {r["hour"]: r["product_id"] for r in ticker.top_per_period_filled(items, "hour", 3, 5).collect()}
    assert found == {"2024-01-01 08:00": 5, "2024-01-01 09:00": None, "2024-01-01 10:00": 6}


def test_rate_counts_the_last_minutes(spark):
    data = [(i, datetime(2024, 1, 1, 8, i), 1, "a", 1) for i in range(10)]
    assert ticker.transaction_rate(events(spark, data), 5).first()[0] == 6 / 5


def test_missing_item_fields_get_defaults(spark):
    df = spark.sql("SELECT 1L AS transaction_id, timestamp_ntz'2024-01-01' AS timestamp, 2L AS customer_id, "
                   "array(named_struct('product_id', 3L, 'category', CAST(NULL AS STRING), 'quantity', CAST(NULL AS BIGINT), 'price', 1.0D)) AS items")
    row = scans.flat_items(df).first()
    assert (row["category"], row["quantity"]) == ("Unknown", 1)


def test_frequent_products_by_each_algorithm(spark):
    items = events(spark, [(i, datetime(2024, 1, 1), p, "a", p) for i, p in enumerate([1, 2, 3, 3, 3])])
    for algorithm in ("space_saving", "count_min_sketch", "exact"):
        top = sketches.frequent_products(items, 1, algorithm).first()
        assert (top["product_id"], top["count"]) == (3, 9)


def test_hash_parameters_leave_the_global_generator_alone():
    import random

    random.seed(1)
    expected = random.random()
    random.seed(1)
    sketches.hash_parameters()
    assert random.random() == expected
    assert len(sketches.hash_parameters(7)) == 7


# --- report -----------------------------------------------------------------------------------------------


def test_report_prints_missing_values_and_urgency(spark):
    products = tiny_retail(spark).products
    low = spark.createDataFrame(
        [(1, 5, 2.04, 3, date(2024, 1, 3)), (99, 1500, 1.0, 4, None)],
        "product_id long, current_inventory long, avg_daily_sales double, days_until_stockout int, stockout_date date",
    )
    spoilt = spark.createDataFrame(
        [(2, 0.71234, 4, -1)], "product_id long, anomaly_score double, current_inventory long, days_since_last_transaction long"
    )
    found = {(r["section"], r["product_id"]): r for r in report.inventory_report(low, spoilt, products).collect()}
    one = found["low stock", 1]
    assert (one["avg_sales"], one["date_out"], one["urgent"]) == ("2.0", "2024-01-03", True)
    two = found["low stock", 99]
    assert (two["name"], two["inventory"], two["date_out"], two["urgent"]) == ("Product 99", "1,500", "N/A", False)
    three = found["spoilt", 2]
    assert (three["days_since_sale"], three["anomaly_score"], three["urgent"]) == ("N/A", "0.7123", True)


def test_dashboard_parts(spark, rows):
    board = report.dashboard(tiny_retail(spark))
    assert rows(board.kpis) == [(3, 35, 3, 2)]
    assert board.daily.count() == 3 and board.top_products.first()["product_id"] == 3
    assert rows(board.top_categories) == [("home", 4), ("office", 4)]


def test_spoilage_features_of_unsold_products_are_zero(spark):
    retail = tiny_retail(spark)
    items = retail.items.filter("product_id <> 3")
    sold = Retail(retail.products, retail.inventory, retail.transactions, items, retail.customers).sales()
    found = {r["product_id"]: r for r in spoilage.spoilage_features(sold, retail.inventory, retail.products, ["home", "office"]).collect()}
    assert found[3]["sales_velocity"] == 0 and found[3]["inventory_age"] == 0 and found[3]["category_home"] == 1
    assert found[1]["sales_velocity"] == 1.5 and found[1]["inventory_turnover"] == 0.1
    assert found[1]["days_since_last_transaction"] == -1 and found[1]["inventory_age"] == 0


def test_live_page_datasets(spark, rows):
    items = events(spark, [(i, datetime(2024, 1, 1, 8 + i % 2, i), i % 3, "ab"[i % 2], 1) for i in range(12)])
    panel = report.stream_panel(items, top_n=2, hours=2)
    assert rows(panel.products, "product_id", "count") == [(0, 4), (1, 4)]
    assert rows(panel.categories) == [("a", 6), ("b", 6)]
    assert panel.hourly.agg(F.sum("units")).first()[0] == 12


def test_live_page_lists_all_categories(spark, rows):
    items = events(spark, [(i, datetime(2024, 1, 1, 8, i), i % 3, f"c{i:02}", 1) for i in range(13)])
    assert rows(report.stream_panel(items).categories) == [(f"c{i:02}", 1) for i in range(13)]


def test_period_series_of_some_categories_and_days(spark, rows):
    sold = tiny_retail(spark).sales()
    assert rows(sales.sales_by_period(sold, "day", categories=["home"])) == [("2024-01-02", "home", 4)]
    assert {r["period"] for r in sales.sales_by_period(sold, "day", last_days=1).collect()} == {"2024-01-02"}
    wide = sales.sales_pivot(sales.sales_by_period(sold, "month"), ["office", "home"])
    assert wide.columns == ["period", "home", "office"] and rows(wide) == [("2024-01", 4, 4)]


def test_sketches_take_any_item(spark):
    data = [(9 * 10**15, 10), (9 * 10**15 + 10**6, 7), (None, 5), (9 * 10**15, 1)]
    big = spark.createDataFrame(data, "product_id long, quantity long")
    sketch = sketches.count_min(big, width=1000, depth=5)
    found = {r["product_id"]: r["estimate"] for r in sketches.count_min_estimate(big, sketch, width=1000, depth=5).collect()}
    assert found == {9 * 10**15: 11, 9 * 10**15 + 10**6: 7, None: 5}
    for hashing in ("modular", "mixed"):
        assert sketches.count_min(big.na.drop(), width=10, depth=2, hashing=hashing).agg(F.sum("total")).first()[0] == 36
    assert {(r["item"], r["count"]) for r in sketches.space_saving(big, 5).collect()} == {(9 * 10**15, 11), (9 * 10**15 + 10**6, 7), (None, 5)}
    texts = spark.createDataFrame([("a", 1.5), ("b", 2.25), (None, 0.5), ("a", 1.0), ("", None)], "word string, w double")
    got = sketches.space_saving(texts, 5, "word", "w").collect()
    assert {(r["item"], r["count"], r["error"]) for r in got} == {("a", 2.5, 0.0), ("b", 2.25, 0.0), (None, 0.5, 0.0), ("", 0.0, 0.0)}
    twice = sketches.merge_space_saving(sketches.space_saving(texts, 5, "word", "w"), sketches.space_saving(texts, 5, "word", "w"), 5)
    assert {(r["item"], r["count"]) for r in twice.collect()} == {("a", 5.0), ("b", 4.5), (None, 1.0), ("", 0.0)}


def test_the_bound_on_time_reaches_the_scan(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) , i % 3, 1) for i in range(5)]
    path = str(tmp_path / "lines")
    spark.createDataFrame(rows, "transaction_id long, timestamp timestamp_ntz, product_id long, quantity long").write.parquet(path)
    items = spark.read.parquet(path)
    plans = [
        ticker.product_totals(ticker.since(items, "hour", 12), "hour"), ticker.top_per_period_filled(items, "day", 7), ticker.transaction_rate(items, 5),
    ]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        filters = " ".join(part.split("]")[0] for part in text.split("DataFilters: [")[1:])
        assert "(timestamp#" in filters and ">=" in filters


def test_quantile_leaves_out_what_is_no_number(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "v double")
    assert exact_quantile(df, "v", 0.5) == 2.0


def test_overlapping_promotions_count_once(spark):
    day = datetime(2024, 1, 5)
    sold = spark.createDataFrame([(1, day, 10.0), (1, day, 10.0), (2, day, 4.0), (1, datetime(2024, 3, 1), 10.0)],
                                 "product_id long, transaction_date timestamp_ntz, price_per_unit double")
    spans = [(1, datetime(2024, 1, 1), datetime(2024, 1, 5 + i), 0.9 - i / 100) for i in range(20)]
    promotions = spark.createDataFrame(spans, "product_id long, start_time timestamp_ntz, end_time timestamp_ntz, discount_factor double")
    found = joins.promo_price(sold, promotions).collect()
    assert sorted((r["product_id"], round(r["price"], 6), r["promotion_applied"]) for r in found) == [
        (1, 7.1, True), (1, 7.1, True), (1, 10.0, False), (2, 4.0, False)
    ]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_is_a_join(spark, how):
    from stockloom.functions.skew import hot_join

    table = lambda df: sorted(map(tuple, df.select("k", "v", "w").collect()), key=str)

    left = spark.createDataFrame([(i % 5 if i % 2 else 1, i) for i in range(200)] + [(None, 7), (99, 8)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (50, "e"), (None, "f")], "k long, w string")
    sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for share in (1.0, 0.1, 0.001):
        found = hot_join(left, right, ["k"], sizes, ["v"], how, merge=share == 0.1, share=share)
        assert table(found) == table(left.join(right, "k", how))


def test_caches_are_released(spark):
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = cached()
    bought = graph.co_purchase_graph(lines(spark, [[1, 2], [2, 3, 4], [1, 4]]))
    assert graph.page_rank(bought).count() == 4
    with pytest.raises(RuntimeError):
        graph.page_rank(bought, max_iter=1, tol=0.0)
    assert graph.page_rank(graph.Graph(bought.nodes.filter("false"), bought.edges.filter("false"))).count() == 0
    assert cached() == before


def plain_factors(moments, spans):
    found = {(p, t): [f for q, lo, hi, f in spans if p == q and lo <= t <= hi] for p, t in moments}
    return {k: min(v) for k, v in found.items() if v}


@pytest.mark.parametrize(("width", "few"), [(1, 0), (100, 0), (10_000, 0), (100, 51), (100, 500)])
def test_lowest_factors_against_every_pair(spark, width, few):
    rng = random.Random(width)
    spans = [(rng.randint(1, 3), *sorted((rng.randint(-2000, 2000), rng.randint(-2000, 2000))), rng.randint(1, 99) / 100) for _ in range(150)]
    spans += [(1, 5, 5, 0.01), (2, 7, 3, 0.0), (None, 0, 1000, 0.1)]
    moments = [(rng.randint(1, 4), rng.randint(-2100, 2100)) for _ in range(300)] + [(1, 5), (1, 5), (None, 3), (2, None)]
    found = joins.lowest_factor(
        spark.createDataFrame(moments, "product_id long, t long"), spark.createDataFrame(spans, "product_id long, lo long, hi long, factor double"), width, few
    )
    assert {(r.product_id, r.t): r.factor for r in found.collect()} == plain_factors([m for m in moments if None not in m], spans)


def test_many_spans_of_one_product(spark):
    n, day = 100_000, 86_400_000_000
    spans = spark.range(n).select(
        F.lit(1).cast("long").alias("product_id"), (F.col("id") * 60_000_000).alias("lo"),
        (F.col("id") * 60_000_000 + F.lit(day) * 400).alias("hi"), (1 - F.col("id") / (2 * n)).alias("factor"),
    )
    moments = spark.range(2000).select(F.lit(1).cast("long").alias("product_id"), (F.col("id") * (day // 4)).alias("t"))
    found = {r.t: r.factor for r in joins.lowest_factor(moments, spans).collect()}
    for i in range(2000):
        t = i * day // 4
        last = min(n - 1, t // 60_000_000)  # factors fall, so the last span begun counts, while it lasts
        held = last * 60_000_000 + day * 400 >= t
        assert found.get(t) == (pytest.approx(1 - last / (2 * n)) if held else None)
