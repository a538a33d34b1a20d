"""Forms of the operators that scale give what the plain ones give."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockloom.operators import close, graph, recommend, similarity, spoilage
from stockloom.plans import series_queries


def baskets(spark, n=300, products=40, seed=5):
    rng = random.Random(seed)
    rows = [(t, rng.choice(range(products))) for t in range(n) for _ in range(rng.randint(1, 6))]
    rows += [(n, 77), (n, 77), (n + 1, 78)]  # a product with itself only, and one alone
    return spark.createDataFrame(rows, "transaction_id long, product_id long")


def test_copies_are_a_class_and_not_pairs(spark):
    texts = [(i, "red apple pie") for i in range(200)] + [(200, "pie apple red"), (201, "red apple pie pie"), (202, "stone"), (203, "the"), (204, None), (None, "stone")]
    found = similarity.similar_classes(spark.createDataFrame(texts, "id long, text string"), 0.8).collect()
    members = {r["other_id"]: r["id"] for r in found if r["kind"] == "member"}
    assert members == {**{i: 0 for i in range(201)}, 201: 201, 202: 202}
    assert [(r["id"], r["other_id"]) for r in found if r["kind"] == "pair"] == [(0, 201)]
    assert len(found) == 204


def test_classes_of_products_lose_no_close_pair(spark):
    rng = random.Random(2)
    texts = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=3) + ["xx", "yy", rng.choice(["zz", "ww"])])) for i in range(60)] * 1, "id long, text string")
    texts = texts.withColumn("text", F.regexp_replace("text", r"\b([a-h])\b", "$1$1"))
    every = {(r["product_id"], r["other_id"]) for r in similarity.cosine_pairs(similarity.tfidf(texts)).collect() if r["similarity"] >= 0.95 and r["product_id"] < r["other_id"]}
    rows = similarity.similar_classes(texts, 0.95).collect()
    of = {r["other_id"]: r["id"] for r in rows if r["kind"] == "member"}
    close = {(r["id"], r["other_id"]) for r in rows if r["kind"] == "pair"}
    told = {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or tuple(sorted((of[a], of[b]))) in close)}
    assert told == every and len(every) > 3


@pytest.mark.parametrize("most", [1000, 3])
def test_copies_are_in_all_pairs_of_close_texts(spark, most):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["red", "apple", "pie", "stone"], k=rng.randint(1, 6)))) for i in range(70)]
    texts = spark.createDataFrame(texts + [(70, "the"), (71, None), (72, "alone"), (None, "red")], "id long, text string")
    cosines = similarity.cosine_pairs(similarity.tfidf(texts).filter("id is not null")).collect()
    every = sorted((r["product_id"], r["other_id"], r["similarity"]) for r in cosines if r["product_id"] < r["other_id"] and r["similarity"] >= 0.8)
    classes = similarity.similar_classes(texts, 0.8, common_words=2, max_vectors=9)
    found = similarity.every_pair(classes, most)
    assert sorted((r["id"], r["other_id"], r["similarity"]) for r in found.filter("kind = 'pair'").collect()) == every
    rows = lambda df: sorted((r["id"], r["other_id"]) for r in df.filter("kind = 'member'").collect())
    assert rows(found) == rows(classes) and [b for _, b in sorted(rows(found), key=lambda x: x[1])] == [*range(70), 72]
    assert classes.filter("kind = 'pair'").count() < len(every)


def test_blocks_of_vectors_are_not_shuffled(spark, capsys):
    texts = spark.createDataFrame([(i, f"alpha beta w{i % 9} w{i % 7}") for i in range(60)], "id long, text string")
    found = similarity.similar_pairs(similarity.tfidf(texts), 0.8, 10)
    found.explain("formatted")
    assert "Exchange" not in capsys.readouterr().out  # pairs were stored block by block
    assert found.count() == found.distinct().count() > 0


@pytest.mark.parametrize(("common", "rows", "most"), [(512, 64, 2_000_000), (3, 2, 10), (40, 5, 100)])
def test_bounds_lose_no_close_pair(monkeypatch, common, rows, most):
    for name, value in (("COMMON", common), ("ROWS", rows), ("MOST", most)):
        monkeypatch.setattr(close, name, value)
    rng = np.random.default_rng(3)
    weights = rng.random((60, 40)) * (rng.random((60, 40)) < rng.random((60, 1))) * rng.random(40) ** 3
    weights = np.concatenate([weights, weights[:20] * rng.uniform(0.6, 1.4, (20, 40))])
    weights = weights[(weights > 0).any(1)]
    weights /= np.sqrt((weights**2).sum(1, keepdims=True))
    side = lambda at: close.vectors(pa.array(at), *(pa.array([list(x) for x in y]) for y in ([np.flatnonzero(weights[k]) for k in at], [weights[k][weights[k] > 0] for k in at])), 40, 0, None)
    cosines = np.rint(weights @ weights.T * 1e9) / 1e9
    own, block = np.arange(len(weights) - 20), np.arange(len(weights) - 20, len(weights))
    for threshold in (0.2, 0.8, 0.95):
        x, y, similarity = close.close_pairs(side(own), side(block), threshold)
        want = cosines[np.ix_(own, block)] >= threshold
        assert sorted(zip(x.tolist(), y.tolist())) == [tuple(p) for p in np.argwhere(want).tolist()]
        assert np.allclose(similarity, cosines[own[x], block[y]], atol=2e-9, rtol=0) and len(x)


def test_words_that_are_not_broadcast_weigh_the_same(spark):
    texts = spark.createDataFrame([(i, f"alpha beta w{i} w{i % 3}") for i in range(30)] + [(None, "alpha")], "id long, text string")
    terms = similarity.count_terms(texts)
    weights = lambda n: sorted((str(r["id"]), r["token"], round(r["weight"], 12)) for r in similarity.weigh(terms, F.lit(31), n).collect())
    assert weights(3) == weights(1000) and len(weights(3)) == 1 + sum(4 for _ in range(30)) - 3


def test_ranks_of_lines_equal_ranks_of_the_graph(spark):
    items = baskets(spark)
    plain = {r["product_id"]: r["rank"] for r in graph.page_rank(graph.co_purchase_graph(items)).collect()}
    for most in (100_000, 7):
        found = {r["product_id"]: r["rank"] for r in graph.page_rank_of_lines(items, max_fan_out=most).collect()}
        assert found.keys() == plain.keys() and all(abs(found[p] - plain[p]) < 1e-12 for p in plain)
    assert 77 in plain and 78 not in plain
    assert graph.page_rank_of_lines(items.filter("product_id < 0")).count() == 0


def test_neighbours_from_lines_equal_those_from_edges(spark):
    items = baskets(spark)
    ranks = graph.page_rank_of_lines(items)
    key = lambda df: sorted((r["for_product"], r["position"], r["product_id"], r["weight"], round(r["score"], 12)) for r in df.collect())
    want = key(recommend.collaborative(graph.co_purchase_graph(items).edges, ranks, 4))
    assert key(recommend.collaborative_of_lines(items, ranks, 4)) == want
    assert key(recommend.collaborative_of_lines(items, ranks, 4, max_basket=3)) == want


def test_offers_laid_out_after_they_are_fetched_are_the_same(spark):
    items = baskets(spark)
    collab = recommend.collaborative_of_lines(items, graph.page_rank_of_lines(items), 4)
    few, many = (sorted(tuple(r) for r in recommend.for_baskets(items, collab, 3, few_products=n).withColumn("score", F.round("score", 12)).collect()) for n in (1000, 0))
    assert few == many and few


@pytest.mark.parametrize("kind", ["long", "string"])
def test_offers_summed_in_arrays_equal_those_summed_in_rows(spark, capsys, kind):
    rng = random.Random(8)
    items = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9), 2**62, -(2**62)])) for _ in range(150)] + [(90, None), (91, 777)]
    items = spark.createDataFrame(items, "transaction_id long, product_id long").withColumn("product_id", F.col("product_id").cast(kind))
    pairs = [(a, b, rng.choice([0.25, 0.5, 1.0])) for a in (*range(9), 2**62) for b in (*range(9), 2**62, -(2**62)) if a != b]
    collab = spark.createDataFrame(pairs, "for_product long, product_id long, score double").withColumns({c: F.col(c).cast(kind) for c in ("for_product", "product_id")})
    found = recommend.for_baskets(items, collab, 3)
    key = lambda df: sorted((str(r["transaction_id"]), r["position"], r["product_id"], round(r["score"], 12)) for r in df.collect())
    assert key(found) == key(recommend.for_baskets(items, collab, 3, max_basket=1)) and found.count() > 100
    found.explain("formatted")
    assert "Window" not in capsys.readouterr().out  # offers are not sorted as rows


def test_forecasts_read_the_lines_once(spark, capsys):
    dated, _ = series_queries.brand_sales(spark, "/root/testdata/sf0.001")
    dated.explain("formatted")
    assert "lineitem.parquet" not in capsys.readouterr().out
    assert dated.groupBy("product_id", "transaction_date").count().filter("count > 1").isEmpty()


def test_spoilage_features_read_the_sales_once(spark, capsys):
    from stockloom.plans.sales_queries import sold_lines
    from stockloom.sources.tables import open_retail

    retail = open_retail(spark, "/root/testdata/sf0.001")
    spoilage.spoilage_features(sold_lines(spark, "/root/testdata/sf0.001"), retail.inventory).explain("formatted")
    assert "lineitem.parquet" not in capsys.readouterr().out  # one stored row per product is left
