"""Frequent itemsets, rules and rule-based recommendations, at supplier grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockloom.operators import mining
from stockloom.operators.graph import with_product_info
from stockloom.plans.registry import query, with_info
from stockloom.sources.tables import open_retail

MIN_SUPPORT = 0.004
MIN_CONFIDENCE = 0.1


def text(column: str | Column) -> Column:
    """Array as comma-separated text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), ",")


# Frequent sets of up to four suppliers; at this support there are no larger ones.
_SETS = f"""
b AS (SELECT DISTINCT transaction_id AS t, product_id AS p FROM brand_items),
n AS (SELECT count(DISTINCT transaction_id) AS n FROM brand_items),
least_count AS (SELECT greatest(CAST(floor({MIN_SUPPORT} * n) AS BIGINT), 1) AS c FROM n),
f1 AS (SELECT [p] AS items, count(*) AS support_count FROM b GROUP BY p HAVING count(*) >= (SELECT c FROM least_count)),
f2 AS (SELECT [b1.p, b2.p] AS items, count(*) AS support_count FROM b b1 JOIN b b2 ON b1.t = b2.t AND b1.p < b2.p
  GROUP BY b1.p, b2.p HAVING count(*) >= (SELECT c FROM least_count)),
f3 AS (SELECT [b1.p, b2.p, b3.p] AS items, count(*) AS support_count
  FROM b b1 JOIN b b2 ON b1.t = b2.t AND b1.p < b2.p JOIN b b3 ON b1.t = b3.t AND b2.p < b3.p
  GROUP BY b1.p, b2.p, b3.p HAVING count(*) >= (SELECT c FROM least_count)),
f4 AS (SELECT [b1.p, b2.p, b3.p, b4.p] AS items, count(*) AS support_count
  FROM b b1 JOIN b b2 ON b1.t = b2.t AND b1.p < b2.p JOIN b b3 ON b1.t = b3.t AND b2.p < b3.p
  JOIN b b4 ON b1.t = b4.t AND b3.p < b4.p
  GROUP BY b1.p, b2.p, b3.p, b4.p HAVING count(*) >= (SELECT c FROM least_count)),
sets AS MATERIALIZED (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4)"""

_RULES = f"""{_SETS},
splits AS (
  SELECT items, support_count, m,
         list_filter(items, lambda x: (m >> (list_position(items, x) - 1)) & 1 = 1) AS antecedent,
         list_filter(items, lambda x: (m >> (list_position(items, x) - 1)) & 1 = 0) AS consequent
  FROM sets, range(1, 15) r(m) WHERE len(items) > 1 AND m < (1 << len(items)) - 1),
rules AS MATERIALIZED (
  SELECT s.antecedent, s.consequent, s.support_count / n.n AS support,
         s.support_count / a.support_count AS confidence,
         (s.support_count / a.support_count) / (c.support_count / n.n) AS lift,
         a.support_count / n.n AS antecedent_support, c.support_count / n.n AS consequent_support
  FROM splits s JOIN sets a ON a.items = s.antecedent JOIN sets c ON c.items = s.consequent, n
  WHERE s.support_count / a.support_count >= {MIN_CONFIDENCE})"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return open_retail(spark, folder).by_supplier().items


def itemsets(spark: SparkSession, folder: str) -> DataFrame:
    return mining.frequent_itemsets(lines(spark, folder), MIN_SUPPORT)


def rules(spark: SparkSession, folder: str) -> DataFrame:
    return mining.association_rules(itemsets(spark, folder), MIN_CONFIDENCE)


@query("item_support", "SELECT product_id, count(DISTINCT transaction_id) AS support_count FROM items GROUP BY 1")
def item_support(spark: SparkSession, folder: str) -> DataFrame:
    return mining.item_support(open_retail(spark, folder).items)


@query("frequent_itemsets", f"""WITH {_SETS.strip()}
SELECT array_to_string(items, ',') AS items, CAST(len(items) AS INTEGER) AS k, support_count,
       (SELECT n FROM n) AS n_baskets FROM sets""")
def frequent_itemsets(spark: SparkSession, folder: str) -> DataFrame:
    return itemsets(spark, folder).withColumn("items", text("items"))


@query("frequent_pairs", f"""WITH {_SETS.strip()}
SELECT array_to_string(items, ',') AS items, CAST(len(items) AS INTEGER) AS k, support_count,
       (SELECT n FROM n) AS n_baskets FROM sets WHERE len(items) <= 2""")
def frequent_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return mining.frequent_itemsets(lines(spark, folder), MIN_SUPPORT, max_length=2).withColumn("items", text("items"))


@query("association_rules", f"""WITH {_RULES.strip()}
SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
       round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift,
       round(antecedent_support, 6) AS antecedent_support, round(consequent_support, 6) AS consequent_support
FROM rules""")
def association_rules(spark: SparkSession, folder: str) -> DataFrame:
    measures = ["support", "confidence", "lift", "antecedent_support", "consequent_support"]
    return rules(spark, folder).select(
        text("antecedent").alias("antecedent"), text("consequent").alias("consequent"),
        *[F.round(m, 6).alias(m) for m in measures],
    )


@query("itemsets_named", f"""WITH {_SETS.strip()}
SELECT array_to_string(items, ',') AS items, CAST(len(items) AS INTEGER) AS k, support_count,
       array_to_string(list_transform(items, lambda x: 'Brand#' || x), ',') AS names FROM sets""")
def itemsets_named(spark: SparkSession, folder: str) -> DataFrame:
    products = open_retail(spark, folder).by_supplier().products
    found = mining.itemsets_named(itemsets(spark, folder), products)
    return found.select(text("items").alias("items"), "k", "support_count", text("names").alias("names"))


@query("rules_sorted", f"""WITH {_RULES.strip()}
SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
       array_to_string(list_transform(antecedent, lambda x: 'Brand#' || x), ',') AS antecedent_names,
       array_to_string(list_transform(consequent, lambda x: 'Brand#' || x), ',') AS consequent_names,
       round(lift, 6) AS lift, CAST(row_number() OVER (ORDER BY round(lift, 12) DESC, antecedent, consequent) AS BIGINT) AS place
FROM rules""")
def rules_sorted(spark: SparkSession, folder: str) -> DataFrame:
    products = open_retail(spark, folder).by_supplier().products
    columns = ["antecedent", "consequent", "antecedent_names", "consequent_names"]
    return mining.rules_placed(mining.rules_named(rules(spark, folder), products), "lift").select(
        *[text(c).alias(c) for c in columns], F.round("lift", 6).alias("lift"), "place"
    )


@query("bundles", f"""WITH {_RULES.strip()},
top AS (
  SELECT CAST(row_number() OVER (ORDER BY round(lift, 12) DESC, round(confidence, 12) DESC, antecedent, consequent) AS INTEGER) AS id,
         list_sort(list_concat(antecedent, consequent)) AS products, lift, confidence, support
  FROM rules WHERE lift >= 1.02 AND confidence >= 0.12 ORDER BY id LIMIT 10)
SELECT t.id, string_agg(b.product_id, ',' ORDER BY b.product_id) AS products, string_agg(b.name, ',' ORDER BY b.product_id) AS names,
       string_agg(b.category, ',' ORDER BY b.product_id) AS categories,
       round(t.lift, 6) AS lift, round(t.confidence, 6) AS confidence, round(t.support, 6) AS support
FROM top t JOIN brands b ON list_contains(t.products, b.product_id) GROUP BY t.id, t.lift, t.confidence, t.support""")
def bundles(spark: SparkSession, folder: str) -> DataFrame:
    sold = open_retail(spark, folder).by_supplier().products
    found = mining.bundles_named(mining.bundles(rules(spark, folder), min_lift=1.02, min_confidence=0.12, top_n=10), sold)
    return found.select(
        "id", *[text(c).alias(c) for c in ("products", "names", "categories")], *[F.round(m, 6).alias(m) for m in ("lift", "confidence", "support")]
    )


_HELD = """
held AS (SELECT transaction_id, list_sort(list(DISTINCT product_id)) AS basket FROM brand_items GROUP BY 1)"""


@query("containment_join", f"""WITH {_RULES.strip()},{_HELD}
SELECT h.transaction_id, CAST(count(*) AS BIGINT) AS rules, round(max(r.lift), 6) AS best_lift
FROM held h JOIN rules r ON list_has_all(h.basket, r.antecedent) GROUP BY 1""")
def containment_join(spark: SparkSession, folder: str) -> DataFrame:
    found = mining.applicable_rules(lines(spark, folder), rules(spark, folder))
    return found.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("rules"), F.round(F.max("lift"), 6).alias("best_lift")
    )


@query("rule_recs", with_info(f"""WITH {_RULES.strip()},{_HELD},
new_items AS (
  SELECT h.transaction_id, unnest(list_filter(r.consequent, lambda x: NOT list_contains(h.basket, x))) AS product_id,
         round(r.lift, 12) AS score, round(r.confidence, 12) AS confidence, r.antecedent
  FROM held h JOIN rules r ON list_has_all(h.basket, r.antecedent)),
best AS (
  SELECT * FROM new_items
  QUALIFY row_number() OVER (PARTITION BY transaction_id, product_id ORDER BY score DESC, confidence DESC, antecedent) = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY score DESC, confidence DESC, product_id) AS position FROM best)
SELECT transaction_id, product_id, round(score, 6) AS score, round(confidence, 6) AS confidence,
       array_to_string(antecedent, ',') AS antecedent, CAST(position AS INTEGER) AS position
FROM placed WHERE position <= 3""", table="brands"))
def rule_recs(spark: SparkSession, folder: str) -> DataFrame:
    retail = open_retail(spark, folder).by_supplier()
    found = with_product_info(mining.rule_recommendations(retail.items, rules(spark, folder), top_n=3), retail.products)
    return found.select(
        "transaction_id", "product_id", "name", "category", F.round("score", 6).alias("score"),
        F.round("confidence", 6).alias("confidence"), text("antecedent").alias("antecedent"), "position",
    )


@query("rules_display", f"""WITH {_RULES.strip()}
SELECT array_to_string(list_transform(antecedent, lambda x: 'Brand#' || x), ', ') AS if_buy,
       array_to_string(list_transform(consequent, lambda x: 'Brand#' || x), ', ') AS then_buy,
       printf('%.4f', round(round(support, 12), 4)) AS support, printf('%.4f', round(round(confidence, 12), 4)) AS confidence,
       printf('%.2f', round(round(lift, 12), 2)) AS lift
FROM rules""")
def rules_display(spark: SparkSession, folder: str) -> DataFrame:
    products = open_retail(spark, folder).by_supplier().products
    return mining.rules_display(rules(spark, folder), products)


@query("rules_chart", f"""WITH {_RULES.strip()}
SELECT array_to_string(antecedent, ', ') || ' → ' || array_to_string(consequent, ', ') AS label,
       round(lift, 6) AS lift, round(support, 6) AS support, round(confidence, 6) AS confidence
FROM rules ORDER BY round(rules.lift, 12) DESC, rules.antecedent, rules.consequent LIMIT 10""")
def rules_chart(spark: SparkSession, folder: str) -> DataFrame:
    found = mining.rules_chart(rules(spark, folder), 10)
    return found.select("label", *[F.round(m, 6).alias(m) for m in ("lift", "support", "confidence")])
