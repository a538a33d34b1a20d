"""Frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stockloom.functions.clean import category_or_default, name_or_default
from stockloom.functions.skew import hot_join, shuffle_tasks
from stockloom.session import cut_lineage


def item_support(items: DataFrame) -> DataFrame:
    """Number of transactions that hold each product."""
    lines = items.select("transaction_id", "product_id").distinct()
    return lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("support_count"))


def support_threshold(n_baskets: int, min_support: float) -> int:
    """Least count of a frequent itemset: the share of baskets rounded down, at least 1."""
    return max(int(min_support * n_baskets), 1)


def frequent_baskets(lines: DataFrame, min_count: int) -> DataFrame:
    """Distinct lines as baskets, reduced to products that are frequent on their own.

    No frequent itemset holds another product. It also bounds every basket: with an average
    of m lines per basket, at most m / min_support products can be frequent.
    """
    frequent = (
        lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count).select("product_id")
    )
    return (
        lines.join(frequent, "product_id", "left_semi")
        .groupBy("transaction_id").agg(F.sort_array(F.collect_set("product_id")).alias("items"))
    )


def frequent_itemsets(items: DataFrame, min_support: float = 0.01, max_length: int | None = None) -> DataFrame:
    """Itemsets held by at least ``int(min_support * baskets)`` transactions.

    Columns: items (sorted), k, support_count, n_baskets. Without a length limit FP-growth mines
    them all; with one, sets grow level by level and longer ones are never formed.
    """
    lines = items.select("transaction_id", "product_id").distinct().persist()
    n_baskets = lines.select("transaction_id").distinct().count()
    min_count = support_threshold(n_baskets, min_support)
    baskets = frequent_baskets(lines, min_count)
    if max_length is None:
        sets = _fp_growth(baskets, min_count)
    else:
        sets = _level_wise(baskets, min_count, max_length)
    lines.unpersist()
    return sets.select(
        "items", F.size("items").alias("k"), "support_count",
        F.lit(n_baskets).cast("long").alias("n_baskets"),
    )


def _fp_growth(baskets: DataFrame, min_count: int) -> DataFrame:
    baskets = baskets.persist()
    kept = baskets.count()
    if kept == 0:
        return baskets.select("items", F.lit(0).cast("long").alias("support_count"))
    # The library rounds its threshold up; half a count less lands on min_count exactly.
    growth = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / kept, minConfidence=1.0)
    sets = cut_lineage(
        growth.fit(baskets).freqItemsets.select(
            F.sort_array("items").alias("items"), F.col("freq").alias("support_count")
        )
    )
    baskets.unpersist()
    return sets


def _level_wise(baskets: DataFrame, min_count: int, max_length: int) -> DataFrame:
    """Extend each frequent set found in a basket by the basket's later items, one per level."""
    held = baskets.select("transaction_id", "items", F.explode("items").alias("item"))
    held = held.select(
        "transaction_id", F.array("item").alias("set"),
        F.filter("items", lambda x: x > F.col("item")).alias("later"),
    )
    levels = []
    for k in range(1, max_length + 1):
        counted = held.groupBy("set").agg(F.count(F.lit(1)).alias("support_count"))
        frequent = cut_lineage(counted.filter(F.col("support_count") >= min_count))
        levels.append(frequent)
        if k == max_length or frequent.isEmpty():
            break
        grown = held.join(frequent.select("set"), "set", "left_semi").select(
            "transaction_id", "set", "later", F.explode("later").alias("item")
        )
        # Stored, so that the next level doesn't repeat the levels before it.
        held = cut_lineage(grown.select(
            "transaction_id", F.concat("set", F.array("item")).alias("set"),
            F.filter("later", lambda x: x > F.col("item")).alias("later"),
        ))
    everything = levels[0]
    for level in levels[1:]:
        everything = everything.unionByName(level)
    return everything.select(F.col("set").alias("items"), "support_count")


def association_rules(itemsets: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """All splits of every frequent itemset in two non-empty sides, at or above the confidence.

    Consequents of an itemset grow by one item a round. Moving an item over to the consequent can
    only lower the confidence, so a split that falls short is never grown, and each consequent
    grows from its first items alone, so it is formed once. The counts of both sides are looked up
    among the itemsets: each part of a frequent set is frequent itself, so it is there.
    """
    counts = itemsets.select(F.col("items").alias("side"), F.col("support_count").alias("side_count"))
    side = lambda name: counts.withColumnsRenamed({"side": name, "side_count": f"{name}_count"})
    n = F.col("n_baskets")
    confidence = F.col("support_count") / F.col("antecedent_count")
    columns = ["items", "support_count", "n_baskets", "consequent", "antecedent_count", "antecedent"]

    def confident(splits: DataFrame) -> DataFrame:
        sides = splits.withColumn("antecedent", F.array_except("items", "consequent"))
        return cut_lineage(sides.join(side("antecedent"), "antecedent").filter(confidence >= min_confidence).select(columns))

    longer = itemsets.filter(F.col("k") > 1)
    level = confident(longer.withColumn("consequent", F.explode(F.transform("items", lambda x: F.array(x)))))
    rules = level
    while not level.isEmpty():
        later = F.filter("items", lambda x: x > F.element_at("consequent", -1))
        grown = level.filter(F.size("antecedent") > 1).select("items", "support_count", "n_baskets", "consequent", F.explode(later).alias("item"))
        level = confident(grown.withColumn("consequent", F.concat("consequent", F.array("item"))).drop("item"))
        rules = rules.unionByName(level)
    return rules.join(side("consequent"), "consequent").select(
        "antecedent", "consequent",
        (F.col("support_count") / n).alias("support"),
        confidence.alias("confidence"),
        (confidence / (F.col("consequent_count") / n)).alias("lift"),
        (F.col("antecedent_count") / n).alias("antecedent_support"),
        (F.col("consequent_count") / n).alias("consequent_support"),
    )


def joined(array: str) -> Column:
    """Array as text, for names and labels."""
    return F.array_join(F.col(array).cast("array<string>"), ",")


def named(df: DataFrame, array: str, products: DataFrame, into: str, category_into: str | None = None) -> DataFrame:
    """Add the names of an array of product ids, in the array's order, and if asked their categories;
    unknown ids get defaults.

    Only the distinct arrays are unfolded, and an array is at most a basket's frequent products.
    """
    each = df.select(F.col(array).alias("ids")).distinct().select("ids", F.posexplode("ids").alias("pos", "product_id"))
    info = products.select("product_id", "name", "category" if category_into else F.lit(None).alias("category"))
    found = (
        each.join(info, "product_id", "left")
        .withColumns({"name": name_or_default(F.col("name"), F.col("product_id")), "category": category_or_default(F.col("category"))})
        .groupBy("ids")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "name", "category"))).alias("found"))
        .select(F.col("ids").alias(array), F.col("found.name").alias(into), *([F.col("found.category").alias(category_into)] if category_into else []))
    )
    return df.join(found, array, "left")


def itemsets_named(itemsets: DataFrame, products: DataFrame) -> DataFrame:
    """Itemsets with product names, most frequent first, shorter ones before longer."""
    return named(itemsets, "items", products, "names").orderBy(F.desc("support_count"), "k", "items")


def rules_sorted(rules: DataFrame, by: str = "lift") -> DataFrame:
    """Rules by support, confidence or lift (any other word means lift), best first."""
    measure = by if by in ("support", "confidence") else "lift"
    return rules.orderBy(F.desc(F.round(measure, 12)), "antecedent", "consequent")


def rules_placed(rules: DataFrame, by: str = "lift") -> DataFrame:
    """All rules with ``place``, their number in the order of ``rules_sorted``.

    The order comes from a distributed sort. Its partitions are counted, and each adds the counts
    of those before it, so no task numbers all rules.
    """
    ranked = cut_lineage(rules_sorted(rules, by).withColumns({
        "part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    }))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each task of the sort
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranked.join(F.broadcast(starts), "part").withColumn("place", F.col("place") + F.col("start") + 1).drop("part", "start")


def rules_named(rules: DataFrame, products: DataFrame) -> DataFrame:
    rules = named(rules, "antecedent", products, "antecedent_names")
    return named(rules, "consequent", products, "consequent_names")


def bundles(
    rules: DataFrame, min_lift: float = 1.5, min_confidence: float = 0.5, top_n: int = 10, dedupe: bool = False
) -> DataFrame:
    """The rules with most lift as bundles of both sides, numbered from 1.

    A rule and its mirror give the same bundle twice; ``dedupe`` keeps the better one.
    """
    good = rules.filter((F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence)).select(
        F.sort_array(F.array_union("antecedent", "consequent")).alias("products"),
        "lift", "confidence", "support", "antecedent", "consequent",
    )
    order = [F.desc(F.round("lift", 12)), F.desc(F.round("confidence", 12)), "antecedent", "consequent"]
    if dedupe:
        per_set = W.partitionBy("products").orderBy(*order)
        good = good.withColumn("nth", F.row_number().over(per_set)).filter("nth = 1").drop("nth")
    # The limit comes first: the numbering pass sees top_n rows.
    return good.orderBy(*order).limit(top_n).withColumn("id", F.row_number().over(W.orderBy(*order)))


def bundles_named(found: DataFrame, products: DataFrame) -> DataFrame:
    """Bundles with the names and categories of their products."""
    return named(found, "products", products, "names", "categories")


def _by_probe(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with ``probe``: the product of the antecedent that is bought least."""
    rarest = (
        rules.select("antecedent", F.explode("antecedent").alias("product_id")).distinct()
        .join(item_support(lines), "product_id", "left")
        .groupBy("antecedent").agg(F.min(F.struct(F.coalesce("support_count", F.lit(0)), "product_id")).alias("m"))
        .select("antecedent", F.col("m.product_id").alias("probe"))
    )
    return rules.join(rarest, "antecedent")


def _useful_baskets(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Baskets reduced to products that occur in rules, which bounds them by their number.

    They are laid out by transaction in a stated number of tasks, as few bytes unfold to many rows
    later; the grouping takes that layout as it is.
    """
    used = rules.select(F.explode(F.concat("antecedent", "consequent")).alias("product_id")).distinct()
    return (
        lines.select("transaction_id", "product_id")
        .join(used, "product_id", "left_semi")
        .repartition(shuffle_tasks(lines.sparkSession), "transaction_id")
        .groupBy("transaction_id").agg(F.collect_set("product_id").alias("basket"))
    )


def _held_by(baskets: DataFrame, keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """Join each basket with the rules whose antecedent it holds: one equi-join on the probe,
    the rest of the antecedent is checked in place. No basket is paired with all rules, and the
    baskets of a best seller are dealt over several tasks."""
    holds = (F.size("antecedent") == 1) | (F.size(F.array_except("antecedent", "basket")) == 0)
    probes = baskets.select("transaction_id", "basket", F.explode("basket").alias("probe"))
    sizes = cut_lineage(item_support(lines).select(F.col("product_id").alias("probe"), F.col("support_count").alias("n")))
    return hot_join(probes, keyed, ["probe"], sizes, ["transaction_id"]).filter(holds).drop("probe")


def applicable_rules(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (transaction, rule) whose antecedent the transaction's basket holds."""
    rules = cut_lineage(rules.select("antecedent", "consequent", "support", "confidence", "lift"))
    return _held_by(_useful_baskets(lines, rules), cut_lineage(_by_probe(lines, rules)), lines)


def rule_recommendations(lines: DataFrame, rules: DataFrame, top_n: int = 5) -> DataFrame:
    """For every basket the new products its rules point to, each by its best rule.

    Best is most lift; ties go to more confidence, then to the smaller product, then to the
    antecedent first in order. That order is numbered once on the rules, so that baskets only
    compare whole numbers.
    """
    rules = cut_lineage(rules.select("antecedent", "consequent", "confidence", "lift"))
    offers = (
        rules.select(
            "antecedent", F.explode("consequent").alias("product_id"),
            F.round("lift", 12).alias("score"), F.round("confidence", 12).alias("confidence"),
        )
        .groupBy("antecedent", "product_id")
        .agg(F.max(F.struct("score", "confidence")).alias("best"))
        .select("antecedent", "product_id", "best.*")
        .orderBy(F.desc("score"), F.desc("confidence"), "product_id", "antecedent")
        .withColumn("place", F.monotonically_increasing_id())
    )
    offers = cut_lineage(offers)
    keyed = cut_lineage(_by_probe(lines, offers.select("antecedent", "product_id", "place")))
    candidates = _held_by(_useful_baskets(lines, rules), keyed, lines).filter(
        ~F.array_contains("basket", F.col("product_id"))
    )
    best = candidates.groupBy("transaction_id", "product_id").agg(F.min("place").alias("place"))
    order = W.partitionBy("transaction_id").orderBy("place")
    top = best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top_n)
    return top.join(offers.drop("product_id"), "place").select(
        "transaction_id", "product_id", "score", "confidence", "antecedent", "position"
    )


def rules_chart(rules: DataFrame, top_n: int = 10) -> DataFrame:
    """The rules with most lift with a text label, as a chart needs them."""
    return rules_sorted(rules).limit(top_n).select(
        F.concat(
            F.array_join(F.col("antecedent").cast("array<string>"), ", "), F.lit(" → "),
            F.array_join(F.col("consequent").cast("array<string>"), ", "),
        ).alias("label"),
        "lift", "support", "confidence",
    )


def rules_display(rules: DataFrame, products: DataFrame) -> DataFrame:
    """Rules as shown to people: names joined, measures as text."""
    text = lambda c, places: F.format_string(f"%.{places}f", F.round(F.round(c, 12), places))
    return rules_named(rules, products).select(
        F.array_join("antecedent_names", ", ").alias("if_buy"),
        F.array_join("consequent_names", ", ").alias("then_buy"),
        text("support", 4).alias("support"), text("confidence", 4).alias("confidence"),
        text("lift", 2).alias("lift"),
    )
