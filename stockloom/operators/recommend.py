"""Product recommendations, for all products or baskets at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from stockloom.functions.skew import big_keys, hot_join, shuffle_tasks
from stockloom.functions.ties import tie_key
from stockloom.operators.graph import pairs_of_big, with_product_info
from stockloom.session import cut_lineage


def _best(df: DataFrame, key: str, score: str, top_n: int) -> DataFrame:
    """The rows of greatest score per key; ties go to the smaller product id."""
    order = W.partitionBy(key).orderBy(F.desc("tie_key"), "product_id")
    return (
        df.withColumn("tie_key", tie_key(F.col(score)))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= top_n).drop("tie_key")
    )


def collaborative(edges: DataFrame, ranks: DataFrame, top_n: int = 5) -> DataFrame:
    """Per product the neighbours with the greatest weight * rank."""
    scored = edges.join(ranks.withColumnRenamed("product_id", "dst"), "dst").select(
        F.col("src").alias("for_product"), F.col("dst").alias("product_id"), "weight", "rank",
        (F.col("weight") * F.col("rank")).alias("score"),
    )
    return _best(scored, "for_product", "score", top_n)


def collaborative_of_lines(items: DataFrame, ranks: DataFrame, top_n: int = 5, max_basket: int = 1000) -> DataFrame:
    """``collaborative`` from the lines: a line brings its product's rank along, and pairs, in both directions, are
    laid out once by product. There they are counted and the best kept, so no edge is stored, joined or sorted apart.
    """
    lines = items.select("transaction_id", "product_id").filter("transaction_id is not null and product_id is not null")
    big = big_keys(lines, "transaction_id", max_basket)
    parted = None
    if not big.isEmpty():
        found = pairs_of_big(lines.join(big, "transaction_id").distinct())
        rank = lambda side: ranks.select(F.col("product_id").alias(side), F.col("rank").alias(f"rank_{side}"))
        parted = found.join(rank("a"), "a").join(rank("b"), "b").select("a", "b", "rank_a", "rank_b")
        lines = lines.join(big, "transaction_id", "left_anti")
    pairs = (
        lines.join(ranks.select("product_id", "rank"), "product_id")
        .groupBy("transaction_id").agg(F.sort_array(F.collect_set(F.struct("product_id", "rank"))).alias("basket"))
        .filter(F.size("basket") > 1)
        .select("basket", F.posexplode("basket").alias("pos", "x"))
        .select("x", F.explode(F.slice("basket", F.col("pos") + 2, F.size("basket"))).alias("y"))
        .select(F.col("x.product_id").alias("a"), F.col("y.product_id").alias("b"), F.col("x.rank").alias("rank_a"), F.col("y.rank").alias("rank_b"))
    )
    pairs = pairs if parted is None else pairs.unionByName(parted)
    both = F.array(*[F.struct(F.col(x).alias("for_product"), F.col(y).alias("product_id"), F.col(f"rank_{y}").alias("rank")) for x, y in (("a", "b"), ("b", "a"))])
    laid_out = pairs.select(F.inline(both)).repartition(shuffle_tasks(items.sparkSession), "for_product")
    weights = laid_out.groupBy("for_product", "product_id").agg(F.count(F.lit(1)).alias("weight"), F.max("rank").alias("rank"))
    return _best(weights.withColumn("score", F.col("weight") * F.col("rank")), "for_product", "score", top_n)


def hybrid(
    collab: DataFrame, content: DataFrame, top_n: int = 5, collaborative_weight: float = 0.7
) -> DataFrame:
    """Weighted sum of both scores; a product that one side does not name scores 0 there.

    Give both sides ``2 * top_n`` candidates per product.
    """
    left = collab.select("for_product", "product_id", F.col("score").alias("collaborative_score"))
    right = content.select(
        F.col("product_id").alias("for_product"), F.col("other_id").alias("product_id"),
        F.col("similarity").alias("content_score"),
    )
    both = left.join(right, ["for_product", "product_id"], "full_outer").na.fill(
        0.0, ["collaborative_score", "content_score"]
    )
    scored = both.withColumn(
        "hybrid_score",
        F.col("collaborative_score") * collaborative_weight + F.col("content_score") * (1.0 - collaborative_weight),
    )
    return _best(scored, "for_product", "hybrid_score", top_n)


def for_baskets(
    lines: DataFrame, collab: DataFrame, top_n: int = 5, max_basket: int = 100_000, few_products: int = 50_000
) -> DataFrame:
    """Per basket the products with the greatest summed score over its items, its own left out.

    Give ``collab`` 2 * top_n candidates per product. Every line unfolds the offers of its
    product and a mark of its own, so that one grouped sum replaces an anti-join. Offers of few products
    (``few_products``) are small enough to be broadcast: lines are laid out by transaction first, and offers, ten times as
    many, need no shuffle. Of more products a line fetches its offers as arrays (the lines of a best seller are dealt
    over several tasks), and rows of arrays are laid out by transaction. There a basket is one row of arrays, which are
    summed and ranked many baskets at a time: no offer is a row of Spark's own. Only with
    a transaction too big for a task offers unfold to rows, and the sums are spread by product as well.
    """
    held = lines.select("transaction_id", "product_id")
    tasks = shuffle_tasks(lines.sparkSession)
    whole = big_keys(held, "transaction_id", max_basket).isEmpty()
    if whole:
        held = held.repartition(tasks, "transaction_id")
    offers = collab.groupBy("for_product").agg(F.collect_list(F.struct("product_id", "score")).alias("offers"))
    offers = offers.select(F.col("for_product").alias("product_id"), F.col("offers.product_id").alias("ids"), F.col("offers.score").alias("scores"))
    held = held.distinct()
    sizes = cut_lineage(held.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")))
    fetched = hot_join(held, offers, ["product_id"], sizes, ["transaction_id"], "left")
    if whole and sizes.count() > few_products:
        fetched = fetched.repartition(tasks, "transaction_id")
    if whole:
        kinds = [collab.schema["product_id"].dataType.simpleString(), held.schema["transaction_id"].dataType.simpleString()]
        baskets = fetched.filter("product_id is not null").groupBy("transaction_id").agg(
            F.collect_list(F.col("product_id").cast(kinds[0])).alias("own"), F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"),
        )

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 5000):
                    yield _best_offers(batch.slice(low, 5000), top_n)

        return baskets.mapInArrow(best, f"transaction_id {kinds[1]}, product_id {kinds[0]}, score double, position int")
    offered = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct(x["ids"].alias("product_id"), x["scores"].alias("score"), F.lit(False).alias("own")))
    own = F.array(F.struct("product_id", F.lit(0.0).alias("score"), F.lit(True).alias("own")))
    scored = (
        fetched.select("transaction_id", F.inline(F.when(F.col("ids").isNull(), own).otherwise(F.concat(offered, own))))
        .groupBy("transaction_id", "product_id")
        .agg(F.sum("score").alias("score"), F.max("own").alias("own"))
        .filter(~F.col("own")).drop("own")
    )
    return _best(scored, "transaction_id", "score", top_n)


def _best_offers(baskets: pa.RecordBatch, top_n: int) -> pa.RecordBatch:
    """Per basket (own, ids, scores) the products of greatest summed score but its own, as ``_best`` orders them."""
    lists = [baskets.column(c) for c in ("own", "ids")]
    products = pa.concat_arrays([x.flatten() for x in lists])
    basket = np.concatenate([np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in lists])
    n = len(lists[0].flatten())
    scores = np.concatenate([np.zeros(n), baskets.column("scores").flatten().to_numpy(zero_copy_only=False)])
    ranks = products if pa.types.is_integer(products.type) else pc.rank(products, tiebreaker="dense")
    ranks = ranks.to_numpy(zero_copy_only=False).astype(np.int64)
    low, span = (int(ranks.min()), int(ranks.max()) - int(ranks.min()) + 1) if len(ranks) else (0, 1)
    if span * len(lists[0]) >= 1 << 62:
        ranks, low, span = np.unique(ranks, return_inverse=True)[1], 0, len(ranks)
    key = basket * span + (ranks - low)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    basket, total = basket[order][first], np.add.reduceat(scores[order], first)
    new = ~np.logical_or.reduceat(order < n, first)
    at, basket, total = order[first][new], basket[new], total[new]
    order = np.lexsort((-np.rint(total * 1e12), basket))  # products of a basket are in order, so ties go to the smaller id
    starts = np.flatnonzero(np.diff(basket, prepend=-1))  # each basket's rows stay where they were
    position = np.arange(len(basket)) - np.repeat(starts, np.diff(starts, append=len(basket))) + 1
    best = position <= top_n
    kept = order[best]
    columns = [baskets.column("transaction_id").take(pa.array(basket[best])), products.take(pa.array(at[kept])), pa.array(total[kept]), pa.array(position[best], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["transaction_id", "product_id", "score", "position"])


def by_category(ranks: DataFrame, products: DataFrame, top_n: int = 5) -> DataFrame:
    """Per category the products of highest rank."""
    return _best(with_product_info(ranks, products), "category", "rank", top_n)


def chart_score(df: DataFrame) -> DataFrame:
    """Add ``chart_score``: the first measure the row has, else 1."""
    known = [c for c in ("hybrid_score", "score", "similarity", "rank") if c in df.columns]
    return df.withColumn("chart_score", F.coalesce(*[F.col(c) for c in known], F.lit(1.0)))
