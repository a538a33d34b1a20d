"""The co-purchase graph and PageRank on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stockloom.functions.clean import category_or_default, name_or_default
from stockloom.functions.skew import big_keys
from stockloom.session import cut_lineage


@dataclass(frozen=True)
class Graph:
    """``nodes``: product_id. ``edges``: src, dst, weight, both directions."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class RankedGraph:
    """A graph with the ranks of its nodes, to be kept together."""

    graph: Graph
    ranks: DataFrame

    def save(self, spark: SparkSession, path: str) -> str:
        for name, table in (("nodes", self.graph.nodes), ("edges", self.graph.edges), ("ranks", self.ranks)):
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "RankedGraph":
        nodes, edges, ranks = (spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "ranks"))
        return RankedGraph(Graph(nodes, edges), ranks)


def pair_counts(items: DataFrame, max_basket: int = 1000) -> DataFrame:
    """Pairs a < b of products and the number of transactions that hold both.

    Usual baskets unfold their pairs in place, after one shuffle by transaction; counts combine
    before the second. A basket of more than ``max_basket`` lines is cut into parts and its
    pairs come from a join over all pairs of parts, so that no task meets it whole.
    """
    lines = items.select("transaction_id", "product_id")
    big = big_keys(lines, "transaction_id", max_basket)
    pairs = None
    if not big.isEmpty():
        pairs = pairs_of_big(lines.join(big, "transaction_id").distinct())
        lines = lines.join(big, "transaction_id", "left_anti")
    usual = (
        lines.groupBy("transaction_id").agg(F.sort_array(F.collect_set("product_id")).alias("basket"))
        .filter(F.size("basket") > 1)
        .select("basket", F.posexplode("basket").alias("pos", "a"))
        .select("a", F.explode(F.slice("basket", F.col("pos") + 2, F.size("basket"))).alias("b"))
    )
    pairs = usual if pairs is None else usual.unionByName(pairs)
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def pairs_of_big(lines: DataFrame) -> DataFrame:
    lines = lines.withColumn("part", F.pmod(F.xxhash64("product_id"), F.col("parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = lines.select(
        "transaction_id", F.col("part").alias("i"), every.alias("j"), F.col("product_id").alias("a")
    )
    right = lines.select(
        "transaction_id", every.alias("i"), F.col("part").alias("j"), F.col("product_id").alias("b")
    )
    return left.join(right, ["transaction_id", "i", "j"]).filter("a < b").select("a", "b")


def co_purchase_graph(items: DataFrame, max_basket: int = 1000, store: bool = False) -> Graph:
    """Products bought together, weighted by the number of shared transactions.

    Nodes are the products of transactions with more than one line; two lines of one product
    make a node without an edge. ``store`` writes the graph out once, for jobs that walk it
    many times.
    """
    pairs = pair_counts(items, max_basket)
    both = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("a", "b"), ("b", "a"))])
    edges = pairs.select(F.inline(both), "weight")
    edges = cut_lineage(edges) if store else edges
    # A product of a basket with another product has an edge. What is left are products whose
    # transaction holds several lines of nothing else.
    alone = (
        items.groupBy("transaction_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("product_id").alias("product_id"),
            F.max("product_id").alias("last"),
        )
        .filter((F.col("n") > 1) & (F.col("product_id") == F.col("last")))
    )
    nodes = edges.select(F.col("src").alias("product_id")).unionByName(alone.select("product_id")).distinct()
    return Graph(cut_lineage(nodes) if store else nodes, edges)


def page_rank(
    graph: Graph, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6,
    store_every: int = 5, max_fan_out: int = 100_000,
) -> DataFrame:
    """Weighted PageRank: product_id, rank. Ranks sum to 1.

    Rank of nodes without an edge is spread over all nodes. Stops when the ranks of a round
    differ from the last by less than nodes * tol in sum, and raises if that never happens.

    Edges are laid out once, by source, and a hub's edges in parts of ``max_fan_out``; only
    ranks move between rounds. A round is one join and one grouped sum. The sum also brings the
    old rank along, so that nodes without a contribution stay and the change is known.
    """
    out = graph.edges.groupBy("src").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    out = cut_lineage(out.select("src", "total", F.ceil(F.col("n") / max_fan_out).alias("parts")))
    shares = (
        graph.edges.join(out, "src")
        .select(
            "src", F.pmod(F.xxhash64("dst"), "parts").alias("part"), "dst",
            (F.col("weight") / F.col("total")).alias("share"),
        )
        .repartition("src", "part")
        .persist()
    )
    nodes = (
        graph.nodes.join(out.withColumnRenamed("src", "product_id"), "product_id", "left")
        .select(
            "product_id", F.coalesce("parts", F.lit(1).cast("long")).alias("parts"),
            F.col("parts").isNull().alias("dangling"),
        )
        .persist()
    )
    held = [shares, nodes]
    try:
        return _iterate(shares, nodes, held, damping, max_iter, tol, store_every)
    finally:
        for df in held:
            df.unpersist()


def _iterate(
    shares: DataFrame, nodes: DataFrame, held: list[DataFrame], damping: float, max_iter: int, tol: float, store_every: int
) -> DataFrame:
    """Rounds of PageRank until they settle. What is cached is in ``held``, for the caller to release."""

    def send(state: DataFrame) -> DataFrame:
        every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        senders = state.select(F.col("product_id").alias("src"), "rank", every_part.alias("part"))
        return shares.join(senders, ["src", "part"]).select(F.col("dst").alias("product_id"), (F.col("share") * F.col("rank")).alias("got"))

    return _rounds(send, nodes, held, damping, max_iter, tol, store_every)


def _rounds(
    send: Callable[[DataFrame], DataFrame], nodes: DataFrame, held: list[DataFrame], damping: float, max_iter: int, tol: float, store_every: int
) -> DataFrame:
    """The rounds: ``send`` gives what each product gets (product_id, got) from the ranks of the last one."""
    n, lost = nodes.agg(F.count(F.lit(1)), F.count_if("dangling")).first()
    if n == 0:
        return cut_lineage(nodes.select("product_id", F.lit(0.0).alias("rank")))
    state = nodes.withColumn("rank", F.lit(1.0 / n))
    loose = lost / n
    fixed = len(held)
    for step in range(1, max_iter + 1):
        sent = send(state).select(
            "product_id", "got", F.lit(0.0).alias("old"), F.lit(1).cast("long").alias("parts"), F.lit(False).alias("dangling"),
        )
        kept = state.select(
            "product_id", F.lit(0.0).alias("got"), F.col("rank").alias("old"), "parts", "dangling"
        )
        base = (1.0 - damping) / n + damping * loose / n
        turned = (
            sent.unionByName(kept).groupBy("product_id")
            .agg(
                F.sum("got").alias("got"), F.sum("old").alias("old"),
                F.max("parts").alias("parts"), F.max("dangling").alias("dangling"),
            )
            .withColumn("rank", F.lit(base) + F.lit(damping) * F.col("got"))
        )
        before = held[fixed:]
        turned = cut_lineage(turned) if step % store_every == 0 else turned.persist()
        held.append(turned)
        change, loose = turned.agg(
            F.sum(F.abs(F.col("rank") - F.col("old"))),
            F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)),
        ).first()
        for df in before:
            df.unpersist()
        del held[fixed:-1]
        state = turned.select("product_id", "parts", "dangling", "rank")
        if change < n * tol:
            return cut_lineage(state.select("product_id", "rank"))
    raise RuntimeError(f"PageRank did not converge in {max_iter} rounds")


def page_rank_of_lines(
    items: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, store_every: int = 5, max_fan_out: int = 100_000,
) -> DataFrame:
    """``page_rank`` of the products bought together, from the lines themselves: no edge is formed.

    The weight of an edge is the number of transactions that hold both products. So a product gets, from each of
    its transactions, the sum of rank / total over the others there, where the total of a product counts
    the others in all its transactions. A round is a sum by transaction and one by product, so it moves two
    rows per line, where there are as many edges as lines times the others of a transaction. Lines of a best
    seller are laid out in parts of ``max_fan_out``.
    """
    every = W.partitionBy("transaction_id")
    counted = (
        items.select("transaction_id", "product_id").repartition("transaction_id")
        .groupBy("transaction_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
        .select("transaction_id", "product_id", F.sum("n").over(every).alias("n"), F.count("product_id").over(every).alias("held"))
    )
    lines = cut_lineage(counted.filter("n > 1 and product_id is not null"))
    others = F.when(F.col("transaction_id").isNotNull(), F.col("held") - 1).otherwise(0)  # lines without a transaction share none
    nodes = cut_lineage(
        lines.groupBy("product_id").agg(F.sum(others).alias("total"), F.count_if(others > 0).alias("baskets"))
        .select("product_id", "total", "baskets", F.greatest(F.lit(1), F.ceil(F.col("baskets") / max_fan_out)).alias("parts"))
    )
    joined = lines.filter(others > 0).select("transaction_id", "product_id")
    parts = nodes.filter("total > 0").select("product_id", "parts")
    part = F.pmod(F.xxhash64("transaction_id"), "parts").alias("part")
    by_product = joined.join(parts, "product_id").select("transaction_id", "product_id", part).repartition("product_id", "part").persist()
    by_basket = joined.repartition("transaction_id").persist()
    degrees = nodes.filter("total > 0").select("product_id", "total", "baskets")
    state = nodes.select("product_id", F.col("parts").cast("long").alias("parts"), (F.col("total") == 0).alias("dangling")).persist()

    def send(ranks: DataFrame) -> DataFrame:
        own = ranks.select("product_id", "parts", "rank").join(degrees, "product_id").withColumn("given", F.col("rank") / F.col("total"))
        every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        sums = by_product.join(own.select("product_id", "given", every_part.alias("part")), ["product_id", "part"]).groupBy("transaction_id").agg(F.sum("given").alias("got"))
        got = by_basket.join(sums, "transaction_id").select("product_id", "got")
        return got.unionByName(own.select("product_id", (-F.col("given") * F.col("baskets")).alias("got")))

    held = [by_product, by_basket, state]
    try:
        return _rounds(send, state, held, damping, max_iter, tol, store_every)
    finally:
        for df in held:
            df.unpersist()


def with_product_info(df: DataFrame, products: DataFrame, key: str = "product_id") -> DataFrame:
    """Add name and category of the product in ``key``; unknown products get defaults."""
    info = products.select(F.col("product_id").alias(key), "name", "category")
    return df.join(info, key, "left").withColumns({
        "name": name_or_default(F.col("name"), F.col(key)),
        "category": category_or_default(F.col("category")),
    })


def by_rank() -> list:
    """Rank order. Ranks equal to 12 places are ties and go to the smaller id."""
    return [F.desc(F.round("rank", 12)), F.asc("product_id")]


def product_ranks(ranks: DataFrame, products: DataFrame, top_n: int | None = None) -> DataFrame:
    if top_n is not None:
        ranks = ranks.orderBy(*by_rank()).limit(top_n)
    return with_product_info(ranks, products).orderBy(*by_rank())


def rank_subgraph(graph: Graph, ranks: DataFrame, top_n: int = 20) -> Graph:
    """The graph among the ``top_n`` products; nodes carry rank and degree (both directions)."""
    top = ranks.orderBy(*by_rank()).limit(top_n)
    ids = top.select("product_id")
    edges = graph.edges.join(ids.withColumnRenamed("product_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("product_id", "dst"), "dst", "left_semi"
    ).select("src", "dst", "weight")
    degrees = edges.groupBy(F.col("src").alias("product_id")).agg((F.count(F.lit(1)) * 2).alias("degree"))
    return Graph(top.join(degrees, "product_id", "left").na.fill(0, ["degree"]), edges)
