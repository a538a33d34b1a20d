"""Join-shaped operators on the retail tables."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stockloom.functions.clean import category_or_default
from stockloom.session import cut_lineage
from stockloom.sources.tables import Retail


def units_since(items: DataFrame, products: DataFrame, above: int, key: str) -> DataFrame:
    """Per product the units in lines whose ``key`` lies above a mark; products without are left out.

    The correlated sum and its existence test are one grouped sum and an inner join.
    """
    sold = items.filter(F.col(key) > above).groupBy("product_id").agg(F.sum("quantity").alias("sold"))
    return products.select("product_id").join(sold, "product_id")


def aligned_ratio(upper: DataFrame, lower: DataFrame, key: str, a: str, b: str, name: str) -> DataFrame:
    """``a / max(b, 1)`` matched on the key; a key found on one side only gives 0."""
    ratio = F.col(a) / F.greatest(F.col(b), F.lit(1))
    return (
        upper.select(key, a).join(lower.select(key, b), key, "full_outer")
        .select(key, F.coalesce(ratio, F.lit(0.0)).alias(name))
    )


def in_stock_sales(sales: DataFrame, stock: DataFrame, gone: Column) -> DataFrame:
    """Sales of products that are not out of stock."""
    return sales.join(stock.filter(gone).select("product_id"), "product_id", "left_anti")


#: Levels of whole bins: 2^22 days are some 11,000 years.
LEVELS = 22


def _micros(ts: str, like: DataFrame) -> Column:
    """Microseconds of a timestamp of either kind since the start of 1970 on its own clock."""
    kind = like.schema[ts].dataType.simpleString()
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(kind), F.col(ts))


def _whole_bins(first: Column, end: Column) -> Column:
    """The bins from ``first`` up to before ``end`` as nodes (level, node): a node of level i stands for 2^i
    bins, and there are at most two of each level below the last."""
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    shifted = lambda x, level: F.call_function("shiftright", x, level)
    node = lambda level, x: F.struct(level.alias("level"), x.alias("node"))
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("bigint")) == 1

    def of_level(level: Column) -> Column:
        lo, hi = -shifted(-first, level), shifted(end, level)  # rounded up and down
        side = lambda taken, x: F.when((lo < hi) & taken, F.array(node(level, x))).otherwise(none)
        return F.concat(side(odd(lo), lo), side(odd(hi), hi - 1))

    lo, hi = -F.shiftright(-first, LEVELS), F.shiftright(end, LEVELS)
    rest = F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda x: node(F.lit(LEVELS), x))).otherwise(none)
    return F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of_level)), rest)


def _sweep(moments: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """Of each moment the least factor among the pieces that hold it: both in order of time, with the
    pieces begun so far in a heap, from whose top those that have ended fall."""
    moments, pieces = moments.sort_values("t"), pieces.sort_values("lo")
    los, his, factors = (pieces[c].tolist() for c in ("lo", "hi", "factor"))
    open_pieces: list[tuple[float, int]] = []
    found, begun = [], 0
    for t in moments["t"].tolist():
        while begun < len(los) and los[begun] <= t:
            heapq.heappush(open_pieces, (factors[begun], his[begun]))
            begun += 1
        while open_pieces and open_pieces[0][1] < t:
            heapq.heappop(open_pieces)
        found.append(open_pieces[0][0] if open_pieces else None)
    return moments.assign(part=pd.Series(found, index=moments.index, dtype="float64"))


def lowest_factor(moments: DataFrame, spans: DataFrame, bin_micros: int = 86_400_000_000, few: int = 64) -> DataFrame:
    """product_id, t, factor: of each moment (product_id, t in microseconds) the least factor of the spans
    (product_id, lo, hi, factor, both ends in) that hold it; moments outside all spans are left out.

    Products with at most ``few`` spans are compared with each of them. The others are swept, see ``_swept``.
    """
    spans = spans.filter("product_id is not null and factor is not null and lo <= hi")
    spans = cut_lineage(spans.groupBy("product_id", "lo", "hi").agg(F.min("factor").alias("factor")))
    many = cut_lineage(spans.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("product_id"))
    moments = moments.filter("product_id is not null and t is not null").distinct()
    swept = not many.isEmpty()
    rest = spans.join(many, "product_id", "left_anti") if swept else spans
    found = moments.join(rest, "product_id").filter((F.col("lo") <= F.col("t")) & (F.col("t") <= F.col("hi"))).groupBy("product_id", "t").agg(F.min("factor").alias("factor"))
    if not swept:
        return found
    return found.unionByName(_swept(moments.join(many, "product_id", "left_semi"), spans.join(many, "product_id", "left_semi"), bin_micros))


def _swept(moments: DataFrame, spans: DataFrame, bin_micros: int) -> DataFrame:
    """The same for products with any number of spans.

    Time is cut into bins. A span gives its ends' bins a piece each, and the whole bins between them as a few
    nodes of a binary tree, so a long span costs little more than a short one. Pieces meet the moments of
    their product and bin in a sweep, nodes meet bins by equality; no span is paired with a moment.
    """
    bin_of = lambda x: F.floor(x / F.lit(bin_micros)).cast("bigint")
    spans = cut_lineage(spans.withColumns({"first": bin_of(F.col("lo")), "last": bin_of(F.col("hi"))}))
    moments = cut_lineage(moments.withColumn("bin", bin_of(F.col("t"))))
    ends = F.explode(F.array_distinct(F.array("first", "last")))
    pieces = spans.select("product_id", ends.alias("bin"), "lo", "hi", "factor")
    nodes = cut_lineage(
        spans.filter(F.col("last") - F.col("first") > 1)
        .select("product_id", F.inline(_whole_bins(F.col("first") + 1, F.col("last"))), "factor")
        .groupBy("product_id", "level", "node").agg(F.min("factor").alias("whole"))
    )
    used = sorted(r["level"] for r in nodes.select("level").distinct().collect())  # at most LEVELS + 1
    above = F.transform(F.array(*map(F.lit, used)).cast("array<int>"), lambda i: F.struct(i.alias("level"), F.call_function("shiftright", F.col("bin"), i).alias("node")))
    whole = (
        moments.select("product_id", "bin").distinct().select("product_id", "bin", F.inline(above))
        .join(nodes, ["product_id", "level", "node"]).groupBy("product_id", "bin").agg(F.min("whole").alias("whole"))
    )
    keys = ["product_id", "bin"]
    kinds = dict(moments.dtypes)
    near = cut_lineage(moments.join(pieces.select(*keys).distinct(), keys, "left_semi"))
    close = pieces.join(near.select(*keys).distinct(), keys, "left_semi")
    swept = (
        near.groupBy(*keys).cogroup(close.groupBy(*keys))
        .applyInPandas(_sweep, f"product_id {kinds['product_id']}, t bigint, bin bigint, part double")
    )
    both = swept.select(*keys, "t", F.col("part").alias("factor")).unionByName(
        moments.join(whole, keys).select(*keys, "t", F.col("whole").cast("double").alias("factor"))
    )
    return both.filter("factor is not null").groupBy("product_id", "t").agg(F.min("factor").alias("factor"))


def promo_price(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Sales with the price a promotion gives within its time span.

    Where spans of one product overlap, the lowest factor counts once: the line is not repeated.
    The factor is found for each moment at which a product sold (see ``lowest_factor``) and then joined
    to its lines, so a product may have any number of promotions and of lines.
    """
    moments = sales.select("product_id", _micros("transaction_date", sales).alias("t"))
    spans = promotions.select(
        "product_id", _micros("start_time", promotions).alias("lo"), _micros("end_time", promotions).alias("hi"),
        F.col("discount_factor").cast("double").alias("factor"),
    )
    factors = cut_lineage(lowest_factor(moments, spans))
    return (
        sales.withColumn("t", _micros("transaction_date", sales)).join(factors, ["product_id", "t"], "left")
        .select(*sales.columns, "factor")
        .withColumn("price", F.col("price_per_unit") * F.coalesce("factor", F.lit(1.0)))
        .withColumn("promotion_applied", F.col("factor").isNotNull())
        .drop("factor")
    )


def category_fallback(keys: DataFrame, *sources: DataFrame | None) -> DataFrame:
    """Category of each key: from the first source that knows it, else Unknown.

    A source without a category column (or None) is passed over.
    """
    found = keys
    names = []
    for i, source in enumerate(sources):
        if source is None or "category" not in source.columns:
            continue
        names.append(f"category_{i}")
        known = source.groupBy("product_id").agg(F.min("category").alias(names[-1]))
        found = found.join(known, "product_id", "left")
    choice = F.coalesce(*[F.col(n) for n in names]) if names else F.lit(None).cast("string")
    return found.withColumn("category", category_or_default(choice)).drop(*names)


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str = "category") -> DataFrame:
    """A 0/1 column per value, named by prefix and value, in sorted order."""
    flags = {
        f"{prefix}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in sorted(values)
    }
    return df.withColumns(flags)


def stock_with_names(retail: Retail) -> DataFrame:
    """Stock with name and category where known (keeps unknown products)."""
    names = retail.products.select("product_id", "name", "category")
    return retail.inventory.join(names, "product_id", "left").select(
        "product_id", "quantity",
        F.coalesce("name", F.concat(F.lit("Product "), F.col("product_id").cast("string"))).alias("name"),
        category_or_default(F.col("category")).alias("category"),
    )
