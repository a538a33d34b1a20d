"""The five retail tables, and how the warehouse tables map to them.

``open_retail`` reads the warehouse parquet files. The warehouse holds no stock table, so the
part size (1 to 50) stands in for the stock on hand, and a part's description is made up of its
name, type and brand. Line items carry no id of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

PRODUCTS_SCHEMA = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("price", T.DoubleType(), False),
    T.StructField("supplier", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
INVENTORY_SCHEMA = T.StructType([
    T.StructField("inventory_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("quantity", T.LongType(), False),
    T.StructField("last_updated", T.TimestampType()),
])
TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType(), False),
    T.StructField("transaction_date", T.TimestampType()),
    T.StructField("customer_id", T.LongType()),
])
ITEMS_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType(), False),
    T.StructField("transaction_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("quantity", T.LongType(), False),
    T.StructField("price_per_unit", T.DoubleType(), False),
])
CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("email", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
SCHEMAS = {
    "products": PRODUCTS_SCHEMA,
    "inventory": INVENTORY_SCHEMA,
    "transactions": TRANSACTIONS_SCHEMA,
    "transaction_items": ITEMS_SCHEMA,
    "customers": CUSTOMERS_SCHEMA,
}


@dataclass(frozen=True)
class Retail:
    """The retail tables, lazily read."""

    products: DataFrame
    inventory: DataFrame
    transactions: DataFrame
    items: DataFrame
    customers: DataFrame

    def sales(self) -> DataFrame:
        """Flat fact: one row per sold line with its date, customer, product name and category.

        Every join side but the lines is unique on its key. Sizes are left to the planner: small
        dimensions are broadcast, large ones are sorted and hot keys split at run time.
        """
        names = self.products.select("product_id", F.col("name").alias("product_name"), "category")
        return (
            self.items.join(self.transactions, "transaction_id")
            .join(names, "product_id")
            .select(
                "transaction_id", "transaction_date", "product_id", "product_name", "category",
                "quantity", "price_per_unit", "customer_id",
            )
        )

    def by_supplier(self) -> "Retail":
        """The same tables at supplier grain: a supplier's number becomes the product id.

        Single products sell too rarely to mine or to forecast; their suppliers do not.
        """
        number = F.regexp_extract("supplier", r"(\d+)", 1).cast("long")
        to_supplier = self.products.select("product_id", number.alias("supplier_id"))
        products = (
            self.products.withColumn("supplier_id", number)
            .groupBy("supplier_id", "supplier")
            .agg(F.min("category").alias("category"), F.avg("price").alias("price"))
            .select(
                F.col("supplier_id").alias("product_id"), F.col("supplier").alias("name"),
                "category", "price", "supplier", F.col("supplier").alias("description"),
            )
        )
        inventory = (
            self.inventory.join(to_supplier, "product_id")
            .groupBy("supplier_id")
            .agg(F.sum("quantity").alias("quantity"))
            .select(
                F.col("supplier_id").alias("inventory_id"), F.col("supplier_id").alias("product_id"),
                "quantity",
            )
        )
        items = self.items.join(to_supplier, "product_id").select(
            "transaction_id", F.col("supplier_id").alias("product_id"), "quantity", "price_per_unit"
        )
        return Retail(products, inventory, self.transactions, items, self.customers)


def open_retail(spark: SparkSession, folder: str) -> Retail:
    """Map the warehouse parquet tables in ``folder`` to the retail tables."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    part, lines = table("part"), table("lineitem")
    products = part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("supplier"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description"),
    )
    inventory = part.select(
        F.col("p_partkey").alias("inventory_id"), F.col("p_partkey").alias("product_id"),
        F.col("p_size").cast("long").alias("quantity"),
    )
    transactions = table("orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_orderdate").alias("transaction_date"),
        F.col("o_custkey").alias("customer_id"),
    )
    items = lines.select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("long").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_unit"),
    )
    customers = table("customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name")
    )
    return Retail(products, inventory, transactions, items, customers)


def _as_transactions(events: DataFrame) -> DataFrame:
    """Events as one-item transactions: event type is the category, ``props.k`` the product."""
    return events.select(
        F.col("event_id").alias("transaction_id"), F.col("ts").alias("timestamp"),
        F.col("user_id").alias("customer_id"),
        F.array(
            F.struct(
                F.get_json_object("props", "$.k").cast("long").alias("product_id"),
                F.col("event_type").alias("category"),
                F.lit(None).cast("long").alias("quantity"),
                F.col("value").alias("price"),
            )
        ).alias("items"),
    )


def open_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as nested transactions (batch)."""
    return _as_transactions(spark.read.parquet(f"{folder}/events.parquet"))


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = 5) -> DataFrame:
    """The event table as a stream of nested transactions, some files per micro-batch.

    The table may be one file or a folder of them, as for the batch reader. Its path is given as a
    pattern that only it fits: Spark takes a pattern that finds a file, but not a file, as a source.
    Watermarks need TIMESTAMP, the files hold TIMESTAMP_NTZ.
    """
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}/events.parque[t]")
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    return _as_transactions(events)


def _csv_rows(spark: SparkSession, name: str, path: str) -> tuple[DataFrame, list[str]]:
    """The rows of a header CSV as text, and which of the table's columns it has. Quoted texts may hold line breaks."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows, [f.name for f in SCHEMAS[name].fields if f.name in rows.columns]


def _unfit(name: str, there: list[str]) -> dict[str, Column]:
    """For each required column that the file has, whether its value is missing or doesn't parse."""
    return {f.name: F.col(f.name).try_cast(f.dataType).isNull() for f in SCHEMAS[name].fields if f.name in there and not f.nullable}


def read_csv_table(spark: SparkSession, name: str, path: str, on_bad: str = "fail") -> DataFrame:
    """One retail table from header CSV, with its declared schema (extra columns are left out).

    A row whose required column is missing or doesn't parse ends the job with the value (``on_bad`` fail) or is
    left out (drop); ``csv_rejects`` lists such rows. Required columns that the file lacks altogether, and other
    values that don't parse, are null.
    """
    if on_bad not in ("fail", "drop"):
        raise ValueError("on_bad is fail or drop")
    rows, there = _csv_rows(spark, name, path)
    unfit = _unfit(name, there)
    if on_bad == "drop":
        rows = rows.filter(~reduce(or_, unfit.values(), F.lit(False)))
    columns = []
    for field in SCHEMAS[name].fields:
        value = F.col(field.name).try_cast(field.dataType) if field.name in there else F.lit(None).cast(field.dataType)
        if on_bad == "fail" and field.name in unfit:
            shown = F.concat(F.lit(f"{name}.{field.name}: "), F.coalesce(F.col(field.name), F.lit("no value")))
            value = F.when(unfit[field.name], F.raise_error(shown).cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return rows.select(columns)


def csv_rejects(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The rows of a CSV that ``read_csv_table`` doesn't take: as text, with ``bad``, the required columns that are missing or don't parse."""
    rows, there = _csv_rows(spark, name, path)
    bad = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in _unfit(name, there).items())), lambda x: x.isNotNull())
    return rows.withColumn("bad", bad).filter(F.size("bad") > 0)


def read_kafka_transactions(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """A stream of nested transactions from a message topic holding JSON values."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("t")).select("t.*")
