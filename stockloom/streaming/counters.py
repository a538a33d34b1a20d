"""The counters as streaming jobs.

Every job writes each micro-batch to a folder of its own, named by the batch id, and overwrites
it when the batch is run again. So a batch that is replayed after a failure does not count
twice. Readers take the newest revision of each key. Every few batches the newest revisions are
put together in a base; what lies two bases back is deleted. A read thus opens one base and a few
batches, however long the stream has run. A job that has seen nothing reads as an empty table.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stockloom.functions.dates import period_key
from stockloom.operators import sketches
from stockloom.operators.ticker import recent

logger = logging.getLogger(__name__)

# How long hours and days stay open for late rows, and in the results.
RETENTION = {"hour": "24 hours", "day": "30 days"}
_WIDTH = {"hour": "1 hour", "day": "1 day"}

# Read all there is and end. A live job gives processingTime="10 seconds" or the like.
ONCE = {"availableNow": True}

# Batches from one base to the next.
BASE_EVERY = 10


def _path(spark: SparkSession, path: str):
    """A path and its file system, which may be any that Spark reaches."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Ids of the completely written batches under a folder, in order."""
    at, system = _path(spark, path)
    if not system.exists(at):
        return []
    names = [(str(x.getPath().getName()), x.getPath()) for x in system.listStatus(at)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.partition("=")[2]) for n, p in names if n.startswith("batch_id=") and system.exists(done(p, "_SUCCESS")))


def _drop(spark: SparkSession, path: str, ids: list[int]) -> None:
    for i in ids:
        at, system = _path(spark, f"{path}/batch_id={i}")
        system.delete(at, True)


def _read(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch_id={i}" for i in ids])


def _revisions(spark: SparkSession, folder: str, until: int | None = None) -> DataFrame:
    """The last base and the batches after it, up to batch ``until``."""
    upto = [i for i in _numbers(spark, f"{folder}/batches") if until is None or i <= until]
    bases = [i for i in _numbers(spark, f"{folder}/bases") if until is None or i < until]
    after = [i for i in upto if not bases or i > bases[-1]]
    parts = ([_read(spark, f"{folder}/bases", bases[-1:])] if bases else []) + ([_read(spark, f"{folder}/batches", after)] if after else [])
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _newest(revisions: DataFrame, keys: list[str], value: str) -> DataFrame:
    return revisions.groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


def _write_batches(folder: str, keys: list[str], value: str = "units", period: str | None = None) -> Callable[[DataFrame, int], None]:
    """Write a batch, and a base when it is time. With a ``period``, a base leaves out what is past retention."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch_id={batch_id}")
        if batch_id % BASE_EVERY == BASE_EVERY - 1:
            base = _newest(_revisions(spark, folder, batch_id), keys, value)
            base = base if period is None else _open_periods(base, period)
            base.write.mode("overwrite").parquet(f"{folder}/bases/batch_id={batch_id}")
            # a batch that is run again needs the base before; nothing needs what that one replaced
            _drop(spark, f"{folder}/bases", [i for i in _numbers(spark, f"{folder}/bases") if i < batch_id - BASE_EVERY])
            _drop(spark, f"{folder}/batches", [i for i in _numbers(spark, f"{folder}/batches") if 0 <= i <= batch_id - BASE_EVERY])

    return write


def _start(result: DataFrame, mode: str, write: Callable, folder: str, trigger: dict | None, empty: DataFrame | None = None) -> StreamingQuery:
    """Start the job. Its folder gets an empty batch first, unless it has run before."""
    spark = result.sparkSession
    if not _numbers(spark, f"{folder}/batches"):
        none = spark.createDataFrame([], result.schema) if empty is None else empty
        none.write.mode("overwrite").parquet(f"{folder}/batches/batch_id=-1")
    return (
        result.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or ONCE)).start()
    )


def newest_totals(spark: SparkSession, folder: str, keys: list[str], value: str = "units") -> DataFrame:
    """The last revision of every key written so far."""
    return _newest(_revisions(spark, folder), keys, value)


def _open_periods(totals: DataFrame, period: str, as_of: datetime | None = None) -> DataFrame:
    pattern = {"hour": "yyyy-MM-dd HH:mm", "day": "yyyy-MM-dd"}[period]
    newest = totals.agg(F.to_timestamp(F.max(period), pattern).alias("newest")).scalar() if as_of is None else F.lit(as_of)
    return totals.filter(F.col(period) >= period_key(newest - F.expr(f"INTERVAL {RETENTION[period]}"), period))


def retained_totals(spark: SparkSession, folder: str, period: str, as_of: datetime | None = None) -> DataFrame:
    """Totals of ``start_period_totals`` without hours older than 24 hours, or days older than 30
    days, before ``as_of`` (by default the newest period)."""
    return _open_periods(newest_totals(spark, folder, [period, "product_id"]), period, as_of)


def start_totals(
    items: DataFrame, keys: dict[str, Column], folder: str, weight: Column | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Running sums per key: by product, by category, by sketch cell."""
    grouped = items.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.sum(F.col("quantity") if weight is None else weight).alias("units")
    )
    return _start(grouped, "update", _write_batches(folder, list(keys)), folder, trigger)


def start_count_min(
    items: DataFrame, folder: str, width: int = 1000, depth: int = 5, seed: int = 42, hashing: str = "mixed", trigger: dict | None = None
) -> StreamingQuery:
    """The Count-Min sketch as running sums of its cells: at most width * depth keys of state."""
    cells = sketches.cells(items, "product_id", "quantity", width, depth, seed, hashing)
    return start_totals(cells, {"row": F.col("cell.row"), "bucket": F.col("cell.bucket")}, folder, F.col("w"), trigger)


def start_period_totals(items: DataFrame, period: str, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Units per hour or day and product. Rows later than the retention are dropped; the mark
    moves on after a batch, so a row is kept at least that long."""
    in_window = F.window("timestamp", _WIDTH[period])
    totals = (
        items.withWatermark("timestamp", RETENTION[period])
        .groupBy(in_window.alias("w"), "product_id")
        .agg(F.sum("quantity").alias("units"))
        .select(period_key(F.col("w.start"), period).alias(period), "product_id", "units")
    )
    return _start(totals, "update", _write_batches(folder, [period, "product_id"], period=period), folder, trigger)


def start_rate(transactions: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Transactions of each minute. A row is counted once; ``sliding_rates`` puts minutes together to windows of any length."""
    panes = (
        transactions.withWatermark("timestamp", RETENTION["hour"])
        .groupBy(F.window("timestamp", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("minute"), "n")
    )
    return _start(panes, "update", _write_batches(folder, ["minute"], "n"), folder, trigger)


def sliding_rates(spark: SparkSession, folder: str, minutes: int) -> DataFrame:
    """until, per_minute: transactions per minute over a window of ``minutes`` that slides by one, wherever it holds any.

    Sums the stored minutes, one row each, so the work doesn't grow with the transactions.
    """
    panes = newest_totals(spark, folder, ["minute"], "n")
    ends = F.explode(F.sequence(F.lit(1), F.lit(minutes)))
    reached = panes.select("minute", "n", ends.alias("i")).select((F.col("minute") + F.make_dt_interval(mins=F.col("i"))).alias("until"), "n")
    return reached.groupBy("until").agg((F.sum("n") / minutes).alias("per_minute"))


def last_stored(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """What the last batch stored, or the last one before batch ``before``."""
    path = f"{folder}/batches"
    last = max(i for i in _numbers(spark, path) if before is None or i < before)
    return spark.read.parquet(f"{path}/batch_id={last}")


def _replace_stored(folder: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Store ``step(what was stored before, batch)``. Only the last two are kept, as a batch may be run again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{folder}/batches"
        step(last_stored(spark, folder, batch_id), batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        _drop(spark, path, [i for i in _numbers(spark, path) if 0 <= i < batch_id - 1])

    return write


def start_space_saving(items: DataFrame, k: int, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Space-Saving over the stream: a batch's summary is merged with the stored one."""
    spark = items.sparkSession
    empty = sketches.space_saving(spark.createDataFrame([], items.schema), k)
    merge = lambda before, batch: sketches.merge_space_saving(before, sketches.space_saving(batch, k), k)
    return _start(items, "append", _replace_stored(folder, merge), folder, trigger, empty)


def start_recent(transactions: DataFrame, n: int, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """The newest ``n`` transactions so far."""
    keep = lambda before, batch: recent(batch.unionByName(before), n).coalesce(1)
    return _start(transactions, "append", _replace_stored(folder, keep), folder, trigger)


def start_callback(
    transactions: DataFrame, callback: Callable[[DataFrame], None], folder: str, trigger: dict | None = None
) -> StreamingQuery:
    """Call ``callback`` with each batch; its errors are logged and do not end the stream."""

    def call(batch: DataFrame, batch_id: int) -> None:
        try:
            callback(batch)
        except Exception:
            logger.exception("callback failed on batch %s", batch_id)

    return _start(transactions, "append", call, folder, trigger)


def run(query: StreamingQuery) -> None:
    """Wait until the query has read all there is."""
    query.awaitTermination()
