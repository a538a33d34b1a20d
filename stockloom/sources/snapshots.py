"""Snapshots and exports that are safe to repeat.

A ledger is a folder of numbered snapshots. The greatest number that was written to its end is its high-water
mark: a batch up to the mark has been applied and is passed over, the next one starts from the snapshot before, and a
job that died half-way left a number without an end, which is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.functions.dates import period_key
from stockloom.operators.stock import stock_after_sales


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the snapshots that were written to their end, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path
    files = root(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root(folder)):
        return []
    names = [x.getPath().getName() for x in files.listStatus(root(folder))]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch=") and files.exists(root(f"{folder}/{n}/_SUCCESS")))


def high_water_mark(spark: SparkSession, folder: str) -> int | None:
    """The last batch that a ledger has taken in, None before the first."""
    return max(_numbers(spark, folder), default=None)


def snapshot(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The stock after a batch, by default the last."""
    last = high_water_mark(spark, folder) if number is None else number
    return spark.read.parquet(f"{folder}/batch={last}")


def open_ledger(opening: DataFrame, folder: str, number: int = 0) -> DataFrame:
    """Begin a ledger with its opening stock, unless it has begun."""
    spark = opening.sparkSession
    if not _numbers(spark, folder):
        opening.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return snapshot(spark, folder)


def take_in(sales: DataFrame, folder: str, number: int, keep: int = 3) -> DataFrame:
    """The stock after batch ``number`` of sales. A batch that was taken in before changes nothing, whatever it
    holds now. The last ``keep`` snapshots stay."""
    spark = sales.sparkSession
    done = _numbers(spark, folder)
    if not done:
        raise ValueError("the ledger has not been opened")
    if number > done[-1]:
        stock_after_sales(snapshot(spark, folder, done[-1]), sales).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        for old in _numbers(spark, folder)[:-keep]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return snapshot(spark, folder)


def export_periods(rows: DataFrame, time: str, path: str, period: str = "day", changed: DataFrame | None = None) -> str:
    """Write rows to a folder per ``period`` of ``time`` (day or month, see ``period_key``). With ``changed``, a table with a column ``period``,
    only these are written, each as a whole; all other folders stay as they are. One that holds no rows any more is left alone."""
    dated = rows.withColumn("period", period_key(F.col(time), period))
    if changed is not None:
        dated = dated.join(changed.select("period").distinct(), "period", "left_semi")
    # a period's rows meet in one task, so that it becomes one file; the planner splits those that are too large
    tasks = dated.hint("rebalance", "period")
    tasks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)
    return path
