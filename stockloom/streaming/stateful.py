"""Counters that keep their state by key, with timers: hours and days that end exactly, and the newest rows.

Each key's state lies in Spark's state store, on disk and in the checkpoint, so a job that restarts goes on from there.
Rows are summed within their task before the shuffle, so a hot product brings a row per task and period.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stockloom.functions.dates import period_key
from stockloom.streaming import counters

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SECONDS = {"hour": 3600, "day": 86_400}


def _started(result: DataFrame, write, folder: str, trigger: dict | None, empty: DataFrame) -> StreamingQuery:
    """Start a job with its state on disk, the one kind of store that keeps timers. Jobs take the setting when they start."""
    conf = result.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ON_DISK)
    try:
        return counters._start(result, "update", write, folder, trigger, empty)
    finally:
        conf.set(_STORE, before)


class OpenPeriod(StatefulProcessor):
    """Units of a product in a period (its end, in seconds). When its time is over the state goes, and a row without units says so."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.units = handle, handle.getValueState("units", "units long")

    def _row(self, key: tuple, units: int | None) -> pd.DataFrame:
        return pd.DataFrame({"ends": [key[0]], "product_id": pd.array([key[1]], "Int64"), "units": pd.array([units], "Int64")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = sum(int(part["units"].sum()) for part in rows)
        if self.units.exists():
            total += self.units.get()[0]
        else:
            self.handle.registerTimer(key[0] * 1000 + 1)  # just after its end, on the clock that lags by the retention
        self.units.update((total,))
        yield self._row(key, total)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.units.clear()
        yield self._row(key, None)

    def close(self) -> None:
        pass


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per end and product for each task."""
    parts = [pa.Table.from_batches([b]).group_by(["ends", "product_id"]).aggregate([("units", "sum")]) for b in batches]
    if parts:
        whole = pa.concat_tables(parts).group_by(["ends", "product_id"]).aggregate([("units_sum", "sum")])
        yield from whole.rename_columns(["ends", "product_id", "units"]).select(["ends", "product_id", "units"]).to_batches()


def start_open_periods(items: DataFrame, period: str, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Units per hour or day and product, of the periods that are still open.

    A period is open as long as its end lies no further back than the retention (24 hours, 30 days) from the end of
    the newest one. The clock goes by the ends of periods, so that nothing of an open period is late. It
    moves on after a batch, and a batch without rows follows, in which the timers of all periods past
    retention run out: what ``open_totals`` reads then is exact.
    """
    spark, width = items.sparkSession, _SECONDS[period]
    ends = (F.floor(F.unix_seconds(F.col("timestamp")) / width) + 1) * width
    rows = items.filter("timestamp is not null").select(ends.cast("long").alias("ends"), F.col("product_id").cast("long").alias("product_id"), F.col("quantity").cast("long").alias("units"))
    summed = rows.mapInArrow(_summed, "ends long, product_id long, units long").withColumn("clock", F.timestamp_seconds("ends"))
    kept = (
        summed.withWatermark("clock", counters.RETENTION[period]).groupBy("ends", "product_id")
        .transformWithStateInPandas(OpenPeriod(), "ends long, product_id long, units long", "Update", "EventTime")
    )
    named = kept.select(period_key(F.timestamp_seconds(F.col("ends") - width), period).alias(period), "product_id", "units")
    empty = spark.createDataFrame([], f"{period} string, product_id long, units long")
    return _started(named, counters._write_batches(folder, [period, "product_id"]), folder, trigger, empty)


def open_totals(spark: SparkSession, folder: str, period: str) -> DataFrame:
    """The open periods as the job left them."""
    return counters.newest_totals(spark, folder, [period, "product_id"]).filter("units is not null")
