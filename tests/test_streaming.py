"""Streaming jobs give what their batch twins give, and drop what is too late."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockloom.operators import sketches, ticker
from stockloom.operators.scans import flat_items
from stockloom.session import run_dir
from stockloom.sources.tables import open_events, stream_events
from stockloom.streaming import counters

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(i, ts, product):
    return (i, ts, i % 4, "view" if i % 3 else "buy", float(i), f'{{"k": {product}}}')


def write_files(spark, folder, files):
    """The event table as a folder of files, one per list of events, read in order of their times of writing."""
    import glob
    import os
    import time

    seen = set()
    for i, data in enumerate(files):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        new = set(glob.glob(f"{folder}/events.parquet/part-*")) - seen
        seen |= new
        for name in new:
            os.utime(name, (time.time() + 10 * i,) * 2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    start = datetime(2024, 1, 1)
    data = [event(i, start + timedelta(minutes=7 * i), i * i % 11) for i in range(300)]
    path = str(tmp_path_factory.mktemp("stream") / "in")
    write_files(spark, path, [data[:60], data[60:120], data[120:180], data[180:240], data[240:]])
    return path


@pytest.fixture
def whole(spark, folder):
    """All files as one batch."""
    return open_events(spark, folder)


@pytest.mark.parametrize("period", ["hour", "day"])
def test_period_totals_equal_batch(spark, folder, whole, rows, period):
    out = run_dir(spark, "test-stream")
    counters.run(counters.start_period_totals(flat_items(stream_events(spark, folder, 1)), period, out))
    assert len(counters._numbers(spark, f"{out}/batches")) >= 5
    columns = [period, "product_id", "units"]
    found = counters.newest_totals(spark, out, columns[:2])
    assert rows(found, *columns) == rows(ticker.product_totals(flat_items(whole), period), *columns)


def test_totals_and_sketch_equal_batch(spark, folder, whole, rows):
    items = flat_items(whole)
    out = run_dir(spark, "test-stream")
    stream = flat_items(stream_events(spark, folder, 1))
    counters.run(counters.start_totals(stream, {"category": F.col("category")}, out))
    assert rows(counters.newest_totals(spark, out, ["category"])) == rows(sketches.category_totals(items))
    out = run_dir(spark, "test-stream")
    counters.run(counters.start_count_min(stream, out, 50, 3))
    found = counters.newest_totals(spark, out, ["row", "bucket"])
    assert rows(found) == rows(sketches.count_min(items, width=50, depth=3))


def test_summary_over_batches_keeps_its_bounds(spark, folder, whole):
    out = run_dir(spark, "test-stream")
    counters.run(counters.start_space_saving(flat_items(stream_events(spark, folder, 1)), 4, out))
    truth = {r["product_id"]: r["units"] for r in sketches.product_counts(flat_items(whole)).collect()}
    found = counters.last_stored(spark, out).collect()
    assert 0 < len(found) <= 4
    for row in found:
        assert row["count"] - row["error"] <= truth[row["item"]] <= row["count"]
        assert row["error"] <= 300 / 4


def test_recent_buffer_and_callback(spark, folder, whole, rows):
    out = run_dir(spark, "test-stream")
    stream = stream_events(spark, folder, 1)
    counters.run(counters.start_recent(stream, 20, out))
    assert rows(counters.last_stored(spark, out), "transaction_id") == rows(ticker.recent(whole, 20), "transaction_id")
    seen = []

    def fail_once(batch):
        seen.append(batch.count())
        if len(seen) == 1:
            raise RuntimeError("not now")

    counters.run(counters.start_callback(stream, fail_once, run_dir(spark, "test-stream")))
    assert seen == [60] * 5


def test_a_batch_run_twice_counts_once(spark, folder, rows):
    out = run_dir(spark, "test-stream")
    counters.run(counters.start_totals(flat_items(stream_events(spark, folder, 1)), {"category": F.col("category")}, out))
    before = rows(counters.newest_totals(spark, out, ["category"]))
    last = spark.read.parquet(f"{out}/batches/batch_id=4").collect()
    again = spark.createDataFrame(last, "category string, units long")
    counters._write_batches(out, ["category"])(again, 4)
    assert rows(counters.newest_totals(spark, out, ["category"])) == before


def test_rows_beyond_the_retention_are_dropped(spark, tmp_path):
    old, new = datetime(2024, 1, 1, 0, 10), datetime(2024, 1, 3, 0, 10)
    path = str(tmp_path / "late")
    files = [[event(0, old, 1)], [event(1, new, 1)], [event(2, new, 1)], [event(3, old, 1)]]
    write_files(spark, path, files)
    out = run_dir(spark, "test-stream")
    counters.run(counters.start_period_totals(flat_items(stream_events(spark, path, 1)), "hour", out))
    found = {r["hour"]: r["units"] for r in counters.newest_totals(spark, out, ["hour", "product_id"]).collect()}
    assert found == {"2024-01-01 00:00": 1, "2024-01-03 00:00": 2}


def test_batch_and_stream_read_the_same_files(spark, folder, rows, tmp_path):
    assert open_events(spark, folder).count() == 300
    one = str(tmp_path / "one")
    files = spark.read.parquet(f"{folder}/events.parquet").coalesce(1)
    files.write.parquet(f"{one}/out")
    import glob
    import shutil

    shutil.copyfile(glob.glob(f"{one}/out/part-*")[0], f"{one}/events.parquet")
    out = run_dir(spark, "test-stream")
    counters.run(counters.start_totals(flat_items(stream_events(spark, one)), {"category": F.col("category")}, out))
    assert open_events(spark, one).count() == 300
    assert rows(counters.newest_totals(spark, out, ["category"])) == rows(sketches.category_totals(flat_items(open_events(spark, folder))))


def test_an_empty_stream_reads_as_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/events.parquet")
    stream = stream_events(spark, path)
    outs = [run_dir(spark, "test-stream") for _ in range(4)]
    counters.run(counters.start_period_totals(flat_items(stream), "hour", outs[0]))
    counters.run(counters.start_space_saving(flat_items(stream), 5, outs[1]))
    counters.run(counters.start_recent(stream, 5, outs[2]))
    counters.run(counters.start_rate(stream, outs[3]))
    assert counters.newest_totals(spark, outs[0], ["hour", "product_id"]).count() == 0
    assert counters.retained_totals(spark, outs[0], "hour").count() == 0
    assert counters.last_stored(spark, outs[1]).count() == counters.last_stored(spark, outs[2]).count() == 0
    assert counters.sliding_rates(spark, outs[3], 5).count() == 0


def test_a_read_opens_few_folders_after_many_batches(spark, rows):
    out, total = run_dir(spark, "test-stream"), {}
    write = counters._write_batches(out, ["key"])
    for i in range(37):
        total.update({i % 7: i, i: 2 * i})
        write(spark.createDataFrame([(i % 7, i), (i, 2 * i)] if i >= 7 else [(i, 2 * i)], "key long, units long"), i)
        if i in (9, 20):  # run again after a failure
            write(spark.createDataFrame([(i % 7, i), (i, 2 * i)], "key long, units long"), i)
    for i in range(7):
        total[i] = max(x for x in range(37) if x % 7 == i)
    assert dict(rows(counters.newest_totals(spark, out, ["key"]))) == total
    assert len(counters._numbers(spark, f"{out}/batches")) <= 2 * counters.BASE_EVERY
    assert len(counters._numbers(spark, f"{out}/bases")) == 2


def test_hours_past_retention_leave_the_result(spark, tmp_path):
    start = datetime(2024, 1, 1, 0, 30)
    path = str(tmp_path / "long")
    write_files(spark, path, [[event(h, start + timedelta(hours=h), 1)] for h in range(0, 60, 10)])
    out = run_dir(spark, "test-stream")
    counters.run(counters.start_period_totals(flat_items(stream_events(spark, path, 1)), "hour", out))
    hours = sorted(r["hour"] for r in counters.retained_totals(spark, out, "hour").collect())
    assert hours == ["2024-01-02 06:00", "2024-01-02 16:00", "2024-01-03 02:00"]
    assert counters.newest_totals(spark, out, ["hour", "product_id"]).count() == 6


def test_a_live_trigger_keeps_running(spark, folder):
    out = run_dir(spark, "test-stream")
    query = counters.start_totals(
        flat_items(stream_events(spark, folder, 1)), {"category": F.col("category")}, out, trigger={"processingTime": "1 second"}
    )
    try:
        query.processAllAvailable()
        assert query.isActive and counters.newest_totals(spark, out, ["category"]).agg(F.sum("units")).first()[0] == 300
    finally:
        query.stop()


@pytest.mark.parametrize("minutes", [1, 5, 60])
def test_rates_come_from_one_row_a_minute(spark, folder, whole, minutes):
    out = run_dir(spark, "test-stream")
    counters.run(counters.start_rate(stream_events(spark, folder, 1), out))
    panes = counters.newest_totals(spark, out, ["minute"], "n")
    assert panes.count() == whole.select(F.date_trunc("minute", "timestamp")).distinct().count()
    want = {}
    for r in whole.select(F.date_trunc("minute", "timestamp").alias("m")).collect():
        for i in range(1, minutes + 1):
            end = r["m"] + timedelta(minutes=i)
            want[end] = want.get(end, 0) + 1
    got = {r["until"]: r["per_minute"] for r in counters.sliding_rates(spark, out, minutes).collect()}
    assert got == {k: pytest.approx(n / minutes) for k, n in want.items()}
