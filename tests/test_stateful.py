"""State by key: what ends, ends exactly, and a restart goes on."""

from datetime import datetime, timedelta


from stockloom.operators import ticker
from stockloom.operators.scans import flat_items
from stockloom.session import run_dir
from stockloom.sources.tables import open_events, stream_events
from stockloom.streaming import counters, stateful
from tests.test_streaming import SCHEMA, event, write_files


def started(spark, path, period, out):
    counters.run(stateful.start_open_periods(flat_items(stream_events(spark, path, 1)), period, out))
    return sorted((r[period], r["product_id"], r["units"]) for r in stateful.open_totals(spark, out, period).collect())


def plain(spark, path, period):
    lines = flat_items(open_events(spark, path))
    count = {"hour": 24, "day": 30}[period]
    return sorted((r[period], r["product_id"], r["units"]) for r in ticker.retained(ticker.product_totals(lines, period), lines, period, count).collect())


def test_open_hours_equal_batch_and_a_restart_goes_on(spark, tmp_path):
    start, path, out = datetime(2024, 1, 1, 0, 30), str(tmp_path / "in"), run_dir(spark, "test-state")
    data = [event(i, start + timedelta(minutes=41 * i), i * i % 5) for i in range(90)]
    write_files(spark, path, [data[:30], data[30:60]])
    assert started(spark, path, "hour", out) == plain(spark, path, "hour")
    spark.createDataFrame(data[60:], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    assert started(spark, path, "hour", out) == plain(spark, path, "hour")  # from the checkpoint, with the earlier sums


def test_what_is_late_is_dropped_at_the_hour(spark, tmp_path):
    day = datetime(2024, 1, 2)
    path, out = str(tmp_path / "late"), run_dir(spark, "test-state")
    # the newest row is of 10 o'clock, so the hour from 10 on the day before is the last one open
    files = [
        [event(0, day - timedelta(hours=14), 1), event(1, day - timedelta(hours=15), 1)],  # 10:00 and 9:00 the day before
        [event(2, day + timedelta(hours=10, minutes=59), 1)],
        [event(3, day - timedelta(hours=14), 1), event(4, day - timedelta(hours=14, minutes=1), 1)],  # 10:00 is open, 9:59 is not
    ]
    write_files(spark, path, files)
    assert started(spark, path, "hour", out) == [("2024-01-01 10:00", 1, 2), ("2024-01-02 10:00", 1, 1)]
    gone = counters.newest_totals(spark, out, ["hour", "product_id"]).filter("units is null").collect()
    assert [r["hour"] for r in gone] == ["2024-01-01 09:00"]


def test_days_end_after_thirty(spark, tmp_path):
    start, path, out = datetime(2024, 1, 1, 12), str(tmp_path / "days"), run_dir(spark, "test-state")
    write_files(spark, path, [[event(i, start + timedelta(days=d), 1) for i, d in enumerate(range(a, a + 14))] for a in (0, 14, 28)])
    found = started(spark, path, "day", out)
    assert found == plain(spark, path, "day") and found[0][0] == "2024-01-12" and len(found) == 31


def test_nothing_yet(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/events.parquet")
    assert started(spark, path, "hour", run_dir(spark, "test-state")) == []


def test_the_session_keeps_its_own_store(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    path = str(tmp_path / "own")
    write_files(spark, path, [[event(0, datetime(2024, 1, 1), 1)]])
    started(spark, path, "hour", run_dir(spark, "test-state"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
