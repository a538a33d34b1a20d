"""Every query that SQL can express gives the same rows as its SQL twin, on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from stockloom.plans import catalog
from tests.twins import compare, connect

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
PLANS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    message, _ = compare(spark, con, name, PLANS[name], SQL[name], FOLDER)
    assert message is None, message


#: Queries that learn or sketch, and the query with a twin that runs them and checks what must hold of them.
CHECKED_BY = {
    "forecast_7d": "forecast_checks", "forecast_quality": "forecast_quality_checks", "forecast_low_stock": "forecast_low_stock_checks",
    "anomaly_score": "anomaly_checks", "top_anomalies": "top_anomalies_checks", "spoilt_items": "spoilt_items_checks",
    "inventory_report": "inventory_report_checks", "elbow": "elbow_checks", "segments": "segment_checks",
    "segment_sizes": "segment_sizes_checks", "segment_centers": "segment_centers_order", "space_saving_topk": "space_saving_violations",
}


def test_queries_without_a_twin_are_checked_by_one_with():
    assert set(catalog.QUERIES) - set(catalog.TWINS) == set(CHECKED_BY)
    assert set(CHECKED_BY.values()) <= set(SQL)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(PLANS)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10
