"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is built and written in full to the noop sink. A few queries run first, unmeasured, to
warm the JVM. Then each query runs $BENCH_RUNS times (3) and the median counts; one whose first run
takes more than 10 seconds is left at that run. So is one whose first run made a model or a graph that
later queries find (see stockloom/sources/kept.py): its time includes the making. The bench starts without any.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from stockloom.plans import catalog
from stockloom.session import local_session
from stockloom.sources import kept

HEADLINE = [
    "top_products", "top_categories", "dashboard_kpis", "sales_by_period_day",
    "sales_pivot", "flat_fact", "join_star", "stock_after_sales", "fk_orphans", "promo_price", "baskets",
    "nested_transactions", "rfm", "rfm_scaled", "segments", "sales_consistency", "spoilage_features",
    "anomaly_score", "forecast_features", "low_stock", "item_support", "frequent_itemsets", "association_rules",
    "rule_recs", "co_purchase_edges", "page_rank", "content_recs", "hybrid_recs", "basket_recs",
    "tfidf_documents", "hourly_top_n", "hourly_series", "demand_index", "cms_estimate",
    "space_saving_topk", "stream_hourly_totals", "stream_space_saving", "collab_recs", "category_recs",
    "forecast_quality", "forecast_7d", "forecast_low_stock", "elbow",
]

# Unmeasured: joins, windows, Python workers.
WARM_UP = ["join_star", "sales_pivot", "rfm", "space_saving_topk"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=cores)

    def once(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    kept.forget(spark)
    for name in WARM_UP:
        once(name)
    for name in names:
        before = kept.names(spark)
        times = [once(name)]
        if times[0] <= 10 and kept.names(spark) == before:
            times += [once(name) for _ in range(runs - 1)]
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": int(cores),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
