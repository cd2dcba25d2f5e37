"""Time the headline queries and print one JSON line.

Every query is run to the end (a no-op sink), including the building of its plan.
``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_QUERIES`` (comma separated) override
the folder, the number of cores and the list.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.contracts import CONTRACTS  # noqa: E402
from tidemark.plans.catalog import QUERIES, workspace  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "current_order_item",
    "current_argmax",
    "revenue_by_bu_day",
    "payment_funnel_day",
    "discount_effectiveness",
    "discount_baseline_day",
    "asof_price",
    "item_margin_daily",
    "order_360",
    "stock_coverage",
    "stockout_candidates",
    "customer_metrics",
    "customer_cohort",
    "idle_catalog",
    "dq_overview",
    "orphan_summary",
    "rfm_scores",
    "core_upsert",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executors
    space = workspace(spark, folder)
    for entity in CONTRACTS:  # stored state tables are there before a panel reads them
        space.lake.state(entity)
    times: dict[str, float] = {}
    for name in names:
        begun = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
