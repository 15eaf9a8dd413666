"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
The stored tables are built twice from the given ones (``build_*``), then every
query runs twice. The faster run counts; the first one, on a JVM that has not
compiled the plan yet, is given under ``first_run``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.catalog.queries import REGISTERED, fresh_warehouse, warehouse
from tidemark.session import local_session

TABLES = [
    "staged", "observations", "dim_agency", "dim_geography", "dim_complaint_type", "fact", "durations", "agency_month",
    "cohort_maturity", "bi_wide", "drift_log",
]
# Reports and operators over those tables; none of them only reads one back.
HEADLINE = [
    "landing_profile", "latest_per_key", "dq_ledger",
    "bi_export", "bi_reaggregate", "agency_performance", "append_only_table", "merge_table",
    "table_disagreement", "maturity_sensitivity", "status_disagreement",
    "snapshot_diff", "field_change_counts", "systematic_sample", "checks_summary",
]


def build(make, spark, sf_dir: str) -> dict[str, float]:
    """Build every stored table from the given ones into a new store."""
    took = {}
    began = time.perf_counter()
    w = make(spark, sf_dir)
    took["build_landing"] = round(time.perf_counter() - began, 3)
    for table in TABLES:
        began = time.perf_counter()
        getattr(w, table)
        took[f"build_{table}"] = round(time.perf_counter() - began, 3)
    return took


def run(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    cold = build(fresh_warehouse, spark, sf_dir)
    again = build(warehouse, spark, sf_dir)
    timings = {name: min(cold[name], again[name]) for name in cold}

    for name in HEADLINE:
        first, second = run(spark, name, sf_dir), run(spark, name, sf_dir)
        timings[name], cold[name] = min(first, second), first
        print(f"{name} {second:.2f} (first run {first:.2f})", file=sys.stderr)

    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "first_run": cold,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
