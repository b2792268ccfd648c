"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; the median run is reported per query, after an
untimed warm-up pass).
Each query runs to completion through the no-op sink (full plan, no collect).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kestrel.plans.etl import etl_report  # noqa: E402
from kestrel.plans.registry import all_queries  # noqa: E402
from kestrel.session import build_session, scratch_path  # noqa: E402
from kestrel.sources.raw_model import write_raw  # noqa: E402

HEADLINE = [
    "revenue_by_month", "revenue_by_category", "state_performance", "kpi_row", "on_time_rate",
    "top5_categories", "late_by_state", "sellers_five_star", "top5_states_revenue", "payment_totals_with_null",
    "clean_items", "clean_orders", "impute_dimensions", "fk_filter", "profile_tables", "load_validate",
    "session_prompt", "cache_hits", "latency_percentiles_by_type", "request_metrics", "rate_limit_breaches",
    "guarded_adhoc", "stream_rate_limit",
]
WARMUP = ["kpi_row", "revenue_by_month", "request_metrics"]
BASELINE_ETL_ROWS_PER_SEC = round(569_703 / 90, 1)


def time_etl(spark, sf_dir: str, repeat: int) -> tuple[float, int]:
    """Median seconds of the whole ETL over raw CSV files (written beforehand, untimed), and the rows it loads."""
    root = scratch_path(spark, f"bench-etl-{uuid.uuid4().hex[:12]}")
    raw = write_raw(spark, sf_dir, f"{root}/raw")
    runs, loaded = [], 0
    for k in range(repeat):
        t0 = time.perf_counter()
        report = etl_report(spark, raw, f"{root}/clean-{k}").collect()
        runs.append(time.perf_counter() - t0)
        loaded = sum(r.actual for r in report if r.expected is not None)
    return statistics.median(runs), loaded


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    extra = {"spark.ui.enabled": "false"}
    if os.environ.get("BENCH_DRIVER_MEMORY"):
        # Local mode runs every task in the driver JVM; size its heap.
        extra["spark.driver.memory"] = os.environ["BENCH_DRIVER_MEMORY"]
    spark = build_session(f"local[{cpus}]", cpus * 2, app_name="kestrel-bench", extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    # Warm the JVM (JIT, class loading, file metadata) once, untimed: the
    # numbers are warm medians.
    for name in WARMUP:
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    etl_sec, etl_rows = time_etl(spark, sf_dir, max(1, repeat - 1))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        # CSV parsing, cleaning, imputation, foreign keys, load, validation and marts; rows as loaded.
        "etl_full_sec": round(etl_sec, 3),
        "etl_loaded_rows": etl_rows,
        "etl_rows_per_sec": round(etl_rows / etl_sec, 1),
        "baseline_etl_rows_per_sec": BASELINE_ETL_ROWS_PER_SEC,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
