"""Benchmark the headline KPI queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` (default 8): a warm-up pass over all queries, then the median of
``$BENCH_REPEATS`` (default 5) timed runs. A run executes the whole plan and
discards the rows (``noop`` sink), so nothing is collected to the driver.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kpiframe.plans.catalog import REGISTRY  # noqa: E402
from kpiframe.plans.report import refresh  # noqa: E402
from kpiframe.session import get_session, scratch_path  # noqa: E402

HEADLINE = [
    "facility_month",
    "kpi_referral",
    "kpi_stockout_by_item",
    "kpi_stockout_combined",
    "kpi_case_counts",
    "kpi_completeness",
    "kpi_target_reached",
    "kpi_pct_equipped",
    "kpi_latest_share",
    "kpi_surveys",
    "kpi_trained_vs_target",
    "panel_grid",
    "histogram",
    "group_total",
    "join_left_nullsafe",
    "entity_page",
]
# end-to-end jobs, reported apart from the per-query total
JOBS = ["dashboard_refresh"]


def run_once(spark, key: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    if key == "dashboard_refresh":
        # end to end: views written once, every KPI table written from them
        refresh(spark, sf_dir, scratch_path(spark, "bench_refresh"))
    else:
        REGISTRY[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def calibration() -> float:
    """Seconds of a fixed loop: tells a slow host from a slow query."""
    t0 = time.perf_counter()
    sum(range(20_000_000))
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    keys = sys.argv[1:] or HEADLINE
    jobs = [k for k in keys if k in JOBS] or ([] if sys.argv[1:] else JOBS)
    keys = [k for k in keys if k not in JOBS]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                        extra={"spark.driver.memory": "16g"})
    # per-query timings first; the write-heavy end-to-end job runs after them
    # so its clean-up cannot land inside a query's measurement
    for key in keys:  # warm-up pass: JIT, file listing, code generation
        run_once(spark, key, sf_dir)
    times: dict[str, float] = {}
    loops = [calibration()]
    for key in keys:
        times[key] = round(statistics.median(run_once(spark, key, sf_dir)
                                             for _ in range(repeats)), 4)
    loops.append(calibration())
    job_times = {}
    for key in jobs:
        run_once(spark, key, sf_dir)
        job_times[key] = round(statistics.median(run_once(spark, key, sf_dir)
                                                 for _ in range(repeats)), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_kpi_total_median_sec",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "jobs": job_times,
        "calibration_loop_sec": [round(x, 4) for x in loops],
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
