"""Dashboard refresh job: every KPI table of the dashboards in one run.

The dashboards build their base tables once (the combined facility report,
the grouped training table, the country panel) and draw every chart from
them. The Spark job does the same:

1. the three views are written once as Parquet under ``out_dir/views``,
   which also cuts the lineage;
2. every KPI is computed from those files and written to ``out_dir/kpis/<name>``.

The fact tables are therefore scanned once per refresh, however many KPIs are
built from them, and a lost executor only re-runs the step it was in.

usage: python -m kpiframe.plans.report <sf_dir> <out_dir>
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from kpiframe import functions as X
from kpiframe.plans import kpis as K
from kpiframe.plans import panels as P
from kpiframe.plans import views as V
from kpiframe.plans.params import DISTRICT_TARGETS, NATIONAL_TARGET, STOCK_ITEMS

Views = dict[str, DataFrame]

KPIS: dict[str, Callable[[Views], DataFrame]] = {
    # facility report
    "referral": lambda v: K.referral(v["facility_month"], V.MANAGED_COLUMNS),
    "stockout_combined": lambda v: K.stockout_combined(v["facility_month"], V.STOCK_COLUMNS),
    "stockout_by_item": lambda v: K.stockout_by_item(v["facility_month"], STOCK_ITEMS),
    "case_counts": lambda v: K.case_counts(v["facility_month"],
                                           V.MANAGED_COLUMNS + V.REFERRED_COLUMNS),
    "completeness": lambda v: K.completeness(v["facility_month"]),
    # training
    "training_base": lambda v: K.training_base(v["training"]),
    "trained_by_gender": lambda v: K.trained_by_gender(K.training_base(v["training"]), "trained"),
    "equipped_by_gender": lambda v: K.trained_by_gender(K.training_base(v["training"]),
                                                        "equipped"),
    "pct_equipped": lambda v: K.pct_equipped(K.training_base(v["training"])),
    "target_reached": lambda v: K.target_reached(K.training_base(v["training"]),
                                                 DISTRICT_TARGETS, NATIONAL_TARGET),
    # country panel
    "series": lambda v: P.kpi_series(v["kpi_panel"], ["n_events", "n_users", "n_large"]),
    "bars": lambda v: P.kpi_bars(v["kpi_panel"], "n_large"),
    "surveys": lambda v: P.kpi_surveys(v["kpi_panel"], "n_large"),
    "latest_share": lambda v: P.kpi_latest_share(
        v["kpi_panel"], X.percent_of("n_large", "n_events", 2), name="pct_large"),
    "density": lambda v: P.kpi_density(v["kpi_panel"], "n_large", "n_events", hi=1000.0),
}


def _write_all(jobs: dict[str, tuple[DataFrame, str]], parallel: int) -> None:
    """Write independent results as concurrent Spark jobs (the scheduler
    shares the executors between them); the first failure is raised."""
    def write(item):
        df, path = item
        df.write.mode("overwrite").parquet(path)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        for f in [pool.submit(write, item) for item in jobs.values()]:
            f.result()


def materialise_views(spark: SparkSession, sf_dir: str, out_dir: str,
                      parallel: int = 3) -> Views:
    """Write the three base views once and return them read back from Parquet."""
    built = {"facility_month": V.facility_month(spark, sf_dir),
             "training": V.training(spark, sf_dir),
             "kpi_panel": V.kpi_panel(spark, sf_dir)}
    paths = {name: f"{out_dir}/views/{name}" for name in built}
    _write_all({n: (df, paths[n]) for n, df in built.items()}, parallel)
    return {n: spark.read.parquet(paths[n]).select(*df.columns) for n, df in built.items()}


def refresh(spark: SparkSession, sf_dir: str, out_dir: str, kpis=None,
            parallel: int = 4) -> dict[str, str]:
    """Rebuild the views and every KPI table; returns {kpi: output path}.
    ``parallel`` independent writes run at a time."""
    out_dir = out_dir.rstrip("/")
    views = materialise_views(spark, sf_dir, out_dir)
    names = list(kpis or KPIS)
    written = {name: f"{out_dir}/kpis/{name}" for name in names}
    _write_all({n: (KPIS[n](views), written[n]) for n in names}, parallel)
    return written


def main(argv: list[str]) -> None:
    from kpiframe.session import get_session

    sf_dir, out_dir = argv[1], argv[2]
    spark = get_session()
    for name, path in refresh(spark, sf_dir, out_dir).items():
        print(name, path)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
