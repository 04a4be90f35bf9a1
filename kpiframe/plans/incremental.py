"""Dashboard refresh by month: only the months that changed are computed and written again.

``report.refresh`` rebuilds every table. Here each view and each KPI with a date is stored by
month, and a refresh

1. compares the files of the source tables with those of the last refresh; new, changed and
   removed files name the months to do (a changed dimension: all of them);
2. computes the views for those months only (the fact scan gets the date ranges as a pushed
   filter) and overwrites their partitions;
3. does the same for every KPI whose rows depend on their own month alone;
4. numbers surveys again from the first changed month on, counting on from the last number of
   the months before;
5. rebuilds KPIs without a date (latest values, training), from the views, only if what they
   read has changed;
6. records the files, last: a refresh that failed half-way is done again by the next one.

usage: python -m kpiframe.plans.incremental <sf_dir> <out_dir>
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiframe.functions.dates import month_start
from kpiframe.plans import views as V
from kpiframe.plans.report import KPIS
from kpiframe.sources.store import delete_path, exists, hadoop, read_text, replace_text
from kpiframe.sources.tables import table

STATE = "_state"
MONTH = "month"
#: rows without a date are a month of their own; Spark's name for its partition
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"

#: fact table: (its date column, the view it feeds, the view's date column)
FACTS = {"lineitem": ("l_shipdate", "facility_month", "period"),
         "events": ("ts", "kpi_panel", "date")}
DIMENSIONS = {"facility_month": ["supplier", "nation", "region"], "kpi_panel": [],
              "training": ["customer", "nation", "region"]}
#: KPIs whose rows of a month come from the view's rows of that month
MONTHLY = {"referral": "facility_month", "stockout_combined": "facility_month",
           "stockout_by_item": "facility_month", "case_counts": "facility_month",
           "completeness": "facility_month", "series": "kpi_panel", "bars": "kpi_panel",
           "density": "kpi_panel"}
#: KPIs that count on from the months before
RUNNING = {"surveys": ("kpi_panel", "adm0", "survey")}
#: KPIs without a date
WHOLE = {"latest_share": "kpi_panel", "training_base": "training",
         "trained_by_gender": "training", "equipped_by_gender": "training",
         "pct_equipped": "training", "target_reached": "training"}


def _files(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """{file: [bytes, time]} of a table's data files."""
    fs = hadoop(spark)
    root = fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    out = {}
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out[f.getPath().toString()] = [f.getLen(), f.getModificationTime()]
    return out


def _months_of(spark: SparkSession, files: list[str], date: str) -> dict[str, list[str]]:
    """{file: its months}: one row per file and month comes to the driver, which lists the
    files anyway."""
    if not files:
        return {}
    rows = spark.read.parquet(*files).select(
        F.col("_metadata.file_path").alias("f"), month_start(date).alias("m")).distinct()
    # compared by name: a store may spell the scheme in another way
    name = {f.rsplit(":", 1)[-1].lstrip("/"): f for f in files}
    out: dict[str, list[str]] = {f: [] for f in files}
    for r in rows.collect():
        out[name[r.f.rsplit(":", 1)[-1].lstrip("/")]].append(_name(r.m))
    return out


def _name(month: dt.date | None) -> str:
    return NO_MONTH if month is None else month.isoformat()


def _month(name: str) -> dt.date | None:
    return None if name == NO_MONTH else dt.date.fromisoformat(name)


def _next(month: dt.date) -> dt.date:
    return dt.date(month.year + month.month // 12, month.month % 12 + 1, 1)


def in_months(c: Column, months: list[dt.date | None]) -> Column:
    """Whether a date or timestamp lies in one of ``months`` (first days; None: it is missing):
    a range for each run of adjoining months, which a Parquet scan gets as a pushed filter."""
    runs: list[list[dt.date]] = []
    for m in sorted(m for m in months if m is not None):
        if runs and runs[-1][1] == m:
            runs[-1][1] = _next(m)
        else:
            runs.append([m, _next(m)])
    return reduce(lambda a, b: a | b, [(c >= F.lit(lo)) & (c < F.lit(hi)) for lo, hi in runs],
                  c.isNull() if None in months else F.lit(False))


def _partitions(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """{month: files} of a table stored by month."""
    if not exists(spark, path):
        return {}
    out: dict[str, set[str]] = {}
    for f in _files(spark, path):
        folder, name = f.rsplit("/", 2)[1:]
        if folder.startswith(f"{MONTH}="):
            out.setdefault(folder[len(MONTH) + 1:], set()).add(name)
    return out


def _write_months(df: DataFrame, path: str, months: list[dt.date | None]) -> list[str]:
    """Replace the partitions of ``months`` by the rows of ``df``, which holds no others; a
    month without rows any more loses its partition. Returns the months written."""
    spark = df.sparkSession
    before = _partitions(spark, path)
    # one task per month; rows of a month are an aggregate
    df.repartition(F.col(MONTH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(MONTH).parquet(path)
    after = _partitions(spark, path)
    for m in map(_name, months):
        if m in before and after.get(m) == before[m]:
            delete_path(spark, f"{path}/{MONTH}={m}")
    return sorted(m for m, names in after.items() if names != before.get(m))


def read_output(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A KPI (or ``views/<view>``) as the last refresh left it."""
    path = f"{out_dir.rstrip('/')}/{name if '/' in name else 'kpis/' + name}"
    df = spark.read.parquet(path)
    return df.drop(MONTH)


def _by_month(df: DataFrame) -> DataFrame:
    date = "period" if "period" in df.columns else "date"
    return df.withColumn(MONTH, month_start(date))


def refresh_months(spark: SparkSession, sf_dir: str, out_dir: str,
                   parallel: int = 4) -> dict[str, list[str]]:
    """Bring the views and KPI tables under ``out_dir`` up to date with the source tables.

    Source tables are Parquet files or folders of them. Returns {table: months written} of
    what was written (``[]`` for tables that are not stored by month). One refresh at a time.
    """
    out_dir, state_path = out_dir.rstrip("/"), f"{out_dir.rstrip('/')}/{STATE}"
    text = read_text(spark, state_path)
    old = json.loads(text) if text else {"files": {}, "months": {}}
    names = [*FACTS, *sorted({d for ds in DIMENSIONS.values() for d in ds})]
    files = {n: _files(spark, f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}
    changed = {n for n in names if files[n] != old["files"].get(n)}

    months: dict[str, dict[str, list[str]]] = {}
    to_do: dict[str, list[dt.date | None]] = {}
    for fact, (date, view, _) in FACTS.items():
        known, held = old["files"].get(fact, {}), old["months"].get(fact, {})
        fresh = [f for f, stat in files[fact].items() if known.get(f) != stat]
        months[fact] = {f: held[f] for f in files[fact] if f not in set(fresh)}
        months[fact].update(_months_of(spark, fresh, date))
        touched = {m for f in fresh for m in months[fact][f]}
        # months that a file held before it changed or went
        touched |= {m for f, ms in held.items() if f in set(fresh) or f not in files[fact]
                    for m in ms}
        if changed & set(DIMENSIONS[view]):
            touched |= {m for ms in [*months[fact].values(), *held.values()] for m in ms}
        to_do[view] = [_month(m) for m in sorted(touched)]

    written: dict[str, list[str]] = {}

    def run(jobs):
        """Independent writes as concurrent Spark jobs; the first failure is raised."""
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            for name, job in [(n, pool.submit(j)) for n, j in jobs.items()]:
                written[name] = job.result()

    def view_of(view: str, chosen: list) -> DataFrame:
        fact, date = next((f, d) for f, (d, v, _) in FACTS.items() if v == view)
        rows = table(spark, sf_dir, fact).filter(in_months(F.col(date), chosen))
        build = V.facility_month if view == "facility_month" else V.kpi_panel
        return _by_month(build(spark, sf_dir, **{fact: rows}))

    def whole(df: DataFrame, path: str):
        df.write.mode("overwrite").parquet(path)
        return []

    training_changed = bool(changed & set(DIMENSIONS["training"]))
    jobs = {f"views/{v}": (lambda v=v, ms=ms: _write_months(
        view_of(v, ms), f"{out_dir}/views/{v}", ms)) for v, ms in to_do.items() if ms}
    if training_changed:
        jobs["views/training"] = lambda: whole(V.training(spark, sf_dir), f"{out_dir}/views/training")
    run(jobs)

    def stored_view(view: str) -> DataFrame:
        return spark.read.parquet(f"{out_dir}/views/{view}")

    def monthly(name: str, view: str):
        chosen = to_do[view]
        rows = stored_view(view).filter(in_months(F.col(MONTH), chosen)).drop(MONTH)
        return _write_months(_by_month(KPIS[name]({view: rows})), f"{out_dir}/kpis/{name}", chosen)

    def running(name: str, view: str, by: str, number: str):
        path, chosen = f"{out_dir}/kpis/{name}", to_do[view]
        held, rows = _partitions(spark, path), stored_view(view)
        # rows without a date come first: if they change, all numbers do
        first = None if None in chosen else min(chosen)
        if first is not None:
            rows = rows.filter(F.col(MONTH) >= F.lit(first))
        new = KPIS[name]({view: rows.drop(MONTH)})
        stay = {m for m in held if first is not None and (m == NO_MONTH or _month(m) < first)}
        if stay:
            before = (spark.read.parquet(path).filter(F.coalesce(F.col(MONTH) < F.lit(first), F.lit(True)))
                      .groupBy(F.col(by).alias("_by")).agg(F.max(number).alias("_n")))
            new = new.join(before, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn(
                number, F.col(number) + F.coalesce(F.col("_n"), F.lit(0))).drop("_by", "_n")
        # all months that follow are numbered anew
        return _write_months(_by_month(new), path,
                             [*{_month(m) for m in held if m not in stay} | set(chosen)])

    jobs = {n: (lambda n=n, v=v: monthly(n, v)) for n, v in MONTHLY.items() if to_do[v]}
    jobs |= {n: (lambda n=n, a=a: running(n, *a)) for n, a in RUNNING.items() if to_do[a[0]]}
    jobs |= {n: (lambda n=n, v=v: whole(KPIS[n]({v: stored_view(v)}), f"{out_dir}/kpis/{n}"))
             for n, v in WHOLE.items() if (training_changed if v == "training" else to_do[v])}
    run(jobs)
    replace_text(spark, state_path, json.dumps({"files": files, "months": months}))
    return written


def main(argv: list[str]) -> None:
    from kpiframe.session import get_session

    spark = get_session()
    for name, done in sorted(refresh_months(spark, argv[1], argv[2]).items()):
        print(name, *done)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
