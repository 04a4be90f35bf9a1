"""Skew check: one supplier is given a third of all line items, then the facility
view, the referral KPI and a naive join-then-aggregate plan run with an event
log; per-stage shuffle records per task show whether one task gets the hot key.

usage: python tools/skew_check.py <sf_dir> <scratch_dir>
(``scratch_dir`` must be new and empty; broadcasts are disabled so every join
shuffles.)
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from kpiframe.plans import kpis as K  # noqa: E402
from kpiframe.plans import views as V  # noqa: E402
from kpiframe.session import get_session  # noqa: E402

HOT_SUPPLIER = 7


def make_skewed(spark, src: str, dst: str) -> None:
    li = spark.read.parquet(f"{src}/lineitem.parquet")
    hot = F.when(F.col("l_orderkey") % 3 == 0, F.lit(HOT_SUPPLIER).cast("long")) \
        .otherwise(F.col("l_suppkey"))
    li.withColumn("l_suppkey", hot).repartition(16).write.parquet(f"{dst}/lineitem.parquet")
    for t in ["supplier", "nation", "region"]:
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{dst}/{t}.parquet")


def naive(spark, d: str):
    """Join first, aggregate after: the hot supplier's rows all meet in one task."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    sup = spark.read.parquet(f"{d}/supplier.parquet")
    return li.join(sup, li.l_suppkey == sup.s_suppkey).groupBy(
        "s_name", F.trunc(F.to_date("l_shipdate"), "month").alias("period")).agg(
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))


def main():
    src, scratch = sys.argv[1], sys.argv[2]
    events = f"{scratch}/events"
    os.makedirs(events, exist_ok=True)
    spark = get_session("local[8]", 8, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": events,
        "spark.eventLog.compress": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"})
    sc = spark.sparkContext
    d = f"{scratch}/skew"
    make_skewed(spark, src, d)
    runs = {"facility_month": lambda: V.facility_month(spark, d),
            "kpi_referral": lambda: K.referral(V.facility_month(spark, d), V.MANAGED_COLUMNS),
            "naive_join_then_agg": lambda: naive(spark, d)}
    for name, fn in runs.items():
        sc.setJobGroup(name, name)
        fn().write.format("noop").mode("overwrite").save()
    spark.stop()
    path = [p for p in glob.glob(f"{events}/**/*", recursive=True)
            if "events" in os.path.basename(p)][0]
    group, tasks = {}, {}
    with open(path) as fh:
        for line in fh:
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                g = e.get("Properties", {}).get("spark.jobGroup.id")
                for sid in e["Stage IDs"]:
                    group[sid] = g
            elif e["Event"] == "SparkListenerTaskEnd":
                rd = (e.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                tasks.setdefault(e["Stage ID"], []).append(rd.get("Total Records Read", 0))
    print("| run | stage | tasks | max records/task | median | total | max share |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for sid, recs in sorted(tasks.items()):
        if group.get(sid) in runs and sum(recs):
            print(f"| {group[sid]} | {sid} | {len(recs)} | {max(recs)} | "
                  f"{int(statistics.median(recs))} | {sum(recs)} | {max(recs) / sum(recs):.2f} |")


if __name__ == "__main__":
    main()
