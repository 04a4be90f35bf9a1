"""Views that give the star-schema tables the shapes the KPI queries read.

* ``facility_month``: one row per (province, district, facility, month) with
  stock balances, managed and referred case counts and report counts, built
  from lineitem ⋈ supplier ⋈ nation ⋈ region.
* ``training``: one trained person per customer row, with province, district,
  cadre and whether work tools were handed over.
* ``kpi_panel``: a wide per-(entity, day) panel with gaps, from events.

Each view has a DuckDB twin in ``kpiframe.plans.sql`` with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiframe.functions.dates import month_name, month_start
from kpiframe.sources.tables import table

# Fixed mapping of the test tables onto the facility report: return flag A/N/R
# is the stock item and (with line status O = managed, F = referred) the
# disease of a case.
MANAGED_COLUMNS = ["diarrhoea_5_female", "pneumonia_male_5", "malaria_treated_5yrs"]
REFERRED_COLUMNS = ["diarrhoea_referred_5_female", "pneumonia_referred_male_5",
                    "malaria_referred_5yrs"]
STOCK_COLUMNS = ["stock_a", "stock_n", "stock_r"]
FACILITY_MONTH_MEASURES = STOCK_COLUMNS + MANAGED_COLUMNS + REFERRED_COLUMNS + [
    "actual_reports", "expected_reports"]
FACILITY_MONTH_KEYS = ["province", "district", "facility", "period", "periodname"]

_FLAGS = {"a": "A", "n": "N", "r": "R"}
_DISEASE_OF_FLAG = [("A", "diarrhoea_5_female", "diarrhoea_referred_5_female"),
                    ("N", "pneumonia_male_5", "pneumonia_referred_male_5"),
                    ("R", "malaria_treated_5yrs", "malaria_referred_5yrs")]


def _missing_if_zero(c: str):
    # a count of 0 means no row of the group met the condition: a missing cell
    return F.when(F.col(c) > F.lit(0), F.col(c).cast("double")).alias(c)


def facility_month(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Facility × month report (a facility is a supplier, identified by its key), of all line
    items or of the ones given.

    Plan: lineitem is aggregated to (supplier key, month) — a partial
    (map-side) + final hash aggregation, so a supplier holding a large share
    of lines is folded before any shuffle and the join input shrinks. The
    aggregate is joined to supplier on its primary key (AQE picks broadcast
    or sort-merge from the measured size), then to nation and region (25 and
    5 rows: broadcast by the planner's size check). A key join adds names
    without changing the grain, so no second aggregation is needed.
    """
    li = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    flag, status, qty = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    aggs = [F.sum(F.when(flag == F.lit(v), qty)).alias(f"stock_{k}") for k, v in _FLAGS.items()]
    # plain counters (count_if) are cheaper per row than sums of CASE values
    for fv, managed, referred in _DISEASE_OF_FLAG:
        aggs.append(F.count_if((flag == F.lit(fv)) & (status == F.lit("O"))).alias(managed))
    for fv, managed, referred in _DISEASE_OF_FLAG:
        aggs.append(F.count_if((flag == F.lit(fv)) & (status == F.lit("F"))).alias(referred))
    aggs.append(F.count_if(status == F.lit("F")).cast("double").alias("actual_reports"))
    aggs.append(F.count(F.lit(1)).cast("double").alias("expected_reports"))
    pre = li.groupBy(F.col("l_suppkey"), month_start("l_shipdate").alias("period")).agg(*aggs)

    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = (pre.join(sup, pre.l_suppkey == sup.s_suppkey)
              .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
              .join(reg, F.col("n_regionkey") == F.col("r_regionkey")))
    counts = set(MANAGED_COLUMNS + REFERRED_COLUMNS)
    measures = [_missing_if_zero(c) if c in counts else F.col(c) for c in FACILITY_MONTH_MEASURES]
    return joined.select(F.col("r_name").alias("province"), F.col("n_name").alias("district"),
                         F.col("s_name").alias("facility"), "period",
                         month_name("period").alias("periodname"), *measures)


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trained person per customer; BUILDING counts as male, MACHINERY as
    female (the two measures stand in for the two genders)."""
    cust = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (cust.join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(reg, F.col("n_regionkey") == F.col("r_regionkey")))
    seg = F.col("c_mktsegment")
    return j.select(
        F.col("r_name").alias("province"),
        F.col("n_name").alias("district"),
        seg.alias("cadre"),
        F.when(F.col("c_acctbal") > F.lit(0), F.lit("Yes")).otherwise(F.lit("No"))
        .alias("equipped_yes_no"),
        F.when(seg == F.lit("BUILDING"), F.lit(1.0)).alias("male_trained"),
        F.when(seg == F.lit("MACHINERY"), F.lit(1.0)).alias("female_trained"),
    )


def kpi_panel(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Wide panel: one row per (adm0 = event type, date = day of the event),
    ``n_events``, ``n_users`` (distinct) and ``n_large`` (events with value above
    180, missing when there are none) — a panel with gaps."""
    ev = table(spark, sf_dir, "events") if events is None else events
    large = F.count_if(F.col("value") > F.lit(180))
    g = ev.groupBy(F.col("event_type").alias("adm0"), F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("n_events"),
        F.countDistinct("user_id").cast("double").alias("n_users"),
        large.alias("_large"))
    return g.select("adm0", "date", "n_events", "n_users",
                    F.when(F.col("_large") > F.lit(0), F.col("_large").cast("double"))
                    .alias("n_large"))
