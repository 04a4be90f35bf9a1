"""Query catalog: every operator and KPI as a named Spark query, each paired
with an equivalent DuckDB SQL text (the oracle) where SQL can express it.

Every query reads the star-schema tables of ``sf_dir`` (or data Spark derives
from them) in full; nothing is sampled, capped or filtered to keep it cheap.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiframe import functions as X
from kpiframe import operators as O
from kpiframe.plans import ingest as I
from kpiframe.plans import kpis as K
from kpiframe.plans import panels as P
from kpiframe.plans import views as V
from kpiframe.plans.incremental import read_output, refresh_months
from kpiframe.plans.params import (
    DISTRICT_TARGETS,
    HIST_BINS,
    NATIONAL_LABEL,
    NATIONAL_TARGET,
    PRIORITY_LEVELS,
    STOCK_ITEMS,
)
from kpiframe.plans.sql import (
    FACILITY_MONTH,
    FM_COUNTS_LONG,
    KPI_PANEL,
    REFERRAL_SIDES,
    TRAINING,
    TRAINING_BASE,
    classify_sql,
    sql_string,
    with_ctes,
)
from kpiframe.session import scratch_path
from kpiframe.sources import files as S
from kpiframe.sources import generators as G
from kpiframe.sources.literals import (
    KPI_DICTIONARY_ROWS,
    MAIN_PAGE_DICTIONARY_ROWS,
    kpi_dictionary,
)
from kpiframe.sources.tables import table
from kpiframe.streaming.refresh import read_current, refresh_every, refresh_once

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


FM = with_ctes(FACILITY_MONTH)
TR = with_ctes(TRAINING)
TB = with_ctes(TRAINING_BASE)
KP = with_ctes(KPI_PANEL)


def _targets_sql(col: str) -> str:
    branches = " ".join(f"WHEN COALESCE(regexp_matches({col}, {sql_string(p)}), false) THEN {v}::DOUBLE"
                        for p, v in DISTRICT_TARGETS)
    return f"CASE {branches} END"


# ====================================================================== views

@query("facility_month", FM + " SELECT * FROM fm")
def q_facility_month(spark, d):
    return V.facility_month(spark, d)


@query("training", TR + " SELECT * FROM tr")
def q_training(spark, d):
    return V.training(spark, d)


@query("kpi_panel", KP + " SELECT * FROM kp")
def q_kpi_panel(spark, d):
    return V.kpi_panel(spark, d)


# ====================================================================== sources / sinks

ORDERS_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                 "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")


@query("csv_roundtrip", "SELECT * FROM orders")
def q_csv_roundtrip(spark, d):
    """Write orders as CSV (create-if-absent), read it back with its schema."""
    orders = table(spark, d, "orders")
    path = scratch_path(spark, "csv_roundtrip")
    S.write_if_absent(orders, path)
    S.write_if_absent(orders.limit(0), path)  # already there: must be a no-op
    return S.read_table(spark, path, ORDERS_SCHEMA)


@query("multi_file_scan", "SELECT * FROM orders")
def q_multi_file_scan(spark, d):
    """One CSV folder per order status, read back as one table; the status is
    recovered from the file each row came from."""
    orders = table(spark, d, "orders")
    path = scratch_path(spark, "multi_file_scan")
    orders.write.partitionBy("o_orderstatus").option("header", "true").csv(path)
    schema = ("o_orderkey bigint, o_custkey bigint, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string")
    many = S.read_many(spark, f"{path}/o_orderstatus=*/*.csv", schema)
    status = I.path_part(F.col("source_file"), r"o_orderstatus=([^/]+)/")
    return many.select("o_orderkey", "o_custkey", status.alias("o_orderstatus"),
                       "o_totalprice", "o_orderdate", "o_orderpriority")


REPORT_DISPLAY_HEADERS = {
    "facility": "Organisation Unit Name", "periodname": "Period Name",
    "stock_a": "Stock A", "stock_n": "Stock N", "stock_r": "Stock R",
    "diarrhoea_5_female": "Diarrhoea 5 Female", "pneumonia_male_5": "Pneumonia Male 5",
    "malaria_treated_5yrs": "Malaria Treated 5yrs",
    "diarrhoea_referred_5_female": "Diarrhoea Referred 5 Female",
    "pneumonia_referred_male_5": "Pneumonia Referred Male 5",
    "malaria_referred_5yrs": "Malaria Referred 5yrs",
    "actual_reports": "Actual Reports", "expected_reports": "Expected Reports",
}
NOT_FACILITIES = ["Supplier#000000000", "Supplier#000000007"]


@query("ingest_reports", FM + """
SELECT district, facility, period, periodname, stock_a, stock_n, stock_r, diarrhoea_5_female,
       pneumonia_male_5, malaria_treated_5yrs, diarrhoea_referred_5_female,
       pneumonia_referred_male_5, malaria_referred_5yrs, actual_reports, expected_reports
FROM fm WHERE facility NOT IN ('Supplier#000000000', 'Supplier#000000007')""")
def q_ingest_reports(spark, d):
    """The report exported as one CSV folder per district with display headers,
    then ingested back: one glob scan, header normalisation, district from the
    folder, month parsed from its name, unit renamed, non-facilities dropped."""
    fm = V.facility_month(spark, d)
    path = scratch_path(spark, "ingest_reports")
    cols = [F.col(c).alias(h) for c, h in REPORT_DISPLAY_HEADERS.items()]
    fm.select(F.col("district").alias("District"), *cols) \
        .write.partitionBy("District").option("header", "true").csv(path)
    schema = ", ".join(f"`{h}` {'string' if c in ('facility', 'periodname') else 'double'}"
                       for c, h in REPORT_DISPLAY_HEADERS.items())
    return I.facility_reports(spark, f"{path}/District=*/*.csv", schema, exclude=NOT_FACILITIES)


@query("tag_union", """
SELECT s_suppkey AS unit_key, s_name AS unit_name, s_nationkey AS nation_key, s_acctbal AS balance,
       'supplier' AS batch FROM supplier
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'customer' FROM customer""")
def q_tag_union(spark, d):
    """Two tables of one layout, each tagged with a constant column and appended by name;
    every row of both stays and each table is scanned once."""
    names = ["unit_key", "unit_name", "nation_key", "balance"]
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey",
                                                  "s_acctbal").toDF(*names)
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey",
                                                  "c_acctbal").toDF(*names)
    return O.append(O.tag(supplier, "batch", "supplier"), O.tag(customer, "batch", "customer"))


@query("status_batches", "SELECT *, coalesce(o_orderstatus, 'none') AS batch FROM orders")
def q_status_batches(spark, d):
    """Every order with the batch it belongs to, in one scan: statuses are not listed, so
    none is lost, and a missing one is a batch of its own."""
    return table(spark, d, "orders").withColumn(
        "batch", F.coalesce(F.col("o_orderstatus"), F.lit("none")))


@query("csv_write", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def q_csv_write(spark, d):
    """Parts written as CSV twice (the second write replaces the first) and read back."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    path = scratch_path(spark, "csv_write")
    S.write_csv(parts.limit(1), path)
    S.write_csv(parts, path)
    return S.read_table(spark, path, parts.schema)


@query("since_date", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
WHERE o_orderdate >= DATE '1998-01-01'""")
def q_since_date(spark, d):
    """Orders on or after a literal date."""
    o = table(spark, d, "orders")
    return o.filter(F.col("o_orderdate") >= F.to_date(F.lit("1998-01-01"))) \
        .select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("panel_grid", FM + """,
ds AS (SELECT DISTINCT district FROM fm),
rg AS (SELECT MIN(period) AS lo, MAX(period) AS hi FROM fm),
grid AS (SELECT ds.district, CAST(g.period AS DATE) AS period
         FROM ds, rg, generate_series(rg.lo::TIMESTAMP, rg.hi::TIMESTAMP, INTERVAL 1 MONTH) AS g(period)),
agg AS (SELECT district, period, SUM(expected_reports) AS expected_reports FROM fm GROUP BY 1, 2)
SELECT grid.district, grid.period, agg.expected_reports
FROM grid LEFT JOIN agg ON grid.district = agg.district AND grid.period = agg.period""")
def q_panel_grid(spark, d):
    """Every district × every month between the first and last reported month;
    months without reports stay in the panel with a missing value. The (district,
    month) aggregate is folded to one list per district and filled; its exchange also
    gives the first and last month, so the fact table is scanned once."""
    fm = V.facility_month(spark, d)
    agg = fm.groupBy("district", "period").agg(F.sum("expected_reports").alias("expected_reports"))
    return P.complete_panel(agg, "district", "period", ["expected_reports"])


def _uniform_sql(stream: int) -> str:
    """``generators.uniform`` with seed 123 over the line item's key."""
    key = f"'123|{stream}|' || l_orderkey || '|' || l_linenumber"
    return f"((CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {16 ** 13}::DOUBLE)"


def _poisson_sql(u: str, lam: float) -> str:
    steps = G.poisson_thresholds(lam)
    branches = " ".join(f"WHEN {u} <= {x!r}::DOUBLE THEN {k}" for k, x in enumerate(steps))
    return f"CASE {branches} ELSE {len(steps)} END"


@query("demo_sample", f"""
WITH u AS (SELECT l_orderkey, l_linenumber, {_uniform_sql(1)} AS u1, {_uniform_sql(2)} AS u2,
                  {_uniform_sql(3)} AS u3 FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round_even(sqrt(-2.0::DOUBLE * ln(u1)) * cos({2 * math.pi!r}::DOUBLE * u2), 6) AS x,
       round_even(sqrt(-2.0::DOUBLE * ln(u1)) * sin({2 * math.pi!r}::DOUBLE * u2), 6) AS y,
       CAST({_poisson_sql('u3', 5.0)} AS INTEGER) AS z
FROM u""")
def q_demo_sample(spark, d):
    """One seeded (x, y, z) draw per line item: x, y ~ N(0,1), z ~ Poisson(5)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return G.demo_sample(li, ["l_orderkey", "l_linenumber"], seed=123, lam=5.0)


def _poisson_pieces_sql(key: str, lam: float) -> str:
    """``generators.poisson`` with seed 123 from stream 3 on."""
    pieces, rate = G.poisson_pieces(lam)
    steps = ", ".join(f"{x!r}::DOUBLE" for x in G.poisson_thresholds(rate))
    draws = []
    for i in range(3, 3 + pieces):
        u = (f"((CAST('0x' || substr(md5('123|{i}|' || {key}), 1, 13) AS BIGINT) + 0.5::DOUBLE)"
             f" / {16 ** 13}::DOUBLE)")
        draws.append(f"len(list_filter([{steps}], lambda t: t < {u}))")
    return " + ".join(draws)


@query("poisson_large", f"""
SELECT p_partkey, CAST({_poisson_pieces_sql('p_partkey', 900.0)} AS BIGINT) AS z FROM part""")
def q_poisson_large(spark, d):
    """One Poisson(900) draw per part: a rate too large for one inversion."""
    part = table(spark, d, "part").select("p_partkey")
    return part.select("p_partkey", G.poisson(123, 3, ["p_partkey"], 900.0).alias("z"))


@query("kpi_dictionary", FM + """,
dict(kpi, description, disaggregation) AS (VALUES """ + ", ".join(
    f"({sql_string(a)}, {sql_string(b)}, {sql_string(c)})" for a, b, c in KPI_DICTIONARY_ROWS) + """),
res AS (
  SELECT district, period, 'RHCC15' AS kpi,
         round_even(COALESCE(SUM(actual_reports), 0) / NULLIF(COALESCE(SUM(expected_reports), 0), 0), 2) AS value
  FROM fm GROUP BY 1, 2
  UNION ALL
  SELECT district, period, 'RHCC11' AS kpi,
         100 - round_even(CAST(SUM(CASE WHEN COALESCE(stock_a, 0) + COALESCE(stock_n, 0) + COALESCE(stock_r, 0) < 1 THEN 1 ELSE 0 END) AS DOUBLE)
                          / COUNT(*) * 100, 2) AS value
  FROM fm GROUP BY 1, 2)
SELECT res.district, res.period, res.kpi, res.value, dict.description, dict.disaggregation
FROM res LEFT JOIN dict ON res.kpi = dict.kpi""")
def q_kpi_dictionary(spark, d):
    """KPI results in long form annotated from the KPI dictionary (a fixed
    20-row table). Both KPIs come out of one aggregation of the
    report, then one row-local unpivot."""
    fm = V.facility_month(spark, d)
    stock = X.row_sum(*[X.null_to_zero(c) for c in V.STOCK_COLUMNS])
    g = O.group_agg(fm, ["district", "period"], {
        "actual": X.sum_na("actual_reports"),
        "expected": X.sum_na("expected_reports"),
        "n": F.count(F.lit(1)),
        "k": X.count_if(stock < F.lit(1.0)),
    })
    wide = g.select("district", "period",
                    X.proportion_of("actual", "expected", 2).alias("RHCC15"),
                    X.complement(X.percent_of("k", "n", 2)).alias("RHCC11"))
    res = O.to_long(wide, ["district", "period"], ["RHCC15", "RHCC11"], "kpi", "value")
    return P.annotate_kpis(res, kpi_dictionary(spark)) \
        .select("district", "period", "kpi", "value", "description", "disaggregation")


@query("kpi_dictionary_main", KP + """,
dict(kpi, description, disaggregation) AS (VALUES """ + ", ".join(
    f"({sql_string(a)}, {sql_string(b)}, {sql_string(c)})" for a, b, c in MAIN_PAGE_DICTIONARY_ROWS) + """)
SELECT kp.adm0, kp.date, dict.kpi, kp.n_events AS value, dict.description, dict.disaggregation
FROM kp JOIN dict ON dict.kpi = 'RHCC' || CAST(extract('day' FROM kp.date) AS VARCHAR)""")
def q_kpi_dictionary_main(spark, d):
    """Panel rows annotated from the main page's dictionary (19 rows), by the code that the
    day of the month gives."""
    kp = V.kpi_panel(spark, d)
    code = F.concat(F.lit("RHCC"), F.dayofmonth("date").cast("string"))
    long = kp.select("adm0", "date", code.alias("kpi"), F.col("n_events").alias("value"))
    return O.not_null(P.annotate_kpis(long, kpi_dictionary(spark, "main")), "description") \
        .select("adm0", "date", "kpi", "value", "description", "disaggregation")


@query("report_stamp", FM + """
SELECT district, COUNT(*) AS n_reports, strftime(current_date, '%Y-%b-%d') AS report_date
FROM fm GROUP BY district""")
def q_report_stamp(spark, d):
    """A per-district report summary stamped with today's date."""
    fm = V.facility_month(spark, d)
    return O.count_by(fm, "district", "n_reports").withColumn("report_date", X.report_stamp())


# ====================================================================== schema / projection

@query("clean_names", """
SELECT c_custkey AS c_custkey, c_name AS customer_name, c_nationkey AS nation_number_key,
       c_acctbal AS account_balance_usd, c_mktsegment AS mkt_segment FROM customer""")
def q_clean_names(spark, d):
    """Display-style headers normalised to snake_case."""
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey",
                                              "c_acctbal", "c_mktsegment")
    raw = cust.toDF("C Custkey", "Customer Name", "Nation#Key", "Account Balance (USD)",
                    "mktSegment")
    return O.clean_names(raw)


@query("rename_select", FM + " SELECT district, facility AS site, period, expected_reports FROM fm")
def q_rename_select(spark, d):
    return O.rename_select(V.facility_month(spark, d),
                           ["district", "facility", "period", "expected_reports"],
                           {"facility": "site"})


@query("select_matching", FM + """
SELECT district, facility, period, periodname, diarrhoea_referred_5_female,
       pneumonia_referred_male_5, malaria_referred_5yrs FROM fm""")
def q_select_matching(spark, d):
    return O.select_matching(V.facility_month(spark, d), K.REPORT_IDS, "referred")


@query("select_range", FM + " SELECT district, facility, period, stock_a, stock_n, stock_r FROM fm")
def q_select_range(spark, d):
    return O.select_range(V.facility_month(spark, d), ["district", "facility", "period"],
                          "stock_a", "stock_r")


@query("select_except", FM + " SELECT * EXCLUDE (province, periodname) FROM fm")
def q_select_except(spark, d):
    return O.select_except(V.facility_month(spark, d), ["province", "periodname"])


# ====================================================================== filters

@query("filter_not_null", FM + " SELECT * FROM fm WHERE stock_r IS NOT NULL")
def q_filter_not_null(spark, d):
    return O.not_null(V.facility_month(spark, d), "stock_r")


@query("exclude_values", "SELECT * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def q_exclude_values(spark, d):
    return O.exclude_values(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("filter_regex",
       "SELECT * FROM orders WHERE COALESCE(regexp_matches(o_orderpriority, 'URGENT|HIGH'), false)")
def q_filter_regex(spark, d):
    return O.matches(table(spark, d, "orders"), "o_orderpriority", "URGENT|HIGH")


@query("filter_equals", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def q_filter_equals(spark, d):
    return O.filter_equals(table(spark, d, "orders"), "o_orderstatus", "F")


@query("complete_rows", KP + """
SELECT * FROM kp WHERE adm0 IS NOT NULL AND date IS NOT NULL AND n_events IS NOT NULL
  AND n_users IS NOT NULL AND n_large IS NOT NULL""")
def q_complete_rows(spark, d):
    return O.complete_rows(V.kpi_panel(spark, d))


@query("range_censor", FM + """
SELECT district, facility, period,
       CASE WHEN stock_a BETWEEN 0 AND 100 THEN stock_a END AS stock_a FROM fm""")
def q_range_censor(spark, d):
    fm = V.facility_month(spark, d).select("district", "facility", "period", "stock_a")
    return O.range_censor(fm, "stock_a", 0.0, 100.0)


# ====================================================================== scalar expressions

@query("if_else_equals", """
SELECT o_orderkey, CASE WHEN o_orderstatus IS NULL THEN NULL
                        WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0::DOUBLE END AS paid
FROM orders""")
def q_if_else_equals(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey",
                    X.if_else(F.col("o_orderstatus") == F.lit("F"), F.col("o_totalprice"), 0.0)
                    .alias("paid"))


@query("null_to_zero", FM + """
SELECT province, district, facility, period, periodname,
       COALESCE(stock_a, 0) AS stock_a, COALESCE(stock_n, 0) AS stock_n, COALESCE(stock_r, 0) AS stock_r,
       COALESCE(diarrhoea_5_female, 0) AS diarrhoea_5_female, COALESCE(pneumonia_male_5, 0) AS pneumonia_male_5,
       COALESCE(malaria_treated_5yrs, 0) AS malaria_treated_5yrs,
       COALESCE(diarrhoea_referred_5_female, 0) AS diarrhoea_referred_5_female,
       COALESCE(pneumonia_referred_male_5, 0) AS pneumonia_referred_male_5,
       COALESCE(malaria_referred_5yrs, 0) AS malaria_referred_5yrs,
       COALESCE(actual_reports, 0) AS actual_reports, COALESCE(expected_reports, 0) AS expected_reports
FROM fm""")
def q_null_to_zero(spark, d):
    """Missing → 0 in every numeric column of the report."""
    return V.facility_month(spark, d).fillna(0)


@query("threshold_flag", FM + """
SELECT district, facility, period, COALESCE(stock_a, 0) AS stock_a,
       CASE WHEN COALESCE(stock_a, 0) < 1 THEN 1 ELSE 0 END AS stockout_a FROM fm""")
def q_threshold_flag(spark, d):
    fm = V.facility_month(spark, d).select("district", "facility", "period",
                                           X.null_to_zero("stock_a").alias("stock_a"))
    return fm.withColumn("stockout_a",
                         F.when(F.col("stock_a") < F.lit(1), F.lit(1)).otherwise(F.lit(0)))


@query("row_sum", FM + """
SELECT district, facility, period,
       COALESCE(stock_a, 0) + COALESCE(stock_n, 0) + COALESCE(stock_r, 0) AS stock_total FROM fm""")
def q_row_sum(spark, d):
    fm = V.facility_month(spark, d).fillna(0)
    return fm.select("district", "facility", "period",
                     X.row_sum("stock_a", "stock_n", "stock_r").alias("stock_total"))


@query("classify_regex", FM + "," + FM_COUNTS_LONG.strip() + f"""
SELECT district, facility, period, stat, value, {classify_sql('stat')} FROM fm_counts""")
def q_classify_regex(spark, d):
    """Age group, gender (default Combined) and disease (no default) from the
    count column names, on the report in long form."""
    fm = V.facility_month(spark, d)
    long = O.to_long(fm, ["district", "facility", "period"],
                     V.MANAGED_COLUMNS + V.REFERRED_COLUMNS, "stat", "value")
    return K.classify_stat(long, "stat")


@query("percent_of", FM + """
SELECT district, facility, period,
       round_even(actual_reports / NULLIF(expected_reports, 0) * 100, 2) AS pct_actual FROM fm""")
def q_percent_of(spark, d):
    fm = V.facility_month(spark, d)
    return fm.select("district", "facility", "period",
                     X.percent_of("actual_reports", "expected_reports", 2).alias("pct_actual"))


@query("proportion_of", FM + """
SELECT district, facility, period,
       round_even(actual_reports / NULLIF(expected_reports, 0), 2) AS prop_actual FROM fm""")
def q_proportion_of(spark, d):
    fm = V.facility_month(spark, d)
    return fm.select("district", "facility", "period",
                     X.proportion_of("actual_reports", "expected_reports", 2).alias("prop_actual"))


@query("complement", FM + """
SELECT district, facility, period,
       100 - round_even(actual_reports / NULLIF(expected_reports, 0) * 100, 2) AS pct_not_actual FROM fm""")
def q_complement(spark, d):
    fm = V.facility_month(spark, d)
    pct = X.percent_of("actual_reports", "expected_reports", 2)
    return fm.select("district", "facility", "period", X.complement(pct).alias("pct_not_actual"))


@query("percent_label", FM + """
SELECT district, facility, period,
       round_even(actual_reports / NULLIF(expected_reports, 0) * 100, 0) AS pct_actual,
       CAST(CAST(round_even(actual_reports / NULLIF(expected_reports, 0) * 100, 0) AS BIGINT) AS VARCHAR) || '%'
         AS pct_label,
       expected_reports + 100 AS label_y
FROM fm""")
def q_percent_label(spark, d):
    fm = V.facility_month(spark, d)
    pct = X.percent_of("actual_reports", "expected_reports", 0)
    return fm.select("district", "facility", "period", pct.alias("pct_actual"),
                     X.percent_label(pct).alias("pct_label"),
                     (F.col("expected_reports") + F.lit(100.0)).alias("label_y"))


@query("percent_label_decimals", FM + """,
p AS (SELECT district, facility, period,
             round_even(actual_reports / NULLIF(expected_reports, 0) * 100, 1) AS pct FROM fm)
SELECT district, facility, period, pct,
       CASE WHEN pct = floor(pct) THEN CAST(CAST(pct AS BIGINT) AS VARCHAR) ELSE CAST(pct AS VARCHAR) END
         || '%' AS pct_label FROM p""")
def q_percent_label_decimals(spark, d):
    """Labels of percentages with a decimal: as they are, whole ones without it."""
    fm = V.facility_month(spark, d)
    pct = X.percent_of("actual_reports", "expected_reports", 1)
    return fm.select("district", "facility", "period", pct.alias("pct"),
                     X.percent_label(pct).alias("pct_label"))


@query("recode", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent'
                        WHEN o_orderpriority = '2-HIGH' THEN 'high'
                        ELSE o_orderpriority END AS priority_label
FROM orders""")
def q_recode(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.recode("o_orderpriority", {"1-URGENT": "urgent",
                                                               "2-HIGH": "high"})
                    .alias("priority_label"))


@query("category_order", "SELECT o_orderkey, o_orderpriority, CASE " + " ".join(
    f"WHEN o_orderpriority = {sql_string(lv)} THEN {i}" for i, lv in enumerate(PRIORITY_LEVELS, 1))
    + " END AS priority_order FROM orders")
def q_category_order(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_orderpriority",
                    X.category_order("o_orderpriority", PRIORITY_LEVELS).alias("priority_order"))


@query("level_number", """
SELECT o_orderkey, o_orderpriority,
       CASE WHEN o_orderpriority IS NOT NULL
            THEN CAST(dense_rank() OVER (ORDER BY o_orderpriority NULLS LAST) AS BIGINT) END AS level
FROM orders""")
def q_level_number(spark, d):
    """The default order of a category: the number of its value among the sorted ones."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return O.level_number(o, "o_orderpriority", "level")


@query("period_parse", """
SELECT o_orderkey, strftime(o_orderdate, '%B %Y') AS periodname,
       CAST(strptime(strftime(o_orderdate, '%B %Y'), '%B %Y') AS DATE) AS period
FROM orders""")
def q_period_parse(spark, d):
    """Month-name text to the first day of that month (every month, not two)."""
    o = table(spark, d, "orders").select("o_orderkey", X.month_name("o_orderdate").alias("periodname"))
    return o.withColumn("period", X.period_parse("periodname"))


# ====================================================================== reshape

@query("unpivot_range", TB + """
SELECT province, district, 'male_chws_trained' AS stat, male_chws_trained AS count FROM tb
UNION ALL SELECT province, district, 'female_chws_trained', female_chws_trained FROM tb
UNION ALL SELECT province, district, 'male_chws_equipped', male_chws_equipped FROM tb
UNION ALL SELECT province, district, 'female_chws_equipped', female_chws_equipped FROM tb""")
def q_unpivot_range(spark, d):
    base = K.training_base(V.training(spark, d))
    return O.to_long(base, ["province", "district"],
                     O.cols_between(base, "male_chws_trained", "female_chws_equipped"),
                     "stat", "count")


@query("unpivot_pattern", FM + """,
sel AS (SELECT district, facility, period, periodname, diarrhoea_referred_5_female,
               pneumonia_referred_male_5, malaria_referred_5yrs FROM fm)
SELECT district, facility, period, periodname, 'diarrhoea_referred_5_female' AS stat, diarrhoea_referred_5_female AS referral_count FROM sel
UNION ALL SELECT district, facility, period, periodname, 'pneumonia_referred_male_5', pneumonia_referred_male_5 FROM sel
UNION ALL SELECT district, facility, period, periodname, 'malaria_referred_5yrs', malaria_referred_5yrs FROM sel""")
def q_unpivot_pattern(spark, d):
    fm = V.facility_month(spark, d)
    return O.to_long(fm, K.REPORT_IDS, O.cols_matching(fm, "referred"), "stat", "referral_count")


@query("unpivot_except", FM + "," + FM_COUNTS_LONG.strip() + """
SELECT district, facility, period, stat, value AS count FROM fm_counts""")
def q_unpivot_except(spark, d):
    fm = V.facility_month(spark, d)
    sel = fm.select("district", "facility", "period", *V.MANAGED_COLUMNS, *V.REFERRED_COLUMNS)
    return O.to_long(sel, ["district", "facility", "period"], None, "stat", "count")


@query("unpivot_list", FM + """
SELECT district, facility, period, 'stock_a' AS stat, stock_a AS stock FROM fm
UNION ALL SELECT district, facility, period, 'stock_r', stock_r FROM fm""")
def q_unpivot_list(spark, d):
    fm = V.facility_month(spark, d)
    return O.to_long(fm, ["district", "facility", "period"], ["stock_a", "stock_r"],
                     "stat", "stock")


@query("unpivot_prefix", FM + """
SELECT district, facility, period, 'a' AS item, stock_a AS stock FROM fm WHERE stock_a IS NOT NULL
UNION ALL SELECT district, facility, period, 'n', stock_n FROM fm WHERE stock_n IS NOT NULL
UNION ALL SELECT district, facility, period, 'r', stock_r FROM fm WHERE stock_r IS NOT NULL""")
def q_unpivot_prefix(spark, d):
    """Stock columns to long form with the ``stock_`` prefix stripped, missing dropped."""
    fm = V.facility_month(spark, d)
    return O.to_long(fm, ["district", "facility", "period"], V.STOCK_COLUMNS, "item", "stock",
                     names_prefix="stock_", drop_na=True)


@query("part_remainder", KP + """,
p AS (SELECT adm0, date, round_even(n_users / NULLIF(n_events, 0) * 100, 2) AS pct FROM kp)
SELECT adm0, date, 'value' AS part, pct AS value FROM p
UNION ALL SELECT adm0, date, 'remainder', 100 - pct FROM p""")
def q_part_remainder(spark, d):
    kp = V.kpi_panel(spark, d)
    pct = kp.select("adm0", "date", X.percent_of("n_users", "n_events", 2).alias("pct"))
    return O.part_remainder(pct, ["adm0", "date"], "pct", 100.0, "part", "value")


# ====================================================================== joins

@query("join_left_nullsafe", FM + "," + REFERRAL_SIDES.strip() + """
SELECT district, facility, period, periodname, age_group, gender, disease,
       stat, referral_count, stat2, managed_count FROM joined""")
def q_join_left_nullsafe(spark, d):
    return K.referral_joined(V.facility_month(spark, d), V.MANAGED_COLUMNS)


@query("join_matched", FM + "," + REFERRAL_SIDES.strip() + """
SELECT district, facility, period, periodname, age_group, gender, disease,
       stat, referral_count, stat2, managed_count FROM joined WHERE stat2 IS NOT NULL""")
def q_join_matched(spark, d):
    return O.not_null(K.referral_joined(V.facility_month(spark, d), V.MANAGED_COLUMNS), "stat2")


@query("join_pattern_lookup", TR + f"""
SELECT province, district, cadre, {_targets_sql('district')} AS target FROM tr""")
def q_join_pattern_lookup(spark, d):
    """District target by the first matching name pattern (NULL when none)."""
    tr = V.training(spark, d).select("province", "district", "cadre")
    return O.lookup_by_pattern(tr, "district", DISTRICT_TARGETS, "target")


@query("join_rule_table", TR + """,
rules AS (SELECT '^' || n_name || '$' AS pattern, CAST(n_nationkey AS DOUBLE) AS target, n_nationkey AS priority
          FROM nation
          UNION ALL SELECT r_name, 1000.0::DOUBLE + r_regionkey, 100 + r_regionkey FROM region),
best AS (SELECT name, min_by(target, priority) AS target
         FROM (SELECT DISTINCT district AS name FROM tr WHERE district IS NOT NULL) n
         JOIN rules ON regexp_matches(n.name, rules.pattern) GROUP BY name)
SELECT tr.province, tr.district, tr.cadre, best.target FROM tr LEFT JOIN best ON tr.district = best.name""")
def q_join_rule_table(spark, d):
    """District target by the first matching rule of a rule table derived from the data."""
    nation = table(spark, d, "nation").select(
        F.concat(F.lit("^"), F.col("n_name"), F.lit("$")).alias("pattern"),
        F.col("n_nationkey").cast("double").alias("target"), F.col("n_nationkey").alias("priority"))
    region = table(spark, d, "region").select(
        F.col("r_name").alias("pattern"), (F.col("r_regionkey") + F.lit(1000.0)).alias("target"),
        (F.col("r_regionkey") + F.lit(100)).alias("priority"))
    tr = V.training(spark, d).select("province", "district", "cadre")
    return O.lookup_by_rules(tr, "district", O.append(nation, region), "target")


# ====================================================================== aggregation

@query("group_sum", FM + """
SELECT district, period, COALESCE(SUM(stock_a), 0) AS stock_a, COALESCE(SUM(stock_n), 0) AS stock_n,
       COALESCE(SUM(stock_r), 0) AS stock_r FROM fm GROUP BY district, period""")
def q_group_sum(spark, d):
    return O.sum_by(V.facility_month(spark, d), ["district", "period"], V.STOCK_COLUMNS)


@query("group_count", FM + " SELECT district, period, COUNT(*) AS n_facilities FROM fm GROUP BY 1, 2")
def q_group_count(spark, d):
    return O.count_by(V.facility_month(spark, d), ["district", "period"], "n_facilities")


@query("group_count_if", FM + """
SELECT district, period,
       CAST(SUM(CASE WHEN stock_a IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_a,
       CAST(SUM(CASE WHEN stock_r >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS n_large_r
FROM fm GROUP BY 1, 2""")
def q_group_count_if(spark, d):
    return O.count_if_by(V.facility_month(spark, d), ["district", "period"], {
        "n_missing_a": F.col("stock_a").isNull(),
        "n_large_r": F.col("stock_r") >= F.lit(100),
    })


@query("group_multi", FM + """
SELECT district, COUNT(*) AS n_rows, COALESCE(SUM(expected_reports), 0) AS expected,
       COALESCE(SUM(actual_reports), 0) AS actual, MIN(period) AS first_period,
       MAX(period) AS last_period, CAST(SUM(CASE WHEN stock_a IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_a
FROM fm GROUP BY district""")
def q_group_multi(spark, d):
    return O.group_agg(V.facility_month(spark, d), "district", {
        "n_rows": F.count(F.lit(1)),
        "expected": X.sum_na("expected_reports"),
        "actual": X.sum_na("actual_reports"),
        "first_period": F.min("period"),
        "last_period": F.max("period"),
        "n_missing_a": X.count_if(F.col("stock_a").isNull()),
    })


@query("group_regroup", TB + """
SELECT province, COALESCE(SUM(male_chws_trained), 0) AS male_chws_trained,
       COALESCE(SUM(female_chws_trained), 0) AS female_chws_trained
FROM tb GROUP BY province""")
def q_group_regroup(spark, d):
    """Province × district aggregate re-aggregated to province."""
    base = K.training_base(V.training(spark, d))
    return O.sum_by(base, "province", ["male_chws_trained", "female_chws_trained"])


@query("group_total", FM + """
SELECT district, COALESCE(SUM(expected_reports), 0) AS expected FROM fm GROUP BY district
UNION ALL SELECT 'Total', COALESCE(SUM(expected_reports), 0) FROM fm""")
def q_group_total(spark, d):
    return O.with_total_sum(V.facility_month(spark, d), ["district"],
                            {"expected": X.sum_na("expected_reports")}, label="Total")


@query("sorted_group", FM + """
SELECT district, period, COALESCE(SUM(expected_reports), 0) AS expected FROM fm
GROUP BY district, period ORDER BY district, period""")
def q_sorted_group(spark, d):
    g = O.sum_by(V.facility_month(spark, d), ["district", "period"], ["expected_reports"],
                 {"expected_reports": "expected"})
    return O.sorted_by(g, ["district", "period"])


@query("ratio_of_sums", FM + """
SELECT province, COALESCE(SUM(actual_reports), 0) AS actual_reports,
       COALESCE(SUM(expected_reports), 0) AS expected_reports,
       round_even(COALESCE(SUM(actual_reports), 0) / NULLIF(COALESCE(SUM(expected_reports), 0), 0) * 100, 2)
         AS pct_actual
FROM fm GROUP BY province""")
def q_ratio_of_sums(spark, d):
    return O.ratio_of_sums(V.facility_month(spark, d), "province", "actual_reports",
                           "expected_reports", "pct_actual", 2, kind="percent")


@query("share_without", FM + """,
f AS (SELECT district, period, COALESCE(stock_a, 0) AS a, COALESCE(stock_n, 0) AS n FROM fm),
g AS (SELECT district, period, COUNT(*) AS n_facilities,
             CAST(SUM(CASE WHEN a < 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_a_stockouts,
             CAST(SUM(CASE WHEN n < 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_n_stockouts
      FROM f GROUP BY 1, 2)
SELECT *, round_even(n_a_stockouts / n_facilities * 100, 2) AS percent_a_stocked_out,
       100 - round_even(n_a_stockouts / n_facilities * 100, 2) AS percent_a_not_stocked_out,
       round_even(n_n_stockouts / n_facilities * 100, 2) AS percent_n_stocked_out,
       100 - round_even(n_n_stockouts / n_facilities * 100, 2) AS percent_n_not_stocked_out
FROM g""")
def q_share_without(spark, d):
    fm = V.facility_month(spark, d).fillna(0)
    return O.share_without(fm, ["district", "period"], {
        "a": F.col("stock_a") < F.lit(1), "n": F.col("stock_n") < F.lit(1)},
        n_name="n_facilities", count_fmt="n_{}_stockouts", pct_fmt="percent_{}_stocked_out",
        not_fmt="percent_{}_not_stocked_out")


def _histogram_sql(col: str, tbl: str, bins: int) -> str:
    return f"""
WITH r AS (SELECT MIN({col}) AS lo, MAX({col}) AS hi FROM {tbl} WHERE {col} IS NOT NULL),
w AS (SELECT lo, CASE WHEN hi = lo THEN 0.1 ELSE (hi - lo) / {float(bins - 1)} END AS width FROM r),
e AS (SELECT lo - width / 2.0 AS edge0, width FROM w),
c AS (SELECT GREATEST(1, LEAST({bins}, CAST(CEIL(({col} - e.edge0) / e.width) AS BIGINT))) AS bin,
             COUNT(*) AS count
      FROM {tbl}, e WHERE {col} IS NOT NULL GROUP BY 1),
b AS (SELECT CAST(range AS BIGINT) AS bin FROM range(1, {bins + 1}))
SELECT b.bin, e.edge0 + (b.bin - 1) * e.width AS lower, e.edge0 + b.bin * e.width AS upper,
       COALESCE(c.count, 0) AS count
FROM b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin"""

@query("histogram", _histogram_sql("l_quantity", "lineitem", HIST_BINS))
def q_histogram(spark, d):
    """Equal-width histogram of line quantities, all bins including empty ones; the range
    comes from the file footers, so the data are scanned once."""
    span = S.parquet_range(spark, f"{d.rstrip('/')}/lineitem.parquet", "l_quantity")
    return O.histogram(table(spark, d, "lineitem"), "l_quantity", HIST_BINS, span=span)


@query("histogram_20", _histogram_sql("value", "events", 20))
def q_histogram_20(spark, d):
    """The dashboard's 20 bins, over the events' values."""
    span = S.parquet_range(spark, f"{d.rstrip('/')}/events.parquet", "value")
    return O.histogram(table(spark, d, "events"), "value", 20, span=span)


# ====================================================================== windows

@query("number_within", KP + """
SELECT adm0, date, n_large, CAST(ROW_NUMBER() OVER (PARTITION BY adm0 ORDER BY date) AS BIGINT) AS survey
FROM kp WHERE n_large IS NOT NULL""")
def q_number_within(spark, d):
    kp = O.not_null(V.kpi_panel(spark, d).select("adm0", "date", "n_large"), "n_large")
    return O.number_within(kp, "adm0", "date", "survey")


@query("scalar_first", KP + """
SELECT adm0, date, n_events, n_users, n_large FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY adm0 ORDER BY date) AS rn FROM kp) WHERE rn = 1""")
def q_scalar_first(spark, d):
    return O.first_per_group(V.kpi_panel(spark, d), "adm0", "date")


@query("scalar_last", KP + """
SELECT adm0, date, n_events, n_users, n_large FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY adm0 ORDER BY date DESC) AS rn FROM kp) WHERE rn = 1""")
def q_scalar_last(spark, d):
    return O.last_per_group(V.kpi_panel(spark, d), "adm0", "date")


@query("last_present", KP + """
SELECT adm0, date, n_large FROM (
  SELECT adm0, date, n_large, ROW_NUMBER() OVER (PARTITION BY adm0 ORDER BY date DESC) AS rn
  FROM kp WHERE n_large IS NOT NULL) WHERE rn = 1""")
def q_last_present(spark, d):
    kp = V.kpi_panel(spark, d).select("adm0", "date", "n_large")
    return O.last_present(kp, "adm0", "date", "n_large")


@query("group_size", KP + """
SELECT adm0, date, n_large, COUNT(*) OVER (PARTITION BY adm0) AS n
FROM kp WHERE n_large IS NOT NULL""")
def q_group_size(spark, d):
    kp = O.not_null(V.kpi_panel(spark, d).select("adm0", "date", "n_large"), "n_large")
    return O.group_size(kp, "adm0", "n")


@query("stack_offsets", TB + """,
l AS (SELECT district, 'male_chws_trained' AS stat, male_chws_trained AS count FROM tb
      UNION ALL SELECT district, 'female_chws_trained', female_chws_trained FROM tb)
SELECT district, stat, count,
       SUM(count) OVER (PARTITION BY district ORDER BY stat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - count / 2.0 AS label_pos
FROM l""")
def q_stack_offsets(spark, d):
    """Middle of each stacked part (female, then male) per district."""
    base = K.training_base(V.training(spark, d))
    long = O.to_long(base, ["district"], ["male_chws_trained", "female_chws_trained"],
                     "stat", "count")
    return O.stack_offsets(long, "district", "stat", "count", "label_pos")


@query("entity_page", KP + """,
keys AS (SELECT adm0, ROW_NUMBER() OVER (ORDER BY adm0) AS panel
         FROM (SELECT DISTINCT adm0 FROM kp WHERE adm0 IS NOT NULL))
SELECT kp.*, CAST(keys.panel AS BIGINT) AS panel FROM kp JOIN keys ON kp.adm0 = keys.adm0
WHERE keys.panel <= 4""")
def q_entity_page(spark, d):
    """Rows of the first page (2 × 2 facets) of entities."""
    return O.entity_page(V.kpi_panel(spark, d), "adm0", 4, 1, "panel")


@query("head_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 6")
def q_head_rows(spark, d):
    return O.head_rows(table(spark, d, "orders"), 6, ["o_orderkey"])


# ====================================================================== panels (column-expression helpers)

@query("kpi_series", KP + """
SELECT adm0, date, 'n_events' AS kpi, n_events AS value FROM kp
UNION ALL SELECT adm0, date, 'n_users', n_users FROM kp
UNION ALL SELECT adm0, date, 'n_large', n_large FROM kp
ORDER BY adm0, kpi, date""")
def q_kpi_series(spark, d):
    return P.kpi_series(V.kpi_panel(spark, d), ["n_events", "n_users", "n_large"])


@query("kpi_series_expression", KP + """
SELECT adm0, date, 'large_per_1000' AS kpi, n_large / NULLIF(n_events, 0) * 1000 AS value FROM kp
ORDER BY adm0, kpi, date""")
def q_kpi_series_expression(spark, d):
    """The monthly series of a column expression."""
    return P.kpi_series(V.kpi_panel(spark, d), X.per_thousand("n_large", "n_events"),
                        name="large_per_1000")


@query("kpi_latest", KP + """
SELECT adm0, date, pct_large,
       CASE WHEN pct_large = floor(pct_large) THEN CAST(CAST(pct_large AS BIGINT) AS VARCHAR)
            ELSE CAST(pct_large AS VARCHAR) END || '%' AS label, pct_large / 2.0 AS label_pos
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY adm0 ORDER BY date DESC) AS rn
      FROM (SELECT adm0, date, round_even(n_large / NULLIF(n_events, 0) * 100, 2) AS pct_large FROM kp)
      WHERE pct_large IS NOT NULL)
WHERE rn = 1""")
def q_kpi_latest(spark, d):
    """The latest value per entity with its label as it reads, no remainder."""
    return P.kpi_latest(V.kpi_panel(spark, d), X.percent_of("n_large", "n_events", 2),
                        name="pct_large")


@query("kpi_bars", KP + " SELECT adm0, date, n_large FROM kp WHERE n_large IS NOT NULL")
def q_kpi_bars(spark, d):
    return P.kpi_bars(V.kpi_panel(spark, d), "n_large")


@query("kpi_surveys", KP + """
SELECT adm0, date, CASE WHEN n_large BETWEEN 0 AND 100 THEN n_large END AS n_large,
       CAST(ROW_NUMBER() OVER (PARTITION BY adm0 ORDER BY date) AS BIGINT) AS survey
FROM kp WHERE n_large IS NOT NULL""")
def q_kpi_surveys(spark, d):
    return P.kpi_surveys(V.kpi_panel(spark, d), "n_large", lo=0.0, hi=100.0)


@query("kpi_latest_share", KP + """,
v AS (SELECT adm0, date, round_even(n_large / NULLIF(n_events, 0) * 100, 2) AS pct_large FROM kp),
latest AS (SELECT adm0, date, pct_large FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY adm0 ORDER BY date DESC) AS rn FROM v WHERE pct_large IS NOT NULL)
  WHERE rn = 1),
parts AS (
  SELECT adm0, date, 'value' AS part, pct_large AS percent, adm0 AS fill_group, 1 AS fill_order,
         CAST(CAST(round_even(pct_large, 0) AS BIGINT) AS VARCHAR) || '%' AS label FROM latest
  UNION ALL
  SELECT adm0, date, 'remainder', 100 - pct_large, 'remainder', 2, NULL FROM latest)
SELECT *, SUM(percent) OVER (PARTITION BY adm0 ORDER BY fill_order DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - percent / 2.0 AS label_pos
FROM parts""")
def q_kpi_latest_share(spark, d):
    kp = V.kpi_panel(spark, d)
    return P.kpi_latest_share(kp, X.percent_of("n_large", "n_events", 2), name="pct_large")


@query("kpi_density", KP + """
SELECT adm0, date, CASE WHEN density BETWEEN 0 AND 1000 THEN density END AS density FROM (
  SELECT adm0, date, n_large / NULLIF(n_events, 0) * 1000 AS density FROM kp)
WHERE density IS NOT NULL""")
def q_kpi_density(spark, d):
    return P.kpi_density(V.kpi_panel(spark, d), "n_large", "n_events", lo=0.0, hi=1000.0)


@query("kpi_achieved_vs_target", KP + """
SELECT adm0, date, n_large AS achieved, n_users AS target,
       round_even(n_large / NULLIF(n_users, 0) * 100, 0) AS pct_achieved
FROM kp WHERE n_large IS NOT NULL""")
def q_kpi_achieved_vs_target(spark, d):
    """Achieved (events above 180) against target (active users), whole percent."""
    return P.kpi_achieved_vs_target(V.kpi_panel(spark, d), "n_large", "n_users")


@query("kpi_trained_vs_target", KP + """,
w AS (SELECT adm0, date, n_users AS trained_clinical, n_large AS trained_nonclinical,
             n_events + COALESCE(n_large, 0) AS target_all FROM kp WHERE n_users IS NOT NULL),
l AS (SELECT adm0, date, target_all, 'clinical' AS chw, trained_clinical AS trained FROM w
      UNION ALL SELECT adm0, date, target_all, 'nonclinical', trained_nonclinical FROM w),
o AS (SELECT *, CASE WHEN chw = 'nonclinical' THEN 1 WHEN chw = 'clinical' THEN 2 END AS chw_order FROM l)
SELECT *, SUM(trained) OVER (PARTITION BY adm0, date ORDER BY chw_order DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - trained / 2.0 AS label_pos
FROM o""")
def q_kpi_trained_vs_target(spark, d):
    """Trained by cadre (clinical = active users, non-clinical = events above
    180) stacked against the combined target (events + non-clinical)."""
    return P.kpi_trained_vs_target(V.kpi_panel(spark, d), "n_users", "n_large",
                                   "n_events", "n_large")


# ====================================================================== named KPIs

@query("kpi_training_base", TB + " SELECT * FROM tb")
def q_kpi_training_base(spark, d):
    return K.training_base(V.training(spark, d))


def _gender_sql(what: str) -> str:
    return TB + f"""
SELECT province, district, 'male_chws_{what}' AS stat, male_chws_{what} AS count, 'Male CHWs' AS label FROM tb
UNION ALL SELECT province, district, 'female_chws_{what}', female_chws_{what}, 'Female CHWs' FROM tb"""


@query("kpi_trained_by_gender", _gender_sql("trained"))
def q_kpi_trained_by_gender(spark, d):
    return K.trained_by_gender(K.training_base(V.training(spark, d)), "trained")


@query("kpi_equipped_by_gender", _gender_sql("equipped"))
def q_kpi_equipped_by_gender(spark, d):
    return K.trained_by_gender(K.training_base(V.training(spark, d)), "equipped")


@query("kpi_pct_equipped", TB + """,
p AS (SELECT province, district,
             round_even(male_chws_equipped / NULLIF(male_chws_trained, 0) * 100, 2) AS pct_male_equipped,
             round_even(female_chws_equipped / NULLIF(female_chws_trained, 0) * 100, 2) AS pct_female_equipped
      FROM tb)
SELECT province, district, 'pct_male_equipped' AS stat, pct_male_equipped AS count, 'Male CHWs' AS label FROM p
UNION ALL SELECT province, district, 'pct_female_equipped', pct_female_equipped, 'Female CHWs' FROM p""")
def q_kpi_pct_equipped(spark, d):
    return K.pct_equipped(K.training_base(V.training(spark, d)))


@query("kpi_target_reached", TB + f""",
l AS (SELECT district, male_chws_trained AS count FROM tb
      UNION ALL SELECT district, female_chws_trained FROM tb),
g AS (SELECT district, COALESCE(SUM(count), 0) AS chws_trained FROM l GROUP BY district
      UNION ALL SELECT '{NATIONAL_LABEL}', COALESCE(SUM(count), 0) FROM l),
t AS (SELECT district, chws_trained,
             CASE WHEN district = '{NATIONAL_LABEL}' THEN {NATIONAL_TARGET}::DOUBLE
                  ELSE {_targets_sql('district')} END AS target_chws FROM g)
SELECT district, chws_trained, target_chws,
       round_even(chws_trained / NULLIF(target_chws, 0) * 100, 0) AS pct_trained,
       CAST(CAST(round_even(chws_trained / NULLIF(target_chws, 0) * 100, 0) AS BIGINT) AS VARCHAR) || '%'
         AS pct_label,
       chws_trained + 100 AS label_y
FROM t""")
def q_kpi_target_reached(spark, d):
    base = K.training_base(V.training(spark, d))
    return K.target_reached(base, DISTRICT_TARGETS, NATIONAL_TARGET, NATIONAL_LABEL)


@query("kpi_referral", FM + "," + REFERRAL_SIDES.strip() + """,
g AS (SELECT district, period, gender, disease, COALESCE(SUM(referral_count), 0) AS referral_count,
             COALESCE(SUM(managed_count), 0) AS managed_count
      FROM joined WHERE stat2 IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT district, period, gender, disease, referral_count, managed_count,
       CASE WHEN round_even(referral_count / NULLIF(managed_count, 0), 2) BETWEEN 0 AND 1
            THEN round_even(referral_count / NULLIF(managed_count, 0), 2) END AS prop_referred
FROM g""")
def q_kpi_referral(spark, d):
    return K.referral(V.facility_month(spark, d), V.MANAGED_COLUMNS)


@query("kpi_stockout_combined", FM + """,
g AS (SELECT district, period, COUNT(*) AS n_facilities,
             CAST(SUM(CASE WHEN COALESCE(stock_a, 0) + COALESCE(stock_n, 0) + COALESCE(stock_r, 0) < 1
                           THEN 1 ELSE 0 END) AS BIGINT) AS n_stockouts
      FROM fm GROUP BY 1, 2)
SELECT *, round_even(n_stockouts / n_facilities * 100, 2) AS percent_stocked_out,
       CASE WHEN 100 - round_even(n_stockouts / n_facilities * 100, 2) BETWEEN 0 AND 100
            THEN 100 - round_even(n_stockouts / n_facilities * 100, 2) END AS percent_not_stocked_out
FROM g""")
def q_kpi_stockout_combined(spark, d):
    return K.stockout_combined(V.facility_month(spark, d), V.STOCK_COLUMNS, 1.0)


@query("kpi_stockout_by_item", FM + """,
g AS (SELECT district, period, COUNT(*) AS n_facilities,
             SUM(CASE WHEN COALESCE(stock_a, 0) < 1 THEN 1 ELSE 0 END) AS k_a,
             SUM(CASE WHEN COALESCE(stock_n, 0) < 1 THEN 1 ELSE 0 END) AS k_n,
             SUM(CASE WHEN COALESCE(stock_r, 0) < 1 THEN 1 ELSE 0 END) AS k_r
      FROM fm GROUP BY 1, 2),
l AS (SELECT district, period, n_facilities, 'percent_a_not_stocked_out' AS stat,
             100 - round_even(k_a / n_facilities * 100, 2) AS pct, 'a' AS item FROM g
      UNION ALL SELECT district, period, n_facilities, 'percent_n_not_stocked_out',
             100 - round_even(k_n / n_facilities * 100, 2), 'n' FROM g
      UNION ALL SELECT district, period, n_facilities, 'percent_r_not_stocked_out',
             100 - round_even(k_r / n_facilities * 100, 2), 'r' FROM g)
SELECT district, period, n_facilities, stat, CASE WHEN pct BETWEEN 0 AND 100 THEN pct END AS pct, item
FROM l""")
def q_kpi_stockout_by_item(spark, d):
    return K.stockout_by_item(V.facility_month(spark, d), STOCK_ITEMS, 1.0)


@query("kpi_case_counts", FM + "," + FM_COUNTS_LONG.strip() + """
SELECT district, period, stat, COALESCE(SUM(value), 0) AS count FROM fm_counts GROUP BY 1, 2, 3""")
def q_kpi_case_counts(spark, d):
    return K.case_counts(V.facility_month(spark, d), V.MANAGED_COLUMNS + V.REFERRED_COLUMNS)


@query("kpi_completeness", FM + """
SELECT district, period, COALESCE(SUM(actual_reports), 0) AS actual,
       COALESCE(SUM(expected_reports), 0) AS expected,
       round_even(COALESCE(SUM(actual_reports), 0) / NULLIF(COALESCE(SUM(expected_reports), 0), 0), 2)
         AS completeness
FROM fm GROUP BY 1, 2""")
def q_kpi_completeness(spark, d):
    return K.completeness(V.facility_month(spark, d))


@query("scatter_points", """
SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part
WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL""")
def q_scatter_points(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"),
                                       F.col("p_retailprice").alias("y"))
    return O.complete_rows(p)


# ====================================================================== streaming

@query("stream_refresh", """
SELECT event_type, COUNT(*) AS n_events, round_even(SUM(value), 2) AS sum_value
FROM events GROUP BY event_type""")
def q_stream_refresh(spark, d):
    """Events picked up by a file stream (one availableNow refresh), counted and
    summed per type; equal to the batch aggregate."""
    schema = table(spark, d, "events").schema
    out = scratch_path(spark, "stream_refresh_out")
    ckpt = scratch_path(spark, "stream_refresh_ckpt")

    def transform(stream: DataFrame) -> DataFrame:
        g = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"),
                                             F.sum("value").alias("_sum"))
        return g.select("event_type", "n_events", X.round_even("_sum", 2).alias("sum_value"))

    return refresh_once(spark, f"{d.rstrip('/')}/events*.parquet", schema, transform, out, ckpt,
                        keys="event_type")


@query("stream_refresh_poll", """
SELECT event_type, COUNT(*) AS n_events, COUNT(DISTINCT user_id) AS n_users
FROM (SELECT event_type, user_id FROM events) GROUP BY event_type""")
def q_stream_refresh_poll(spark, d):
    """The polling refresh: the stream upserts the (event type, user) counts that changed;
    once it has caught up it is stopped, and the distinct users are counted from its table."""
    schema = table(spark, d, "events").schema
    out = scratch_path(spark, "stream_poll_out")
    ckpt = scratch_path(spark, "stream_poll_ckpt")
    running = refresh_every(spark, f"{d.rstrip('/')}/events*.parquet", schema,
                            lambda s: s.groupBy("event_type", "user_id").count(), out, ckpt,
                            interval="1 second", keys=["event_type", "user_id"])
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return read_current(spark, out).groupBy("event_type").agg(
        F.sum("count").alias("n_events"),
        F.count(F.when(F.col("user_id").isNotNull(), 1)).alias("n_users"))


@query("report_by_month", FM + """
SELECT district, period, COALESCE(SUM(actual_reports), 0) AS actual,
       COALESCE(SUM(expected_reports), 0) AS expected,
       round_even(COALESCE(SUM(actual_reports), 0) / NULLIF(COALESCE(SUM(expected_reports), 0), 0), 2)
         AS completeness
FROM fm GROUP BY 1, 2""")
def q_report_by_month(spark, d):
    """The dashboard job run twice over a growing folder of line items: first those shipped
    before 1998, then all. The second run writes only the months that came; the table of
    completeness is returned."""
    source, out = scratch_path(spark, "by_month_in"), scratch_path(spark, "by_month_out")
    for name in ("supplier", "nation", "region", "customer", "events"):
        table(spark, d, name).write.parquet(f"{source}/{name}.parquet")
    items = table(spark, d, "lineitem")
    late = F.coalesce(F.col("l_shipdate") >= F.lit("1998-01-01").cast("date"), F.lit(True))
    items.filter(~late).write.parquet(f"{source}/lineitem.parquet")
    refresh_months(spark, source, out)
    items.filter(late).write.mode("append").parquet(f"{source}/lineitem.parquet")
    refresh_months(spark, source, out)
    return read_output(spark, out, "completeness")
