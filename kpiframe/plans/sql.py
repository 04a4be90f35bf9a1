"""DuckDB twins of the views, used as CTEs by the oracle SQL of every query."""

from __future__ import annotations

FACILITY_MONTH = """
fm AS MATERIALIZED (
  SELECT r.r_name AS province, n.n_name AS district, s.s_name AS facility,
         CAST(date_trunc('month', l.l_shipdate) AS DATE) AS period,
         strftime(CAST(date_trunc('month', l.l_shipdate) AS DATE), '%B %Y') AS periodname,
         SUM(CASE WHEN l.l_returnflag = 'A' THEN l.l_quantity END) AS stock_a,
         SUM(CASE WHEN l.l_returnflag = 'N' THEN l.l_quantity END) AS stock_n,
         SUM(CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity END) AS stock_r,
         SUM(CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'O' THEN 1::DOUBLE END) AS diarrhoea_5_female,
         SUM(CASE WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'O' THEN 1::DOUBLE END) AS pneumonia_male_5,
         SUM(CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN 1::DOUBLE END) AS malaria_treated_5yrs,
         SUM(CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'F' THEN 1::DOUBLE END) AS diarrhoea_referred_5_female,
         SUM(CASE WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'F' THEN 1::DOUBLE END) AS pneumonia_referred_male_5,
         SUM(CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 1::DOUBLE END) AS malaria_referred_5yrs,
         SUM(CASE WHEN l.l_linestatus = 'F' THEN 1::DOUBLE ELSE 0::DOUBLE END) AS actual_reports,
         CAST(COUNT(*) AS DOUBLE) AS expected_reports
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY s.s_suppkey, 1, 2, 3, 4, 5
)"""

TRAINING = """
tr AS (
  SELECT r.r_name AS province, n.n_name AS district, c.c_mktsegment AS cadre,
         CASE WHEN c.c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS equipped_yes_no,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1::DOUBLE END AS male_trained,
         CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 1::DOUBLE END AS female_trained
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

TRAINING_BASE = TRAINING + """,
tb AS (
  SELECT province, district,
         COALESCE(SUM(male_trained), 0) AS male_chws_trained,
         COALESCE(SUM(female_trained), 0) AS female_chws_trained,
         COALESCE(SUM(CASE WHEN equipped_yes_no IS NULL THEN NULL
                           WHEN equipped_yes_no = 'Yes' THEN male_trained ELSE 0::DOUBLE END), 0)
           AS male_chws_equipped,
         COALESCE(SUM(CASE WHEN equipped_yes_no IS NULL THEN NULL
                           WHEN equipped_yes_no = 'Yes' THEN female_trained ELSE 0::DOUBLE END), 0)
           AS female_chws_equipped
  FROM tr WHERE province IS NOT NULL
  GROUP BY province, district
)"""

KPI_PANEL = """
kp AS (
  SELECT event_type AS adm0, CAST(ts AS DATE) AS date,
         CAST(COUNT(*) AS DOUBLE) AS n_events,
         CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS n_users,
         CAST(NULLIF(SUM(CASE WHEN value > 180 THEN 1 ELSE 0 END), 0) AS DOUBLE) AS n_large
  FROM events
  GROUP BY 1, 2
)"""

# the six case-count columns of fm, in long form with nulls kept
FM_COUNTS_LONG = """
fm_counts AS (
  SELECT district, facility, period, periodname, stat, value
  FROM (SELECT district, facility, period, periodname, diarrhoea_5_female, pneumonia_male_5,
               malaria_treated_5yrs, diarrhoea_referred_5_female, pneumonia_referred_male_5,
               malaria_referred_5yrs FROM fm)
  UNPIVOT INCLUDE NULLS (value FOR stat IN (diarrhoea_5_female, pneumonia_male_5,
    malaria_treated_5yrs, diarrhoea_referred_5_female, pneumonia_referred_male_5,
    malaria_referred_5yrs))
)"""


def classify_sql(stat: str) -> str:
    """Age group, gender and disease from a count column's name."""
    return f"""
    CASE WHEN COALESCE(regexp_matches({stat}, '5'), false) THEN 'Under 5' ELSE 'All Ages' END AS age_group,
    CASE WHEN COALESCE(regexp_matches({stat}, '_female'), false) THEN 'Female'
         WHEN COALESCE(regexp_matches({stat}, '_male'), false) THEN 'Male'
         ELSE 'Combined' END AS gender,
    CASE WHEN COALESCE(regexp_matches({stat}, 'malaria'), false) THEN 'Malaria'
         WHEN COALESCE(regexp_matches({stat}, 'pneumonia'), false) THEN 'Pneumonia'
         WHEN COALESCE(regexp_matches({stat}, 'diarrhoea'), false) THEN 'Diarrhoea' END AS disease"""


REFERRAL_SIDES = FM_COUNTS_LONG + f""",
managed AS (
  SELECT district, facility, period, periodname, stat AS stat2, value AS managed_count,
         {classify_sql('stat')}
  FROM fm_counts
  WHERE stat IN ('diarrhoea_5_female', 'pneumonia_male_5', 'malaria_treated_5yrs')
    AND value IS NOT NULL
),
referred AS (
  SELECT district, facility, period, periodname, stat, value AS referral_count,
         {classify_sql('stat')}
  FROM fm_counts
  WHERE stat LIKE '%referred%' AND value IS NOT NULL
),
joined AS (
  SELECT r.district, r.facility, r.period, r.periodname, r.age_group, r.gender, r.disease,
         r.stat, r.referral_count, m.stat2, m.managed_count
  FROM referred r LEFT JOIN managed m
    ON r.district IS NOT DISTINCT FROM m.district
   AND r.facility IS NOT DISTINCT FROM m.facility
   AND r.period IS NOT DISTINCT FROM m.period
   AND r.periodname IS NOT DISTINCT FROM m.periodname
   AND r.age_group IS NOT DISTINCT FROM m.age_group
   AND r.gender IS NOT DISTINCT FROM m.gender
   AND r.disease IS NOT DISTINCT FROM m.disease
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().lstrip(",") for c in ctes)


def sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
