"""Literal tables that the dashboards carry in code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KPI_DICTIONARY_SCHEMA = "kpi string, description string, disaggregation string"

# The KPI dictionary (code, description, disaggregation), in
# the order the multi-country page lists them.
KPI_DICTIONARY_ROWS = [
    ("RHCC1", "Under-five mortality rate in RHCC project areas", ""),
    ("RHCC1.1", "Under-five hospitalization rate in RHCC project areas", ""),
    ("RHCC2", "% of cases managed at community level", "disease"),
    ("RHCC3", "# of CHWs trained", "cadre"),
    ("RHCC4", "# of trained CHWs equipped according to national guidelines", ""),
    ("RHCC5", "# of CHWs trained and deployed for iCCM per 1,000 children under-five in RHCC areas", ""),
    ("RHCC6", "# of CHW supervisors trained", ""),
    ("RHCC7", "% of CHWs who received at least one supervisory contact in the prior month (where registers were reviewed)", ""),
    ("RHCC8", "% of CHWs who correctly count respiratory rate to diagnose ARI", ""),
    ("RHCC9", "% of sick child cases recommended for referral by CHW", ""),
    ("RHCC9.1", "% of sick children referred by CHWs who are received at referral facility", ""),
    ("RHCC10", "% of CHWs trained in iCCM who are providing iCCM 1 year after initial training", ""),
    ("RHCC11", "% of health facilities with no stock-outs of key iCCM medicines and diagnostics in the past month", "disease"),
    ("RHCC12", "% of CHWs who with no stock-outs of key iCCM medicines and diagnostics in the past month", "disease"),
    ("RHCC13", "% of reports submitted on time", ""),
    ("RHCC14", "% of accurate reports submitted", ""),
    ("RHCC15", "% of complete reports submitted", ""),
    ("RHCC16", "% of community members aware of iCCM services", ""),
    ("RHCC17", "% of community members who know the location of their CHW", ""),
    ("RHCC18", "% of caregivers who know two or more signs of childhood illness that require immediate assessment and, if appropriate, treatment", ""),
]

# The rows in which the main page's dictionary differs (it has no
# RHCC1.1, other texts for RHCC11 and RHCC12, and disaggregates these two only).
MAIN_PAGE_DESCRIPTIONS = {
    "RHCC11": "% of iCCM sites/outreach posts with no stock-outs of key iCCM medicines and diagnostics in the past month",
    "RHCC12": "% of CHWs who had no stock-outs of commodities during the reporting period",
}
MAIN_PAGE_DISAGGREGATION = {"RHCC11": "disease", "RHCC12": "disease"}
MAIN_PAGE_DICTIONARY_ROWS = [
    (kpi, MAIN_PAGE_DESCRIPTIONS.get(kpi, text), MAIN_PAGE_DISAGGREGATION.get(kpi, ""))
    for kpi, text, _ in KPI_DICTIONARY_ROWS if kpi != "RHCC1.1"
]

# District CHW training targets of the main page (first match
# wins) and the national total, which is an input of its own (it is not the
# sum of the district targets).
CHW_DISTRICT_TARGETS = [
    ("Kasama", 747.0),
    ("Chisamba", 346.0),
    ("Ngabwe", 94.0),
    ("Luwingu", 226.0),
    ("Chilubi", 241.0),
]
CHW_NATIONAL_TARGET = 2086.0

# Facility names that are aggregate levels (ministry, province, district)
# and must not be counted as facilities.
AGGREGATE_UNIT_NAMES = [
    "zm Zambia Ministry of Health",
    "no Northern Province",
    "no Kasama District",
    "ce Chisamba District",
    "ce Ngabwe District",
]


def kpi_dictionary(spark: SparkSession, page: str = "countries") -> DataFrame:
    """The KPI dictionary of the multi-country page (20 rows) or of the ``"main"``
    page (19 rows)."""
    rows = {"countries": KPI_DICTIONARY_ROWS, "main": MAIN_PAGE_DICTIONARY_ROWS}[page]
    return spark.createDataFrame(rows, KPI_DICTIONARY_SCHEMA)
