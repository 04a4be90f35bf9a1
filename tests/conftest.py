import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kpiframe.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 8, app_name="kpiframe-tests")
    yield s
    s.stop()


def _d(m):
    return dt.date(2020, m, 1)


# Toy KPI panel: 4 countries × 4 months, a subset of the dashboard's columns
# (values as in the demonstration panel; NULL = not reported).
PANEL_COLUMNS = ["adm0", "date", "rhcc3_clinical", "rhcc3_nonclinical", "rhcc5_n", "rhcc5_d",
                 "rhcc6", "rhcc13", "rhcc16", "target_clinical", "target_nonclinical"]
PANEL_ROWS = [
    ("DRC", _d(1), 1850.0, None, 800.0, 360000.0, 15.0, 15.0, 50.0, 2000.0, None),
    ("DRC", _d(2), None, None, None, None, None, None, None, 2000.0, None),
    ("DRC", _d(3), None, None, None, None, None, None, None, 2000.0, None),
    ("DRC", _d(4), None, None, None, None, None, None, 60.0, 2000.0, None),
    ("MOZ", _d(1), 250.0, 3700.0, 200.0, 47600.0, 50.0, 20.0, 68.0, 280.0, 4300.0),
    ("MOZ", _d(2), None, None, None, None, None, None, None, 280.0, 4300.0),
    ("MOZ", _d(3), None, None, None, None, None, None, None, 280.0, 4300.0),
    ("MOZ", _d(4), None, None, None, None, None, None, 75.0, 280.0, 4300.0),
    ("NGA", _d(1), 2200.0, 400.0, 2310.0, 595000.0, None, 35.0, 34.0, 2292.0, 458.0),
    ("NGA", _d(2), None, None, None, None, 70.0, None, None, 2292.0, 458.0),
    ("NGA", _d(3), None, None, None, None, None, None, 46.0, 2292.0, 458.0),
    ("NGA", _d(4), None, None, None, None, None, None, None, 2292.0, 458.0),
    ("ZMB", _d(1), 2000.0, None, 1980.0, 177310.0, 35.0, 40.0, 30.0, 2086.0, None),
    ("ZMB", _d(2), None, None, None, None, None, None, None, 2086.0, None),
    ("ZMB", _d(3), None, None, None, None, None, None, None, 2086.0, None),
    ("ZMB", _d(4), None, None, None, None, None, None, None, 2086.0, None),
]
PANEL_SCHEMA = ("adm0 string, date date, rhcc3_clinical double, rhcc3_nonclinical double, "
                "rhcc5_n double, rhcc5_d double, rhcc6 double, rhcc13 double, rhcc16 double, "
                "target_clinical double, target_nonclinical double")


@pytest.fixture(scope="session")
def panel(spark):
    return spark.createDataFrame(PANEL_ROWS, PANEL_SCHEMA)


# Facility-month report with the awkward cases: a NULL stock, a zero, a
# fractional stock below 1, an aggregate-level row, an all-NULL group and a
# zero denominator.
REPORT_SCHEMA = ("district string, facility string, period date, periodname string, "
                 "stock_a double, stock_n double, diarrhoea_5_female double, "
                 "malaria_treated_5yrs double, diarrhoea_referred_5_female double, "
                 "malaria_referred_5yrs double, actual_reports double, expected_reports double")
REPORT_ROWS = [
    ("D1", "F1", _d(7), "July 2020", None, 5.0, 10.0, 4.0, 2.0, 1.0, 1.0, 1.0),
    ("D1", "F2", _d(7), "July 2020", 0.0, 3.0, 5.0, None, 1.0, None, 0.0, 1.0),
    ("D1", "F3", _d(7), "July 2020", 0.5, 0.0, None, 2.0, 3.0, 1.0, 1.0, 1.0),
    ("D1", "no D1 District", _d(7), "July 2020", 9.0, 9.0, 99.0, 99.0, 99.0, 99.0, 9.0, 9.0),
    ("D2", "G1", _d(8), "August 2020", None, None, None, None, None, None, None, None),
    ("D2", "G2", _d(8), "August 2020", None, None, None, None, None, None, 0.0, 0.0),
]


@pytest.fixture(scope="session")
def report(spark):
    return spark.createDataFrame(REPORT_ROWS, REPORT_SCHEMA)
