"""The dashboard refresh job: views written once, every KPI from the files,
equal to the same KPI computed directly on the tables."""

from kpiframe.plans import report as R
from kpiframe.session import scratch_path
from tests.conftest import SF_SMALL

import __spark_entry__ as E

SAME_AS = {"referral": "kpi_referral", "stockout_by_item": "kpi_stockout_by_item",
           "completeness": "kpi_completeness", "target_reached": "kpi_target_reached",
           "latest_share": "kpi_latest_share", "surveys": "kpi_surveys"}


def test_refresh_writes_every_kpi_and_matches_catalog(spark):
    out = scratch_path(spark, "t_report")
    written = R.refresh(spark, SF_SMALL, out)
    assert set(written) == set(R.KPIS)
    for name, key in SAME_AS.items():
        got = spark.read.parquet(written[name])
        want = E.queries()[key](spark, SF_SMALL)
        assert sorted(got.columns) == sorted(want.columns)
        got, want = got.select(*want.columns), want
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, name
