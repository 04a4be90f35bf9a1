"""Plan properties that must hold at any scale, checked on every registered query:
no cartesian or nested-loop joins, no Python evaluation, and column pruning down
to the fact-table scan."""

import re

import pytest

from kpiframe.plans.catalog import REGISTRY
from tests.conftest import SF_SMALL
from tools.plan_report import FORBIDDEN, plan_of


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_no_cross_join_no_python(spark, key):
    df = REGISTRY[key](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = plan_of(df)
    assert not [f for f in FORBIDDEN if f in plan], plan


def _lineitem_read_schemas(plan: str) -> list[str]:
    """Column lists of the lineitem scans (``FileScan parquet [a#1,b#2] ... lineitem``)."""
    return re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem\.parquet", plan)


def test_fact_scan_is_pruned(spark):
    df = REGISTRY["facility_month"](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    schemas = _lineitem_read_schemas(plan_of(df))
    assert schemas, "lineitem scan not found"
    for s in schemas:
        cols = {c.split("#")[0] for c in s.split(",")}
        assert cols == {"l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"}


def test_referral_is_join_free_single_scan(spark):
    df = REGISTRY["kpi_referral"](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = plan_of(df)
    assert "SortMergeJoin" not in plan
    assert len(_lineitem_read_schemas(plan)) == 1


def test_pre_aggregation_before_join(spark):
    """lineitem is partially aggregated before any join or shuffle."""
    df = REGISTRY["facility_month"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("lineitem.parquet")
    partial = plan.rfind("partial_sum", 0, scan)
    assert partial != -1
