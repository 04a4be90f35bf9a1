"""Every registered query against its DuckDB oracle on the smallest data set
(the driver does the same at sf0.01)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from kpiframe.plans.catalog import ORACLE, REGISTRY
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_key_has_oracle_or_is_known():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(REGISTRY) == set(ORACLE) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["district", "period", "n_facilities", "stat", "pct", "item"]


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test data not present")
@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = REGISTRY[key](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[key])
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _canon(rows, cols) == _canon(orows, ocols)


# O1, O2: the queries whose rows come in an order
@pytest.mark.parametrize("key, by", [("sorted_group", ["district", "period"]),
                                     ("kpi_series", ["adm0", "kpi", "date"])])
def test_order_is_that_of_the_oracle(spark, con, key, by):
    rows = [tuple(r[c] for c in by) for r in REGISTRY[key](spark, SF_SMALL).collect()]
    res = con.execute(ORACLE[key])
    at = [[d[0] for d in res.description].index(c) for c in by]
    assert rows == [tuple(r[i] for i in at) for r in res.fetchall()]
