"""Row filters. All are plain ``filter`` calls so Catalyst can push them to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.functions.nulls import regex_flag
from kpiframe.functions.util import as_list, to_col


def not_null(df: DataFrame, c) -> DataFrame:
    """Keep rows where a column (or an expression such as ``n / d * 1000``) is present."""
    return df.filter(to_col(c).isNotNull())


def exclude_values(df: DataFrame, c, values) -> DataFrame:
    """Drop rows whose value is one of ``values``; missing values are dropped too
    (a chain of ``x != v`` conditions is never TRUE on a missing ``x``)."""
    col = to_col(c)
    return df.filter(col.isNotNull() & ~col.isin(list(values)))


def matches(df: DataFrame, c, pattern: str) -> DataFrame:
    """Keep rows whose value matches a regex (missing → not kept)."""
    return df.filter(regex_flag(c, pattern))


def filter_equals(df: DataFrame, c, value) -> DataFrame:
    return df.filter(to_col(c) == F.lit(value))


def complete_rows(df: DataFrame, subset=None) -> DataFrame:
    """Drop rows with any missing value (``na.omit``)."""
    subset = as_list(subset) or None
    return df.dropna(how="any", subset=subset)


def range_censor(df: DataFrame, c: str, lo: float, hi: float, out: str | None = None) -> DataFrame:
    """Values outside ``[lo, hi]`` become NULL; the row is kept (axis limits)."""
    col = F.col(c)
    return df.withColumn(out or c, F.when(col.between(F.lit(lo), F.lit(hi)), col))
