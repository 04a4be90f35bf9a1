"""Sorting, limits and appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.functions.util import as_list
from kpiframe.operators.ranges import default_ranges, with_range


def sorted_by(df: DataFrame, keys) -> DataFrame:
    """Final ordering of a KPI result by its keys (range-partitioned sort)."""
    return df.orderBy(*as_list(keys))


def head_rows(df: DataFrame, n: int = 6, order=None) -> DataFrame:
    """The first ``n`` rows in an explicit order (a distributed top-k)."""
    order = as_list(order)
    if not order:
        raise ValueError("head_rows: an explicit order is required")
    return df.orderBy(*order).limit(n)


def append(*dfs: DataFrame) -> DataFrame:
    """Append tables of the same layout by name; duplicates kept, a column
    mismatch is an error (``rbind``)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), dfs)


def level_number(df: DataFrame, c: str, name: str = "level", ranges: int | None = None) -> DataFrame:
    """Add the 1-based number of each value among the sorted distinct values of
    ``c`` (the default order of a category); missing values have none.

    A distributed dense rank: the distinct values are cut into ``ranges`` (default: the
    width of shuffles) at sampled bounds, ranked inside each range, and shifted by the
    sizes of the ranges before, one small array. They are joined back on the value."""
    ranges = ranges or default_ranges(df)
    levels = df.select(F.col(c).alias("_level")).filter(F.col("_level").isNotNull()).distinct()
    keyed = with_range(levels, ["_level"], ranges)
    sizes = keyed.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n")).agg(
        F.collect_list(F.struct("_chunk", "n")).alias("s"))
    before = sizes.select(F.transform(F.sequence(F.lit(0), F.lit(ranges)), lambda k: F.aggregate(
        F.filter("s", lambda x: x["_chunk"] < k), F.lit(0).cast("long"),
        lambda a, x: a + x["n"]))).scalar()
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy("_level"))
    ranked = keyed.select("_level", (inside + F.element_at(before, F.col("_chunk") + 1))
                          .cast("long").alias(name))
    return df.join(ranked, F.col(c) == F.col("_level"), "left").select(*df.columns, name)
