"""Ranges of a sort order as pure expressions of the row.

Numbering rows or ranking values over a whole table needs its order cut into ranges that
tasks can sort on their own, and the same cut wherever it is used. ``range_bounds`` takes the
bounds from the keys with the smallest hashes, so they depend on the keys alone (not on
partitions, tasks or retries) and stay a scalar subquery: nothing is collected, checkpointed
or written. ``with_range`` finds a row's range among them by binary search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sampled keys per range, and the most ranges (the bounds are one array value)
SAMPLED = 16
MOST_RANGES = 4096


def default_ranges(df: DataFrame) -> int:
    """As many ranges as shuffles have partitions, at most ``MOST_RANGES``."""
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)


def sort_key(columns: list[str]) -> Column:
    """``columns`` as one value that compares as their sort order does (NULL first)."""
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)])


def range_bounds(df: DataFrame, columns: list[str], ranges: int) -> Column:
    """Ascending upper bounds of all ranges but the last, as an array column: every
    ``SAMPLED``-th of a sample of the distinct keys (a distributed top-k by hash)."""
    size = max(1, ranges) * SAMPLED
    keys = df.select(sort_key(columns).alias("k"))
    by_hash = keys.select("k", F.xxhash64("k").alias("h")).distinct().orderBy("h", "k").limit(size)
    bounds = by_hash.agg(F.array_sort(F.collect_list("k")).alias("s")).select(
        F.filter("s", lambda k, i: i % SAMPLED == SAMPLED - 1).alias("b"))
    return bounds.scalar()


def with_range(df: DataFrame, columns: list[str], ranges: int, name: str = "_chunk",
               sample: DataFrame | None = None) -> DataFrame:
    """``df`` with the number of each row's range: how many bounds lie below its key, 0 to
    ``ranges``. Equal keys share a range, and a greater key never has a smaller number.
    ``sample`` (default ``df``) is where the bounds come from."""
    bounds = range_bounds(df if sample is None else sample, columns, ranges)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, ranges).bit_length()))])
    key = sort_key(columns)

    def halve(low, step):
        there = low + step
        below = (there <= F.size("_bounds")) & (F.try_element_at("_bounds", there) < key)
        return F.when(below, there).otherwise(low)

    # a column first: a subquery may not stand inside a lambda
    return (df.withColumn("_bounds", bounds)
            .withColumn(name, F.aggregate(steps, F.lit(0), halve)).drop("_bounds"))
