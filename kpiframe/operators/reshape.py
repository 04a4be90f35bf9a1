"""Wide → long reshaping.

``to_long`` is Spark's ``unpivot`` (an ``Expand`` node: row-local, no shuffle).
Value columns are cast to one common type first, and a name filter is applied
to the column *list* before unpivoting, so unwanted columns are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.functions.util import as_list


def to_long(df: DataFrame, ids, values=None, names_to: str = "name", values_to: str = "value",
            names_prefix: str | None = None, name_pattern: str | None = None,
            drop_na: bool = False, value_type: str | None = "double") -> DataFrame:
    """Unpivot ``values`` (default: every non-id column) into ``(names_to, values_to)``.

    * ``name_pattern``: keep only value columns whose name matches this regex
      (resolved here, so pruned columns never reach the scan);
    * ``names_prefix``: strip this literal prefix from the names;
    * ``drop_na``: drop rows whose value is missing (``values_drop_na``).
    Missing values are kept by default, as ``pivot_longer`` does.
    """
    ids = as_list(ids)
    values = [c for c in (as_list(values) or df.columns) if c not in ids]
    if name_pattern is not None:
        rx = re.compile(name_pattern)
        values = [c for c in values if rx.search(c)]
    if not values:
        raise ValueError("to_long: no value columns selected")
    src = df.select(*ids, *[F.col(c).cast(value_type).alias(c) if value_type else F.col(c)
                            for c in values])
    out = src.unpivot(ids, values, names_to, values_to)
    if names_prefix:
        out = out.withColumn(names_to, F.regexp_replace(F.col(names_to),
                                                        "^" + re.escape(names_prefix), ""))
    if drop_na:
        out = out.filter(F.col(values_to).isNotNull())
    return out


def part_remainder(df: DataFrame, ids, value: str, total: float = 100.0,
                   names_to: str = "part", values_to: str = "value",
                   part_label: str = "value", remainder_label: str = "remainder") -> DataFrame:
    """Split a share into two rows: the value and ``total - value``."""
    ids = as_list(ids)
    wide = df.select(*ids,
                     F.col(value).cast("double").alias(part_label),
                     (F.lit(float(total)) - F.col(value).cast("double")).alias(remainder_label))
    return wide.unpivot(ids, [part_label, remainder_label], names_to, values_to)
