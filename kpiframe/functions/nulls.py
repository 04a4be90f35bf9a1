"""Missing-value rules (R-style semantics expressed as native Column expressions).

* a sum over a group whose values are all missing is 0, not NULL;
* a regex test on a missing value is FALSE, not NULL;
* a two-way conditional on a missing condition is missing (not the ELSE branch).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiframe.functions.util import to_col


def null_to_zero(c) -> Column:
    """Missing → 0 for one column (``ifelse(is.na(x), 0, x)``)."""
    return F.coalesce(to_col(c), F.lit(0))


def sum_na(c) -> Column:
    """Aggregate: sum that ignores missing values and gives 0 for an all-missing group."""
    return F.coalesce(F.sum(to_col(c)), F.lit(0))


def count_if(cond: Column) -> Column:
    """Aggregate: number of rows where ``cond`` is TRUE (missing counts as FALSE)."""
    return F.count_if(cond)


def if_else(cond: Column, yes, no) -> Column:
    """Two-way conditional that keeps a missing condition missing."""
    yes_c = yes if isinstance(yes, Column) else F.lit(yes)
    no_c = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes_c).otherwise(no_c)


def regex_flag(c, pattern: str) -> Column:
    """Regex test that is FALSE, not NULL, on a missing value."""
    return F.coalesce(to_col(c).rlike(pattern), F.lit(False))
