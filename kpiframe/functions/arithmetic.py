"""Ratios, rounding and row-wise arithmetic.

Division by zero gives NULL (``try_divide``), never an error or an infinity.
Rounding is half-to-even on the binary double: ``rint(x * 10^k) / 10^k``.
The operand order of ``n / d * 100`` is kept as written because a different
order can change the last bit and so the rounded result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiframe.functions.util import to_col


def safe_ratio(n, d) -> Column:
    """``n / d`` as double, NULL when ``d`` is 0 or either side is missing."""
    return F.try_divide(to_col(n).cast("double"), to_col(d).cast("double"))


def round_even(c, digits: int = 0) -> Column:
    """Round half to even at ``digits`` decimals."""
    x = to_col(c)
    if digits == 0:
        return F.rint(x)
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def percent_of(n, d, digits: int | None = 2) -> Column:
    """``round(n / d * 100, digits)``; ``digits=None`` leaves it unrounded."""
    p = safe_ratio(n, d) * F.lit(100.0)
    return p if digits is None else round_even(p, digits)


def proportion_of(n, d, digits: int | None = 2) -> Column:
    """``round(n / d, digits)``."""
    p = safe_ratio(n, d)
    return p if digits is None else round_even(p, digits)


def per_thousand(n, d) -> Column:
    """Rate per 1,000: ``n / d * 1000``."""
    return safe_ratio(n, d) * F.lit(1000.0)


def complement(c, total: float = 100.0) -> Column:
    """``total - x`` (the share *without* the condition)."""
    return F.lit(float(total)) - to_col(c)


def row_sum(*cols) -> Column:
    """Row-wise ``c1 + c2 + ...`` (missing if any term is missing, as in R)."""
    return reduce(lambda a, b: a + b, [to_col(c) for c in cols])
