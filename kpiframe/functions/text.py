"""Regex classification, recoding, labels and explicit category order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiframe.functions.nulls import regex_flag
from kpiframe.functions.util import to_col


def classify(c, rules, default=None) -> Column:
    """First matching regex wins: ``[(pattern, label), ...]``.

    With ``default=None`` an unmatched value is missing (``case_when`` without
    a fallback); otherwise it becomes ``default``.
    """
    expr = None
    for pattern, label in rules:
        cond = regex_flag(c, pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def lookup_by_pattern(c, rules, default=None) -> Column:
    """Value look-up by the first regex that matches (numbers, not labels).

    Written as one CASE expression: no join, no shuffle, and a first-match-wins
    order that a join would have to rebuild with a window.
    """
    return classify(c, rules, default)


def recode(c, mapping: dict, keep_unmapped: bool = True) -> Column:
    """Replace values by name (``{"old": "new"}``); unmapped values are kept
    (or become NULL with ``keep_unmapped=False``)."""
    col = to_col(c)
    expr = None
    for old, new in mapping.items():
        cond = col == F.lit(old)
        expr = F.when(cond, F.lit(new)) if expr is None else expr.when(cond, F.lit(new))
    if expr is None:
        return col
    return expr.otherwise(col) if keep_unmapped else expr


def category_order(c, levels) -> Column:
    """Integer sort key for an explicit level order (1-based; NULL if not a level)."""
    col = to_col(c)
    expr = None
    for i, lv in enumerate(levels, start=1):
        cond = col == F.lit(lv)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def percent_label(c, na_label: str | None = None) -> Column:
    """``paste0(x, "%")``: a whole number without decimals, any other as it is
    (``45%``, ``45.7%``).

    Missing values give NULL unless ``na_label`` is given (R prints ``NA%``).
    """
    col = to_col(c)
    number = col.cast("double")
    whole = (number == F.rint(number)) & (F.abs(number) < F.lit(1e15))
    text = F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))
    label = F.concat(text, F.lit("%"))
    if na_label is not None:
        label = F.when(col.isNull(), F.lit(na_label)).otherwise(label)
    return label
