"""Date expressions: month parsing, month start, report stamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiframe.functions.util import to_col

# Fixed formats (Spark datetime patterns).
MONTH_NAME_FORMAT = "MMMM yyyy"   # "August 2025"
REPORT_STAMP_FORMAT = "yyyy-MMM-dd"  # "2025-Aug-01"


def period_parse(c, fmt: str = MONTH_NAME_FORMAT) -> Column:
    """Month-name text to the first day of that month; unparseable text → NULL."""
    return F.try_to_date(to_col(c), fmt)


def month_start(c) -> Column:
    """First day of the month of a date or timestamp, as DATE."""
    return F.trunc(F.to_date(to_col(c)), "month")


def month_name(c, fmt: str = MONTH_NAME_FORMAT) -> Column:
    """Date to month-name text."""
    return F.date_format(to_col(c), fmt)


def report_stamp(fmt: str = REPORT_STAMP_FORMAT) -> Column:
    """Today's date as text, the stamp on a report."""
    return F.date_format(F.current_date(), fmt)
