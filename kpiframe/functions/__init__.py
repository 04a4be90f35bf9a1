"""Column → Column expressions (all native Spark, whole-stage-codegen friendly)."""

from kpiframe.functions.arithmetic import (
    complement,
    per_thousand,
    percent_of,
    proportion_of,
    round_even,
    row_sum,
    safe_ratio,
)
from kpiframe.functions.dates import (
    month_name,
    month_start,
    period_parse,
    report_stamp,
)
from kpiframe.functions.nulls import count_if, if_else, null_to_zero, regex_flag, sum_na
from kpiframe.functions.text import (
    category_order,
    classify,
    lookup_by_pattern,
    percent_label,
    recode,
)
from kpiframe.functions.util import as_list, to_col

__all__ = [
    "as_list", "category_order", "classify", "complement", "count_if", "if_else",
    "lookup_by_pattern", "month_name", "month_start", "null_to_zero", "per_thousand",
    "percent_label", "percent_of", "period_parse", "proportion_of", "recode",
    "regex_flag", "report_stamp", "round_even", "row_sum", "safe_ratio",
    "sum_na", "to_col",
]
