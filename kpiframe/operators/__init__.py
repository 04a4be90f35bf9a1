"""DataFrame → DataFrame operators (lazy; none of them starts a job)."""

from kpiframe.operators.aggregates import (
    count_by,
    count_if_by,
    group_agg,
    histogram,
    ratio_of_sums,
    share_without,
    sum_by,
    with_total,
    with_total_sum,
)
from kpiframe.operators.joins import (
    inner_join_nullsafe,
    left_join_nullsafe,
    lookup_by_pattern,
    lookup_by_rules,
)
from kpiframe.operators.ordering import append, head_rows, level_number, sorted_by
from kpiframe.operators.predicates import (
    complete_rows,
    exclude_values,
    filter_equals,
    matches,
    not_null,
    range_censor,
)
from kpiframe.operators.reshape import part_remainder, to_long
from kpiframe.operators.schema import (
    clean_name_list,
    clean_names,
    cols_between,
    cols_except,
    cols_matching,
    rename_select,
    select_except,
    select_matching,
    select_range,
    tag,
    with_columns,
)
from kpiframe.operators.windows import (
    entity_page,
    first_per_group,
    group_size,
    last_per_group,
    last_present,
    number_within,
    stack_offsets,
)

__all__ = [
    "append", "clean_name_list", "clean_names", "cols_between", "cols_except", "cols_matching",
    "complete_rows", "count_by", "count_if_by", "entity_page", "exclude_values", "filter_equals",
    "first_per_group", "group_agg", "group_size", "head_rows", "histogram", "inner_join_nullsafe",
    "last_per_group", "last_present", "left_join_nullsafe", "level_number", "lookup_by_pattern",
    "lookup_by_rules", "matches",
    "not_null", "number_within", "part_remainder", "range_censor", "ratio_of_sums",
    "rename_select", "select_except", "select_matching", "select_range", "share_without",
    "sorted_by", "stack_offsets", "sum_by", "tag", "to_long", "with_columns", "with_total",
    "with_total_sum",
]
