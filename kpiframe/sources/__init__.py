"""Sources and sinks: files, literal tables, generated panels and samples."""

from kpiframe.sources.files import read_many, read_table, write_csv, write_if_absent
from kpiframe.sources.generators import (
    demo_sample,
    panel_grid,
    poisson_from_uniform,
    poisson_thresholds,
    uniform,
)
from kpiframe.sources.literals import (
    KPI_DICTIONARY_ROWS,
    MAIN_PAGE_DICTIONARY_ROWS,
    AGGREGATE_UNIT_NAMES,
    CHW_DISTRICT_TARGETS,
    CHW_NATIONAL_TARGET,
    kpi_dictionary,
)
from kpiframe.sources.tables import table

__all__ = [
    "KPI_DICTIONARY_ROWS", "MAIN_PAGE_DICTIONARY_ROWS", "AGGREGATE_UNIT_NAMES", "CHW_DISTRICT_TARGETS",
    "CHW_NATIONAL_TARGET", "demo_sample", "kpi_dictionary", "panel_grid",
    "poisson_from_uniform", "poisson_thresholds", "read_many", "read_table", "table", "uniform", "write_csv",
    "write_if_absent",
]
