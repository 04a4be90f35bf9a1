"""KPI panel builders parameterised by a column expression.

The dashboards pass a KPI as a bare column expression into a plotting helper;
here the helper returns the data the chart would draw. ``value`` may be a
column name or any Column (e.g. ``F.col("n") / F.col("d") * 1000``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.functions.arithmetic import per_thousand, percent_of, round_even, row_sum
from kpiframe.functions.nulls import null_to_zero
from kpiframe.functions.text import category_order, percent_label
from kpiframe.functions.util import as_list, to_col
from kpiframe.operators.predicates import range_censor
from kpiframe.operators.reshape import part_remainder, to_long
from kpiframe.operators.windows import last_present, number_within, stack_offsets


def _value(value, name: str | None) -> tuple[Column, str]:
    if isinstance(value, Column):
        return value, name or "value"
    return F.col(value), name or value


def _named_values(values, name: str | None) -> dict[str, Column]:
    """Column names, a Column (called ``name``) or ``{name: Column}`` as one mapping."""
    if isinstance(values, dict):
        return {n: v if isinstance(v, Column) else F.col(v) for n, v in values.items()}
    return {n: v for v, n in (_value(x, name) for x in as_list(values))}


def kpi_series(df: DataFrame, kpis, by: str = "adm0", date: str = "date",
               lo: float | None = None, hi: float | None = None,
               names_to: str = "kpi", values_to: str = "value",
               name: str | None = None) -> DataFrame:
    """Monthly series of one or many KPIs in long form, ordered by entity and
    date; values outside ``[lo, hi]`` become NULL (axis limits). ``kpis`` are
    column names, a Column expression (labelled ``name``) or a mapping of labels
    to either."""
    columns = _named_values(kpis, name)
    wide = df.select(by, date, *[c.alias(n) for n, c in columns.items()])
    long = to_long(wide, [by, date], list(columns), names_to, values_to)
    if lo is not None and hi is not None:
        long = range_censor(long, values_to, lo, hi)
    return long.orderBy(by, names_to, date)


def kpi_bars(df: DataFrame, value, by: str = "adm0", date: str = "date",
             name: str | None = None) -> DataFrame:
    """Present values per entity (one bar per entity and reporting date)."""
    v, n = _value(value, name)
    return df.select(by, date, v.alias(n)).filter(F.col(n).isNotNull())


def kpi_surveys(df: DataFrame, value, by: str = "adm0", date: str = "date",
                name: str | None = None, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Present values numbered 1, 2, 3 ... per entity in date order (baseline,
    midline, endline), censored to ``[lo, hi]``."""
    v, n = _value(value, name)
    present = df.select(by, date, v.alias(n)).filter(F.col(n).isNotNull())
    # a panel has one row per entity and date
    return range_censor(number_within(present, by, date, "survey", bounded=True), n, lo, hi)


def kpi_latest(df: DataFrame, value, by: str = "adm0", date: str = "date",
               name: str | None = None) -> DataFrame:
    """Latest present value per entity with its label as the value reads
    (``45.7%``): the chart with one part per entity and no remainder."""
    v, n = _value(value, name)
    latest = last_present(df.select(by, date, v.alias(n)), by, date, n)
    return latest.withColumns({"label": percent_label(n),
                               "label_pos": F.col(n) / F.lit(2.0)})


def kpi_latest_share(df: DataFrame, value, by: str = "adm0", date: str = "date",
                     name: str | None = None, total: float = 100.0) -> DataFrame:
    """Latest present percentage per entity and its remainder, as two rows,
    with the label text and the middle of each stacked part.

    Parts stack with the remainder at the bottom and the entity's value on
    top, as the pie charts draw them.
    """
    v, n = _value(value, name)
    latest = last_present(df.select(by, date, v.alias(n)), by, date, n)
    parts = part_remainder(latest, [by, date], n, total, "part", "percent")
    fill_order = F.when(F.col("part") == F.lit("value"), F.lit(1)).otherwise(F.lit(2))
    parts = parts.withColumns({
        "fill_group": F.when(F.col("part") == F.lit("value"), F.col(by))
        .otherwise(F.lit("remainder")),
        "fill_order": fill_order,
        "label": F.when(F.col("part") == F.lit("value"),
                        percent_label(round_even("percent", 0))),
    })
    return stack_offsets(parts, by, F.col("fill_order").desc(), "percent", "label_pos")


def kpi_density(df: DataFrame, n: str, d: str, by: str = "adm0", date: str = "date",
                per: float = 1000.0, lo: float = 0.0, hi: float = 15.0,
                name: str = "density") -> DataFrame:
    """Rate per 1,000 on rows where it can be computed, censored to ``[lo, hi]``."""
    rate = per_thousand(n, d) * F.lit(float(per) / 1000.0)
    present = df.select(by, date, rate.alias(name)).filter(F.col(name).isNotNull())
    return range_censor(present, name, lo, hi)


def kpi_achieved_vs_target(df: DataFrame, achieved, target, by: str = "adm0",
                           date: str = "date", digits: int = 0) -> DataFrame:
    """Achieved against target (column names or Columns) where the achievement is
    reported, with the whole-number percentage of target reached."""
    wide = df.select(by, date, to_col(achieved).alias("achieved"), to_col(target).alias("target"))
    return wide.filter(F.col("achieved").isNotNull()).withColumn(
        "pct_achieved", percent_of("achieved", "target", digits))


def kpi_trained_vs_target(df: DataFrame, clinical: str, nonclinical: str,
                          target_clinical: str, target_nonclinical: str,
                          by: str = "adm0", date: str = "date",
                          levels=("nonclinical", "clinical")) -> DataFrame:
    """Trained CHWs by cadre as stacked parts against the combined target.

    Rows where the clinical count is reported; one row per cadre (name with
    the common prefix removed); a missing non-clinical target counts as 0 in
    the combined target; ``chw_order`` follows ``levels`` (first level on
    top) and ``label_pos`` is the middle of each stacked part.
    """
    present = df.filter(F.col(clinical).isNotNull())
    target_all = row_sum(target_clinical, null_to_zero(target_nonclinical))
    wide = present.select(by, date, F.col(clinical).alias("trained_clinical"),
                          F.col(nonclinical).alias("trained_nonclinical"),
                          target_all.alias("target_all"))
    long = to_long(wide, [by, date, "target_all"], ["trained_clinical", "trained_nonclinical"],
                   "chw", "trained", names_prefix="trained_")
    long = long.withColumn("chw_order", category_order("chw", list(levels)))
    return stack_offsets(long, [by, date], F.col("chw_order").desc(), "trained", "label_pos")


def complete_panel(df: DataFrame, entity: str, period: str, values,
                   months: int = 1) -> DataFrame:
    """Every entity × every period between the first and the last period of
    ``df``; periods an entity did not report stay as rows with missing values.

    ``df`` is an aggregate with one row per (entity, period), so an entity's rows are
    few: they are folded to one list per entity (one shuffle), and the list is filled by
    the sequence of periods. The first and last period come from a scalar subquery over
    the same aggregate, whose exchange Spark reuses. No join, no checkpoint. Rows without
    a period are left out; a missing entity is an entity.
    """
    values = as_list(values)
    base = df.select(F.col(entity).alias("_e"), F.col(period).alias("_p"),
                     F.struct(*values).alias("_v")).filter(F.col("_p").isNotNull())
    span = base.agg(F.sequence(F.min("_p"), F.max("_p"),
                               F.expr(f"INTERVAL {int(months)} MONTH")).alias("m")).scalar()
    held = base.groupBy("_e").agg(F.collect_list(F.struct("_p", "_v")).alias("_held"))
    kind = base.schema["_v"].dataType

    def of_period(p):
        """A period's rows, or one without values."""
        mine = F.filter("_held", lambda h: h["_p"] == p)
        gap = F.array(F.struct(p.alias("_p"), F.lit(None).cast(kind).alias("_v")))
        return F.when(F.exists("_held", lambda h: h["_p"] == p), mine).otherwise(gap)

    # a column first: a subquery may not stand inside a lambda
    rows = held.withColumn("_span", span).select(
        F.col("_e").alias(entity), F.inline(F.flatten(F.transform("_span", of_period))))
    return rows.select(entity, F.col("_p").alias(period),
                       *[F.col(f"_v.`{v}`").alias(v) for v in values])


def annotate_kpis(results: DataFrame, dictionary: DataFrame, key: str = "kpi") -> DataFrame:
    """KPI results in long form with the dictionary's description and
    disaggregation (Spark broadcasts the dictionary as long as it is small)."""
    return results.join(dictionary, key, "left")
