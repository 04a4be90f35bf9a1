"""Grouped aggregation.

Every aggregate here is decomposable (sum, count, min, max), so Spark runs a
partial aggregation before the shuffle: a hot key is folded to one row per map
task before it is exchanged, whatever its share of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.functions.arithmetic import complement, percent_of, proportion_of
from kpiframe.functions.nulls import count_if, sum_na
from kpiframe.functions.util import as_list, to_col


def group_agg(df: DataFrame, by, aggs: dict) -> DataFrame:
    """Many aggregates in one pass: ``{name: aggregate Column}``."""
    return df.groupBy(*as_list(by)).agg(*[c.alias(n) for n, c in aggs.items()])


def sum_by(df: DataFrame, by, cols, names: dict | None = None) -> DataFrame:
    """Grouped sums that ignore missing values; an all-missing group sums to 0."""
    names = names or {}
    return group_agg(df, by, {names.get(c, c): sum_na(c) for c in as_list(cols)})


def count_by(df: DataFrame, by, name: str = "n") -> DataFrame:
    """Rows per group (``n()``)."""
    return group_agg(df, by, {name: F.count(F.lit(1))})


def count_if_by(df: DataFrame, by, conds: dict) -> DataFrame:
    """Conditional counts per group: ``{name: condition}``."""
    return group_agg(df, by, {n: count_if(c) for n, c in conds.items()})


def with_total(df: DataFrame, by, aggs: dict, label: str = "Total",
               label_col: str | None = None, flag: str | None = None) -> DataFrame:
    """Group rows plus one grand-total row, in a single pass.

    ``GROUPING SETS ((by...), ())``: each input row is expanded twice (once per
    level, whatever the number of keys) and both levels are aggregated
    together, partial + final. The total row carries ``label`` in
    ``label_col`` (default: the first key; returned as a string whatever its
    type) and NULL in the other keys; ``grouping_id`` separates it from a real
    group whose key is NULL or reads like the label, and ``flag`` names a
    boolean column that says so.
    """
    by = as_list(by)
    label_col = label_col or by[0]
    g = df.groupingSets([by, []], *by).agg(*[c.alias(n) for n, c in aggs.items()],
                                           F.grouping_id().alias("_gid"))
    total = F.col("_gid") != F.lit(0)
    g = g.withColumn(label_col, F.when(total, F.lit(label))
                     .otherwise(F.col(label_col).cast("string")))
    if flag:
        g = g.withColumn(flag, total)
    return g.drop("_gid")


def with_total_sum(df: DataFrame, by, aggs: dict, label: str = "Total",
                   label_col: str | None = None) -> DataFrame:
    """``with_total`` for aggregates that add up (sums, counts): the total row is
    the sum of the group rows, so input rows are not expanded. Both levels read
    the same aggregate; Spark reuses its exchange, so the input is read once.
    """
    by = as_list(by)
    label_col = label_col or by[0]
    g = group_agg(df, by, aggs)
    types = {f.name: f.dataType for f in g.schema.fields}
    total = g.agg(*[F.sum(F.col(n)).cast(types[n]).alias(n) for n in aggs])
    keys = [F.lit(label).alias(k) if k == label_col else F.lit(None).cast(types[k]).alias(k)
            for k in by]
    g = g.withColumn(label_col, F.col(label_col).cast("string"))
    return g.unionByName(total.select(*keys, *aggs))


def ratio_of_sums(df: DataFrame, by, num: str, den: str, name: str = "ratio",
                  digits: int | None = 2, kind: str = "proportion",
                  num_name: str | None = None, den_name: str | None = None) -> DataFrame:
    """Sum numerator and denominator per group, then their (rounded) ratio.

    ``kind`` is ``"proportion"`` (n/d) or ``"percent"`` (n/d*100). A zero
    denominator gives NULL.
    """
    num_name, den_name = num_name or num, den_name or den
    g = group_agg(df, by, {num_name: sum_na(num), den_name: sum_na(den)})
    fn = proportion_of if kind == "proportion" else percent_of
    return g.withColumn(name, fn(num_name, den_name, digits))


def share_without(df: DataFrame, by, flags: dict, n_name: str = "n",
                  count_fmt: str = "n_{}", pct_fmt: str = "percent_{}",
                  not_fmt: str = "percent_not_{}", digits: int = 2) -> DataFrame:
    """Share of group members *without* each condition.

    For every ``{name: condition}``: the count of members with it, the percent
    with it (``round(k / n * 100, digits)``) and ``100 -`` that percent.
    """
    aggs = {n_name: F.count(F.lit(1))}
    for k, cond in flags.items():
        aggs[count_fmt.format(k)] = count_if(cond)
    g = group_agg(df, by, aggs)
    derived = {}
    for k in flags:
        pct = percent_of(F.col(count_fmt.format(k)), F.col(n_name), digits)
        derived[pct_fmt.format(k)] = pct
        derived[not_fmt.format(k)] = complement(pct)
    return g.withColumns(derived)


def histogram(df: DataFrame, c, bins: int, name: str = "count",
              span: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width histogram with ``bins`` bins, empty bins included.

    Bin rule of the reference plots: width = (max - min) / (bins - 1), first
    edge = min - width / 2, bins closed on the right; a single bin spans
    [min, max]. A constant column gets a width of 0.1. Missing and non-finite
    values are left out. Min and max are ``span`` where it is given (as
    ``sources.parquet_range`` reads it from file footers: then the data are scanned
    once), else one scalar subquery (one extra scan, a one-row result), so nothing is
    collected and no cross join is needed;
    the bin number is then a plain projection and the count a partial +
    final aggregation over at most ``bins`` keys.
    """
    if bins < 1:
        raise ValueError("histogram: bins must be >= 1")
    x = to_col(c).cast("double")
    # NaN and infinities have no bin
    vals = df.select(x.alias("_x")).filter(F.abs(F.col("_x")) < F.lit(float("inf")))
    if span is None:
        rng = vals.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("r")).scalar()
        lo, hi = rng["lo"], rng["hi"]
    else:
        lo, hi = (F.lit(float(v)) for v in span)
    if bins == 1:
        # one bin spanning [min, max]
        width = F.when(hi == lo, F.lit(0.1)).otherwise(hi - lo)
        edge0 = F.when(hi == lo, lo - F.lit(0.05)).otherwise(lo)
    else:
        width = F.when(hi == lo, F.lit(0.1)).otherwise((hi - lo) / F.lit(float(bins - 1)))
        edge0 = lo - width / F.lit(2.0)
    bin_no = F.greatest(F.lit(1), F.least(F.lit(bins),
                                          F.ceil((F.col("_x") - edge0) / width).cast("long")))
    counts = vals.select(bin_no.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias(name))
    spark = df.sparkSession
    all_bins = spark.range(1, bins + 1).select(F.col("id").alias("bin"))
    all_bins = all_bins.select(
        "bin",
        (edge0 + (F.col("bin") - F.lit(1)) * width).alias("lower"),
        (edge0 + F.col("bin") * width).alias("upper"))
    return (all_bins.join(counts, "bin", "left")
            .select("bin", "lower", "upper", F.coalesce(F.col(name), F.lit(0)).alias(name)))
