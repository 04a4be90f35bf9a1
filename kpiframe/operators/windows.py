"""Per-group positional operators.

Spark has no row position, so every operator here takes an explicit ordering.

Skew: ``first_per_group`` / ``last_per_group`` / ``last_present`` and
``group_size`` are aggregations (``min``/``max`` of a struct led by the order
key; ``count``), which Spark pre-aggregates map-side, so a group holding a
third of all rows is folded before the shuffle. ``number_within`` needs a real
window; a large group is cut into ranges of its order first. ``stack_offsets`` is
meant for KPI panels, which are unique on (entity, period), so a window partition
holds at most one row per stacked part however skewed the raw data was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.functions.util import as_list
from kpiframe.operators.ranges import default_ranges, with_range
from kpiframe.session import shared_dir


def _need_order(order):
    order = as_list(order)
    if not order:
        raise ValueError("an ordering column is required: Spark rows have no position")
    return order


def number_within(df: DataFrame, by, order, name: str = "survey",
                  chunks: int | None = None, bounded: bool = False) -> DataFrame:
    """Number rows 1, 2, 3 ... within each group in ``order`` (``row_number()``).

    A group may hold any share of the rows: by default the rows are split at
    sampled bounds of (group, order), so that a large group spans tasks and only
    rows equal in the whole order stay together. The range of a row is an expression
    of its own keys (``operators.ranges``): lazy, no checkpoint, and the same in every
    use and retry. Rows equal in the whole order are numbered in any order.

    ``order`` given as Columns (``F.col("x").desc()``) has no such expression: the split
    rows are then checkpointed, a job that runs when this function is called.
    With ``chunks=k`` the split is at quantiles of the first order column;
    ``order`` must then be column names, ascending, the first one
    numeric, date or timestamp. ``bounded=True`` says that every group is small
    (a panel's rows per entity): one plain window.
    """
    order = _need_order(order)
    if bounded:
        w = Window.partitionBy(*as_list(by)).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    if chunks:
        return _number_within_chunked(df, as_list(by), order, name, chunks)
    by = as_list(by)
    if all(isinstance(c, str) and c in df.columns and _orderable(df.schema[c].dataType)
           for c in by + order):
        return _number_within_ranges(df, by, order, name)
    return _number_within_partitions(df, by, order, name)


def _number_within_ranges(df: DataFrame, by: list, order: list, name: str) -> DataFrame:
    """Row numbers inside (group, range), shifted by the rows of the group in the ranges
    before. The sample and the counts read only the key columns."""
    keyed = with_range(df, by + order, default_ranges(df))
    local = keyed.withColumn("_rn", F.row_number().over(
        Window.partitionBy(*by, "_chunk").orderBy(*order)))
    return _shifted(local, keyed, df.columns, by, name)


def _number_within_partitions(df: DataFrame, by: list, order: list, name: str) -> DataFrame:
    """Row numbers inside (group, range partition), shifted by the rows of the group in
    the partitions before. The partition number is part of the checkpoint, so both
    uses of it agree whatever is computed again."""
    shared_dir(df.sparkSession)
    ranged = (df.repartitionByRange(*by, *order).withColumn("_chunk", F.spark_partition_id())
              .checkpoint(eager=True))
    local = ranged.withColumn("_rn", F.row_number().over(
        Window.partitionBy(*by, "_chunk").orderBy(*order)))
    return _shifted(local, ranged, df.columns, by, name)


def _shifted(local: DataFrame, keyed: DataFrame, columns: list, by: list, name: str) -> DataFrame:
    counts = keyed.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_chunk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0))) \
        .drop("_cnt")
    lt, rt = local.alias("_l"), offsets.alias("_r")
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in by + ["_chunk"]])
    return lt.join(rt, cond, "inner").select(
        *[F.col(f"_l.{c}") for c in columns],
        (F.col("_l._rn") + F.col("_r._off")).cast("long").alias(name))


def _order_number(df: DataFrame, c: str):
    t = df.schema[c].dataType.simpleString()
    if t == "date":
        return F.unix_date(F.col(c)).cast("double")
    if t.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("double")


def _number_within_chunked(df: DataFrame, by: list, order: list, name: str,
                           chunks: int) -> DataFrame:
    """Exact row numbers within groups, skew-safe.

    1. ``k - 1`` global quantiles of the first order column (one scalar
       subquery: a partial + final aggregation returning one array).
    2. ``chunk`` = how many quantiles lie below the row's value — monotone in
       the order, equal values share a chunk; a hot group spreads over up to
       ``k`` chunks.
    3. Row number inside (group, chunk): a window partitioned by both keys.
    4. Rows per (group, chunk), and for each chunk the rows of the group's
       earlier chunks (a window over that small table: at most ``k`` rows per
       group), joined back on (group, chunk) — the windowed side is already
       partitioned on those keys.
    """
    if any(not isinstance(o, str) for o in order):
        raise ValueError("number_within(chunks=): order must be ascending column names")
    v = _order_number(df, order[0])
    probs = [i / chunks for i in range(1, chunks)]
    bounds = df.agg(F.percentile_approx(v, probs, 10000).alias("b")).scalar()
    chunk = sum((F.when(v > F.element_at(bounds, i), F.lit(1)).otherwise(F.lit(0))
                 for i in range(1, chunks)), F.lit(0))
    keyed = df.withColumn("_chunk", chunk)
    local = keyed.withColumn("_rn", F.row_number().over(
        Window.partitionBy(*by, "_chunk").orderBy(*order)))
    return _shifted(local, keyed, df.columns, by, name)


def _orderable(dt) -> bool:
    return "map<" not in dt.simpleString()


def _extreme(df: DataFrame, by, order, last: bool) -> DataFrame:
    by, order = as_list(by), _need_order(order)
    rest = [c for c in df.columns if c not in by and c not in order]
    s = F.struct(*[F.col(c) for c in order + rest])
    if all(_orderable(df.schema[c].dataType) for c in order + rest):
        # ties on the order key are broken by the other columns: deterministic
        pick = F.max(s) if last else F.min(s)
    else:
        # maps cannot be compared: pick by the order key alone, which must then be unique
        # within a group (add a tie-breaker to ``order``), or any tied row is picked
        key = F.struct(*[F.col(c) for c in order])
        pick = F.max_by(s, key) if last else F.min_by(s, key)
    g = df.groupBy(*by).agg(pick.alias("_pick"))
    return g.select(*[F.col(c) for c in by],
                    *[F.col(f"_pick.{c}").alias(c) for c in order + rest]).select(*df.columns)


def first_per_group(df: DataFrame, by, order) -> DataFrame:
    """The first row of each group in ``order`` (``row_number() == 1``)."""
    return _extreme(df, by, order, last=False)


def last_per_group(df: DataFrame, by, order) -> DataFrame:
    """The last row of each group in ``order`` (``row_number() == n()``)."""
    return _extreme(df, by, order, last=True)


def last_present(df: DataFrame, by, order, value: str) -> DataFrame:
    """Latest row per group among rows where ``value`` is present."""
    return last_per_group(df.filter(F.col(value).isNotNull()), by, order)


def group_size(df: DataFrame, by, name: str = "n") -> DataFrame:
    """Attach the group's row count to every row (``n()`` inside ``mutate``).

    Counted with a (map-side combined) aggregation and joined back null-safely;
    AQE broadcasts the counts when they are small and splits a skewed key of
    the large side otherwise.
    """
    by = as_list(by)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    lt, rt = df.alias("_l"), counts.alias("_r")
    cond = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in by])
    return lt.join(rt, cond, "inner").select(*[F.col(f"_l.{c}") for c in df.columns],
                                              F.col(f"_r.{name}"))


def stack_offsets(df: DataFrame, by, order, value: str, name: str = "label_pos") -> DataFrame:
    """Middle of each part of a stack: running sum up to the part minus half of it."""
    order = _need_order(order)
    w = (Window.partitionBy(*as_list(by)).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.sum(F.col(value)).over(w) - F.col(value) / F.lit(2.0))


def entity_page(df: DataFrame, key: str, page_size: int = 4, page: int = 1,
                name: str = "panel") -> DataFrame:
    """Rows of the entities on one page of a ``page_size`` facet grid.

    Ranks the *distinct* keys only, takes the first ``page * page_size`` with a
    distributed top-k (``orderBy().limit()``), and joins them back. The joined
    side has at most ``page_size`` rows (a bound set by the caller), so it is
    broadcast explicitly. ``df`` is read twice, so it is checkpointed first (a
    job that runs when this function is called): give the aggregated panel.
    """
    if page < 1 or page_size < 1:
        raise ValueError("entity_page: page and page_size start at 1")
    shared_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    top = df.select(key).distinct().filter(F.col(key).isNotNull()) \
        .orderBy(key).limit(page * page_size)
    ranked = top.withColumn(name, F.row_number().over(Window.orderBy(key)).cast("long") -
                            F.lit((page - 1) * page_size))
    page_keys = ranked.filter(F.col(name) >= 1)
    return df.join(F.broadcast(page_keys), key, "inner")
