"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight and a schedule: how its share rises or falls over training time
(0 to 1). The schedule is integrated to the source's cumulative token demand; a document
that stands at token offset ``c`` in its source is trained on when that demand reaches
``c``, so its position is the inverse of the demand at ``c``. Documents are then
range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.llm.common import WORD, fresh, stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: (time, relative rate) knots per weight slot: the first fades out, the last fades in
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))

def _pieces(knots) -> list[tuple[float, float, float, float, float, float]]:
    """(u0, u1, t0, t1, r0, r1): the share of the demand met before and after each linear
    piece of a schedule, its times, and its rates when the whole integral is 1."""
    area = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:]))
    if area <= 0:
        raise ValueError("a schedule needs a positive integral")
    out, u = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        if t1 <= t0 or r0 < 0 or r1 < 0:
            raise ValueError("schedule times must rise and rates must not be negative")
        step = (t1 - t0) * (r0 + r1) / 2 / area
        if step > 0:
            out.append((u, u + step, t0, t1, r0 / area, r1 / area))
        u += step
    return out


def _invert(share: Column, knots) -> Column:
    """The time at which the demand's share is met: the root of the piece's quadratic."""
    out = F.lit(None).cast("double")
    for u0, _, t0, t1, r0, r1 in reversed(_pieces(knots)):
        d = share - F.lit(u0)
        slope = (r1 - r0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(r0 * r0) + F.lit(2.0 * slope) * d))
        time = F.lit(t0) + F.when(d <= 0, F.lit(0.0)).otherwise(
            F.lit(2.0) * d / (F.lit(r0) + root))
        out = F.when(share >= u0, time).otherwise(out)
    return out


def _times(knots) -> Column:
    return F.transform("shares", lambda share: _invert(share, knots))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(src, source_size, slot, target) from (src, size).

    Sources are ordered by code point, NULL last, and take ``weights`` in turn. They share
    the sum of all sizes by weight; a target stops at ``max_epochs`` times its source's
    size and the excess is reshared by weight among the others until none is above. In
    order of cap / weight the capped sources come first, so one pass over the table of
    sources (one row each) finds the level at which the rest share. If every size is 0, all
    targets are 0.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "i")
    everything = Window.partitionBy()
    table = (sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
             .withColumn("i", F.row_number().over(by_name) - 1)
             .withColumn("slot", F.col("i") % n)
             .withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                           F.col("slot") + 1))
             .withColumn("cap", F.col("source_size").cast("double") * float(max_epochs))
             .withColumn("total", F.sum("source_size").over(everything).cast("double"))
             .withColumn("capped_before", F.coalesce(F.sum("cap").over(
                 by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             .withColumn("w_rest", F.sum("w").over(
                 by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
             .withColumn("rank", F.row_number().over(by_ratio))
             .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("w_rest"))
             .withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
             .withColumn("level", F.min_by("level", F.when(F.col("free"), F.col("rank")))
                         .over(everything)))
    target = F.when(F.col("free"), F.col("level") * F.col("w")).otherwise(F.col("cap"))
    return table.select("src", "source_size", "slot", target.alias("target"))


def _sizes(docs: DataFrame) -> DataFrame:
    """One small row per document: no text goes through the shuffles that follow."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("src"),
        size.cast("long").alias("size"), F.xxhash64("text").alias("th"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES,
             max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """What the mix takes of each row of ``docs`` and when training reaches it.

    Returns one row per input row: doc_id, th (xxhash64 of the text), size (words of the
    text, NULL: 0), src, source_size, target (of the source, in words), taken (words,
    repeats counted: whole passes over the source, then the documents that the rest of the
    target reaches, the last of them in part) and positions: the training times (0 to 1)
    of the document's copies, in order; empty where nothing is taken.

    A source's documents stand in the order of the MD5 of doc_id, ties by doc_id, size and
    text, so reruns agree; rows alike in all of these are interchangeable. The running
    token count is made per (source, range of MD5) and shifted by the ranges before, so a
    source of any size is spread over tasks. There are as many ranges as a range has rows, so
    both grow with the square root of the rows.
    NULL sources are one source, the last. Empty input gives an empty plan.
    """
    if len(schedules) != len(weights):
        raise ValueError("one schedule per weight")
    sizes = stored(_sizes(docs), "mix-sizes")
    n_ranges = max(1, math.isqrt(sizes.count()))
    targets = source_targets(sizes, weights, max_epochs)
    part = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / float(16 ** 13)
    sizes = sizes.withColumn("part", F.floor(part * n_ranges).cast("long"))

    of_part = sizes.groupBy("src", "part").agg(F.sum("size").alias("part_size"))
    shift = of_part.select(F.col("src").alias("p_src"), F.col("part").alias("p_part"), (F.sum(
        "part_size").over(Window.partitionBy("src").orderBy("part")) - F.col("part_size"))
        .alias("shift"))
    run = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size", "th") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs_at = sizes.withColumn("run", F.sum("size").over(run) - F.col("size"))
    docs_at = docs_at.join(shift, F.col("src").eqNullSafe(F.col("p_src"))
                           & (F.col("part") == F.col("p_part")))
    targets = targets.withColumnRenamed("src", "t_src")
    docs_at = docs_at.join(targets, F.col("src").eqNullSafe(F.col("t_src")))

    start = F.col("run") + F.col("shift")
    demand = F.floor(F.col("target") + 0.5).cast("long")
    out = (docs_at.withColumn("start", start).withColumn("demand", demand)
           .withColumn("passes", F.expr("if(source_size > 0, demand div source_size, 0L)"))
           .withColumn("rest", F.greatest(F.lit(0), F.least("size", F.expr(
               "demand - passes * source_size - start")))))
    out = out.withColumn("taken", F.col("passes") * F.col("size") + F.col("rest"))
    copies = F.expr("sequence(0L, passes - if(rest > 0, 0L, 1L))")
    shares = F.when((F.col("size") == 0) | (F.col("taken") == 0),
                    F.array().cast("array<double>")).otherwise(F.transform(
                        copies, lambda k: (k * F.col("source_size") + F.col("start")).cast("double")
                        / F.col("demand").cast("double")))
    out = out.withColumn("shares", shares)
    times = F.lit(None).cast("array<double>")
    for slot, knots in enumerate(schedules):
        times = F.when(F.col("slot") == slot, _times(knots)).otherwise(times)
    return out.select("doc_id", "th", "size", "src", "source_size", "target", "taken",
                      "passes", times.alias("positions"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """``mix_plan`` as one row per document in training order: doc_id, size, source_size,
    target, taken and position (time of the first copy; NULL if nothing is taken)."""
    plan = mix_plan(docs.select("doc_id", "text", "source"), **options)
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.round(
        F.get("positions", F.lit(0)), 9).alias("position")).orderBy("position", "doc_id")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: one row per copy of a document that is taken, range-sorted by position.

    Columns of ``docs`` plus copy (0, 1, ...), words (how many words of this copy count;
    fewer than the document's only in the last document of a source) and position. Added
    names that ``docs`` already has get a trailing underscore. Rows that agree in doc_id,
    text and source share one plan row and appear as often as they do in ``docs``.
    """
    names = [fresh(docs.columns, x) for x in ("copy", "words", "position")]
    at = Window.partitionBy("r_id", "r_th", "r_src").orderBy("r_id")
    rows = docs.select(F.struct(*docs.columns).alias("row"),
                       F.col("doc_id").cast("long").alias("r_id"), F.xxhash64("text").alias("r_th"),
                       F.col("source").cast("string").alias("r_src"))
    rows = rows.withColumn("nth", F.row_number().over(at))
    same = Window.partitionBy("doc_id", "th", "src").orderBy("taken", "positions")
    plan = mix_plan(docs.select("doc_id", "text", "source"), **options) \
        .withColumn("p_nth", F.row_number().over(same)).filter("taken > 0")
    joined = rows.join(plan, F.col("r_id").eqNullSafe(F.col("doc_id"))
                       & (F.col("r_th") == F.col("th")) & F.col("r_src").eqNullSafe(F.col("src"))
                       & (F.col("nth") == F.col("p_nth")))
    out = joined.select("row", "size", "taken", "passes", F.posexplode("positions").alias("k", "at"))
    words = F.when(F.col("k") < F.col("passes"), F.col("size")) \
        .otherwise(F.col("taken") - F.col("passes") * F.col("size"))
    return out.select("row.*", F.col("k").alias(names[0]), words.alias(names[1]),
                      F.col("at").alias(names[2])).orderBy(names[2])
