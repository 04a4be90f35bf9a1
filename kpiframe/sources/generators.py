"""Generated tables: entity × period panels and seeded random samples.

Both are row-local expressions over an input DataFrame (``explode`` of a
date sequence; hashes of a key), so they scale with the input and need no
join, no shuffle and no driver-side loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.functions.arithmetic import round_even
from kpiframe.functions.util import as_list


def _as_date(x) -> Column:
    return x if isinstance(x, Column) else F.to_date(F.lit(str(x)))


def panel_grid(entities: DataFrame, start, end, months: int = 1,
               period_col: str = "period") -> DataFrame:
    """Every entity row × every period from ``start`` to ``end`` (inclusive).

    ``start``/``end`` are dates, ISO strings or Columns (e.g. a scalar
    subquery over the data). Each entity row generates its own periods with
    ``explode(sequence(...))``, so the product is formed without a join.
    """
    seq = F.sequence(_as_date(start), _as_date(end), F.expr(f"INTERVAL {int(months)} MONTH"))
    return entities.select("*", F.explode(seq).alias(period_col))


_HEX_DIGITS = 13


def uniform(seed: int, stream: int | Column, keys) -> Column:
    """A uniform number in (0, 1) from the MD5 of ``keys`` (52 bits of it): the same
    key gives the same number on any partitioning or retry, and in any engine."""
    numbered = stream.cast("string") if isinstance(stream, Column) else F.lit(str(int(stream)))
    text = F.concat_ws("|", F.lit(str(int(seed))), numbered,
                       *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in as_list(keys)])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX_DIGITS), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(16 ** _HEX_DIGITS))


#: greatest rate that is drawn in one piece; the thresholds of a piece are one array
MAX_LAM = 200.0


def poisson_thresholds(lam: float) -> list[float]:
    """``P(X <= k)`` for k = 0, 1, ... until what is left is below double precision;
    ``lam`` is at most 200 (``exp(-lam)`` must not vanish)."""
    if not 0 <= lam <= MAX_LAM:
        raise ValueError(f"poisson: lam must be in [0, {MAX_LAM:g}]")
    k, p = 0, math.exp(-lam)
    out, cdf = [], 0.0
    while k <= lam or p > 1e-18:
        cdf += p
        out.append(cdf)
        k += 1
        p *= lam / k
    return out


def poisson_pieces(lam: float) -> tuple[int, float]:
    """(n, rate): a Poisson number of rate ``lam`` is the sum of n independent ones of a
    rate that can be drawn in one piece."""
    if not 0 <= lam < math.inf:
        raise ValueError("poisson: lam must be a finite number, 0 or more")
    n = max(1, math.ceil(lam / MAX_LAM))
    return n, lam / n


def poisson_from_uniform(u: Column, lam: float) -> Column:
    """Inverse-CDF Poisson draw: the first ``k`` with ``P(X <= k) >= u``, from
    thresholds that are built from ``lam`` (not stored)."""
    thresholds = poisson_thresholds(lam)
    expr = F.when(u <= F.lit(thresholds[0]), F.lit(0))
    for k, cdf in enumerate(thresholds[1:], 1):
        expr = expr.when(u <= F.lit(cdf), F.lit(k))
    return expr.otherwise(F.lit(len(thresholds)))


def poisson(seed: int, stream: int, keys, lam: float) -> Column:
    """A Poisson draw of any rate per key (bigint). A rate over ``MAX_LAM`` is split into
    equal pieces; piece i draws from the uniform stream ``stream + i`` and the draws add
    up, so the result is exact, and the same on any partitioning. The expression has one
    piece's thresholds whatever the rate; the work of a row is in proportion to ``lam``."""
    pieces, rate = poisson_pieces(lam)
    if pieces == 1:
        return poisson_from_uniform(uniform(seed, stream, keys), rate).cast("long")
    steps = poisson_thresholds(rate)
    count = len(steps)

    def draw(total, i):
        u = uniform(seed, i, keys)
        # binary search: how many thresholds lie below u
        low = F.lit(0)
        return total + F.aggregate(
            F.array(*[F.lit(1 << b) for b in reversed(range(count.bit_length()))]),
            F.struct(low.alias("low"), u.alias("u")),
            lambda at, step: F.struct(
                F.when((at["low"] + step <= count)
                       & (F.try_element_at(F.lit(steps), at["low"] + step) < at["u"]),
                       at["low"] + step).otherwise(at["low"]).alias("low"), at["u"].alias("u")),
            lambda at: at["low"]).cast("long")

    streams = F.sequence(F.lit(stream), F.lit(stream + pieces - 1))
    return F.aggregate(streams, F.lit(0).cast("long"), draw)


def demo_sample(df: DataFrame, keys, seed: int = 123, lam: float = 5.0,
                digits: int = 6) -> DataFrame:
    """One sample row per input row: ``x, y ~ Normal(0, 1)`` (Box-Muller, rounded to
    ``digits``) and ``z ~ Poisson(lam)`` for any ``lam``, seeded by ``seed`` and the row's
    key columns."""
    keys = as_list(keys)
    u1, u2 = uniform(seed, 1, keys), uniform(seed, 2, keys)
    r = F.sqrt(F.lit(-2.0) * F.log(u1))
    theta = F.lit(2.0 * math.pi) * u2
    return df.select(*keys,
                     round_even(r * F.cos(theta), digits).alias("x"),
                     round_even(r * F.sin(theta), digits).alias("y"),
                     poisson(seed, 3, keys, lam).cast(
                         "int" if lam <= MAX_LAM else "long").alias("z"))
