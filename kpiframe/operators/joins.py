"""Joins.

* ``left_join_nullsafe``: equi-join where a missing key matches a missing key
  (``<=>``). Catalyst still extracts the keys as equi-join keys, so the join
  is planned as a hash/sort-merge join (broadcast only when AQE measures a
  side under ``spark.sql.autoBroadcastJoinThreshold``), never a nested loop.
* ``lookup_by_pattern``: first-match-wins regex look-up, expressed as one CASE
  expression over a fixed rule list. No join at all.
* ``lookup_by_rules``: the same over a rule table of any size, by an index of the text
  that a match must hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.functions.text import lookup_by_pattern as _lookup_expr
from kpiframe.functions.util import as_list
from kpiframe.session import scratch_path
from kpiframe.sources.files import write_bucketed

RULES_PER_BLOCK = 1000
#: rows of one key in one bucket, about
HOT_ROWS = 100_000
#: letters of the pieces that rules are filed under
GRAM = 3


def left_join_nullsafe(left: DataFrame, right: DataFrame, keys, how: str = "left",
                       present=()) -> DataFrame:
    """Join on ``keys`` with NULL-matches-NULL; one copy of the keys is kept (the
    left one; the right one for a right join; either for a full join),
    followed by the other columns of both sides.

    Keys named in ``present`` are never NULL and are compared plainly: Spark then
    shuffles and sorts on the key alone, not on the key and its NULL flag. NULL
    matching NULL pairs every row whose keys are all missing with every such row
    of the other side, as the dashboards' joins do.
    """
    keys = as_list(keys)
    present = set(as_list(present) or ())
    lt, rt = left.alias("_l"), right.alias("_r")
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"_l.{k}") == F.col(f"_r.{k}") if k in present
                   else F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    joined = lt.join(rt, cond, how)
    kind = how.lower().replace("_", "")
    if kind in ("full", "outer", "fullouter"):
        # matched rows carry equal keys (NULL included); unmatched ones only one side's
        key_cols = [F.coalesce(F.col(f"_l.{k}"), F.col(f"_r.{k}")).alias(k) for k in keys]
    else:
        side = "_r" if kind in ("right", "rightouter") else "_l"
        key_cols = [F.col(f"{side}.{k}").alias(k) for k in keys]
    lrest = [F.col(f"_l.{c}").alias(c) for c in left.columns if c not in keys]
    rrest = [F.col(f"_r.{c}").alias(c) for c in right.columns if c not in keys]
    return joined.select(*key_cols, *lrest, *rrest)


def null_safe_key(keys) -> Column:
    """One string that is equal for two rows just if all ``keys`` are (a missing value equals
    a missing value): each value with its length before it. Keys need a string form that
    tells their values apart (strings, dates, whole numbers)."""
    def part(k):
        text = F.col(k).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.concat(*[part(k) for k in as_list(keys)])


def bucketed_pair(rows: DataFrame, keys, side: str, left, right, buckets: int | None = None,
                  hot: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, str]:
    """The rows of two sides of one table, laid out so that they join without an exchange.

    ``rows`` holds both sides, told apart by the column ``side`` (values ``left`` and
    ``right``). It is written once, bucketed and sorted by the null-safe form of ``keys``
    (a job that runs when this function is called), and both sides come back as filters of
    that table, with the name of the column to join on.

    A key with more than ``hot`` rows on the left is salted: its left rows are dealt to as
    many salts as it has multiples of ``hot``, and its right rows stand under each of them,
    so that no bucket holds a hot key whole. The hot keys, at most 1 / ``hot`` of the rows,
    are found by a map-side combined count.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_key", null_safe_key(keys))
    is_left = F.col(side) == F.lit(left)
    many = (keyed.filter(is_left).groupBy(F.col("_key").alias("_hot"))
            .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot)
            .withColumn("_salts", F.ceil(F.col("_n") / hot).cast("int")).drop("_n"))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    mine = F.array(F.pmod(F.xxhash64(*rows.columns), salts).cast("int"))
    every = F.sequence(F.lit(0), salts - 1)
    dealt = (keyed.join(many, F.col("_key") == F.col("_hot"), "left")
             .withColumn("_salt", F.explode(F.when(is_left, mine).otherwise(every)))
             .withColumn("_key", F.when(F.col("_salts").isNull(), F.col("_key"))
                         .otherwise(F.concat("_key", F.lit("#"), F.col("_salt").cast("string")))))
    table = write_bucketed(dealt.select(*rows.columns, "_key"), "_key", buckets,
                           scratch_path(spark, "bucketed"))
    return (table.filter(is_left).drop(side), table.filter(F.col(side) == F.lit(right)).drop(side),
            "_key")


def inner_join_nullsafe(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Left join followed by "keep matched rows" is an inner join."""
    return left_join_nullsafe(left, right, keys, how="inner")


def _literal_runs(pattern: Column) -> Column:
    """Strings that any match of a regex holds; an empty array where that is not plain.

    Only patterns of literal characters, ``.``, ``^``, ``$`` and ``+`` are taken apart: with
    alternatives, groups, classes, escapes or optional parts, a character need not be there.
    """
    plain = ~pattern.rlike(r"[|()\[\]{}?*\\]")
    return F.when(plain, F.split(pattern, r"[.^$+]")).otherwise(F.array().cast("array<string>"))


def _grams(text: Column) -> Column:
    """The distinct substrings of ``GRAM`` characters."""
    last = F.length(text) - (GRAM - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(GRAM))))) \
        .otherwise(F.array().cast("array<string>"))


def lookup_by_rules(df: DataFrame, c: str, rules: DataFrame, out: str, pattern: str = "pattern",
                    value: str = "target", priority: str = "priority") -> DataFrame:
    """Add ``out`` = value of the lowest-priority rule of a table whose regex matches
    ``c``; NULL when none does (or ``c`` is missing). The rule table may have any size.

    Only the distinct names are tried, and a name meets only rules that can match it: each
    rule is filed under the rarest ``GRAM``-letter piece of the literal text that its matches
    must hold, and a name looks under its own pieces, an equi-join. The regex then decides.
    Rules without such a piece (alternatives, classes, short literals) are kept aside, and
    every name meets them. Rules that share a piece, and those kept aside, are packed into
    blocks of about ``RULES_PER_BLOCK`` by hash. The least match by (priority, pattern) is
    kept by a map-side combined ``min`` and joined back on the name.
    """
    rule = F.struct(F.col(priority).alias("priority"), F.col(pattern).alias("pattern"),
                    F.col(value).alias("value"))
    filed = rules.filter(F.col(pattern).isNotNull()).select(
        rule.alias("rule"), F.array_distinct(F.flatten(F.transform(
            _literal_runs(F.col(pattern)), _grams))).alias("grams"))
    pieces = filed.select("rule", F.explode("grams").alias("gram"))
    common = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (pieces.join(common, "gram").groupBy("rule")
              .agg(F.min(F.struct("n", "gram")).alias("best"))
              .select("rule", F.col("best.gram").alias("gram")))
    # the empty piece stands for "any name"
    aside = filed.filter(F.size("grams") == 0).select("rule", F.lit("").alias("gram"))
    keyed = rarest.unionByName(aside)
    blocks_of = keyed.groupBy("gram").agg(
        F.ceil(F.count(F.lit(1)) / RULES_PER_BLOCK).cast("int").alias("blocks"))
    blocks = (keyed.join(blocks_of, "gram")
              .groupBy("gram", F.pmod(F.xxhash64("rule"), "blocks").alias("block"))
              .agg(F.collect_list("rule").alias("rules")))

    names = df.select(F.col(c).alias("_name")).filter(F.col("_name").isNotNull()).distinct()
    tried = names.select("_name", F.explode(F.concat(
        F.array(F.lit("")), _grams(F.col("_name")))).alias("gram"))
    matches = F.filter("rules", lambda r: F.regexp_like(F.col("_name"), r["pattern"]))
    found = tried.join(blocks, "gram").select("_name", F.array_min(matches).alias("rule"))
    best = found.filter(F.col("rule").isNotNull()).groupBy("_name").agg(F.min("rule").alias("rule"))
    best = best.select("_name", F.col("rule.value").alias(out))
    return df.join(best, F.col(c) == F.col("_name"), "left").select(*df.columns, out)


def lookup_by_pattern(df: DataFrame, c: str, rules, out: str, default=None) -> DataFrame:
    """Add ``out`` = value of the first ``(pattern, value)`` rule whose regex matches
    ``c``; NULL (or ``default``) when none does."""
    return df.withColumn(out, _lookup_expr(c, rules, default))
