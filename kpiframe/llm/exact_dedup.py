"""Exact dedup by progressive refinement, in DataFrame functions only.

Texts are compared without white space. Rows are grouped by the length of that text, the
groups of two or more by a hash of its beginning, and what is still together by the SHA-256
of the whole. Only rows that came through the first two levels have their whole text hashed,
and no level shuffles texts: rows of lengths and hashes travel.

Which rows came through is told to the scan that hashes by a table of ``SLOTS`` slots at
most, to which (length, hash) is folded, so that what is broadcast has a fixed bound. A row
that shares a slot by chance is hashed for nothing and found to be alone; the result does not
depend on the slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.llm.common import squeezed, stored

#: code points of the squeezed text that the second level hashes
PREFIX = 64
#: most rows of the broadcast table (one long each)
SLOTS = 1 << 20


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("n_bytes", "head"), F.lit(slots))


def _levels(docs: DataFrame, prefix: int) -> DataFrame:
    """``docs`` (with a column ``s``, the squeezed text) with the keys of two levels."""
    return (docs.withColumn("n_bytes", F.octet_length("s"))
            .withColumn("head", F.xxhash64(F.substring("s", 1, prefix))))


def repeated_slots(docs: DataFrame, prefix: int = PREFIX, slots: int = SLOTS) -> DataFrame:
    """The slots of the (length, beginning) pairs that two rows or more share."""
    keys = stored(_levels(docs.select(squeezed(_text()).alias("s")), prefix)
                  .select("n_bytes", "head"), "text-keys")
    by_length = (keys.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                 .select(F.col("n_bytes").alias("l")))
    # written, so that the rows of a length that very many texts have can be split over tasks
    by_length = stored(by_length, "repeated-lengths")
    by_head = (keys.join(by_length, F.col("n_bytes") == F.col("l"), "left_semi")
               .groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return stored(by_head.select(_slot(slots).alias("slot")).distinct(), "repeated-slots")


def _hashed(docs: DataFrame, keep: list[Column], digest_all: bool, prefix: int,
            slots: int) -> DataFrame:
    """``keep`` of each row, ``again`` (it came through two levels) and ``sha``, the digest
    of its whole squeezed text (NULL for the others unless ``digest_all``)."""
    found = F.broadcast(repeated_slots(docs, prefix, slots))  # at most ``slots`` longs
    rows = _levels(docs.select(*keep, squeezed(_text()).alias("s")), prefix)
    rows = rows.withColumn("at", _slot(slots)).join(found, F.col("at") == F.col("slot"), "left")
    again = F.col("slot").isNotNull()
    return rows.withColumn("again", again).withColumn(
        "sha", F.when(F.lit(True) if digest_all else again, F.unhex(F.sha2("s", 256)))) \
        .drop("s", "n_bytes", "head", "at", "slot")


def _first(*ties: str) -> Column:
    """Order of the rows of a group: most code points, then the smallest doc_id (NULL last)."""
    return F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"),
                    F.col("doc_id").alias("c"), *ties)


def exact_groups(docs: DataFrame, digest_all: bool = False, prefix: int = PREFIX,
                 slots: int = SLOTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and sha.

    Rows are equal if their texts are, after every ``[\\x20\\x09-\\x0D]`` is deleted; NULL
    counts as empty, so NULL, empty and blank texts are one group. The row with the most code
    points (of the text as given) stays, then the smallest doc_id; a NULL doc_id comes last.
    Of rows that agree in both exactly one stays. ``keep_id`` is the doc_id of the row that
    stays. ``sha`` is the SHA-256 of the squeezed text, in full if ``digest_all``, else NULL
    for rows that are alone by length or beginning.
    """
    keep = [F.col("doc_id").cast("long").alias("doc_id"),
            F.length(_text()).cast("long").alias("n_chars")]
    # numbers of rows are fixed once the rows are written
    rows = stored(_hashed(docs, keep, digest_all, prefix, slots)
                  .withColumn("uid", F.monotonically_increasing_id()), "text-digests")
    again, alone = rows.filter("again"), rows.filter("not again")
    groups = (again.groupBy("sha")
              .agg(F.count(F.lit(1)).alias("n"),
                   F.min_by(F.struct("doc_id", "uid"), _first("uid")).alias("best"))
              .filter("n > 1").select(F.col("sha").alias("g_sha"), "n", "best"))
    # written: its side of the join is shuffled anew, so that the rows of a large group split
    joined = again.join(stored(groups, "text-groups"), F.col("sha") == F.col("g_sha"), "left")
    single = F.col("n").isNull()
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("uid") == F.col("best.uid"))).alias("kept"), "sha") \
        .unionAll(alone.select("doc_id", F.col("doc_id").alias("keep_id"),
                               F.lit(1).cast("long").alias("group_size"),
                               F.lit(True).alias("kept"), "sha"))


def drop_copies(docs: DataFrame, prefix: int = PREFIX, slots: int = SLOTS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are.

    The rows that stay are those of ``exact_groups``. Of rows with the same doc_id and text
    that differ in other columns, one stays.
    """
    keep = [F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
            F.length(_text()).cast("long").alias("n_chars"), F.xxhash64("text").alias("th")]
    rows = _hashed(docs, keep, False, prefix, slots)
    again = rows.filter("again")
    best = (again.drop("row").groupBy("sha", "doc_id", "n_chars", "th")
            .agg(F.count(F.lit(1)).alias("same"))
            .groupBy("sha").agg(F.min_by(F.struct("doc_id", "th", "same"), _first("th")).alias("b")))
    best = stored(best.select(F.col("b.doc_id").alias("k_id"), F.col("b.th").alias("k_th"),
                              "b.same", F.col("sha").alias("k_sha")), "texts-kept")
    kept = again.join(best, (F.col("sha") == F.col("k_sha")) & (F.col("th") == F.col("k_th"))
                      & F.col("doc_id").eqNullSafe(F.col("k_id")))
    ties = Window.partitionBy("sha").orderBy(F.xxhash64("row"))
    return (rows.filter("not again").select("row.*")
            .unionAll(kept.filter("same = 1").select("row.*"))
            .unionAll(kept.filter("same > 1").withColumn("nth", F.row_number().over(ties))
                      .filter("nth = 1").select("row.*")))


def exact_report(docs: DataFrame, prefix: int = PREFIX, slots: int = SLOTS) -> DataFrame:
    """``exact_groups`` with the digest of every row as lowercase hex (``text_sha256``)."""
    out = exact_groups(docs, True, prefix, slots)
    return out.select("doc_id", "keep_id", "group_size", "kept",
                      F.lower(F.hex("sha")).alias("text_sha256"))
