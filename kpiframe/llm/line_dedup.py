"""Line dedup across documents, in DataFrame functions only.

Lines are hashed, range-partitioned by (hash, document) with a secondary sort by position,
and each sorted partition is streamed for the first occurrence of a key. What comes back is
one compressed bitmap of kept lines per document, not its text.

A key in very many documents spreads over as many range partitions as it fills, because the
document is part of the range; only one partial (count, first document) row per key and
partition is shuffled to decide it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.llm.common import WHITE, ascii_lower, stored

MIN_CHARS = 40
MIN_DOCS = 5


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _identity(docs: DataFrame) -> DataFrame:
    """(rd, th, text): ``rd`` is the bitwise complement of doc_id, so that ascending order
    puts the largest doc_id first; ``th`` tells rows apart that share a doc_id."""
    return docs.select(F.bitwise_not(F.col("doc_id").cast("long")).alias("rd"),
                       F.xxhash64(_text()).alias("th"), _text().alias("text"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the lines to keep, for the documents that lose any line.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
    lower-cased. Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents keep their lines in the largest doc_id only.

    Returns (rd, th, keep): ``rd`` = ~doc_id, ``th`` = xxhash64 of the text, ``keep`` an
    array of (word, bits) for each 64-line word in which a line goes; bit i of word w is
    line 64 w + i, a word that is absent is all ones. Documents without a row keep all.

    NULL or empty text is one empty line. Rows with the same doc_id count as one document
    (a line may stay in each of them). A NULL doc_id is one document, smaller than any
    other. Keys are compared by two 64-bit hashes.
    """
    lines = _identity(docs).select("rd", "th", F.posexplode(F.split("text", "\n", -1)))
    key = F.btrim(F.col("col"), F.lit(WHITE))
    lines = (lines.select("rd", "th", "pos", key.alias("key"))
             .filter(F.length("key") >= min_chars)
             .withColumn("key", ascii_lower(F.col("key")))
             .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                     "rd", "th", "pos"))
    # hashes only: the text is split once, although the range partitioner samples its input
    lines = stored(lines, "line-hashes")

    ranged = (lines.repartitionByRange("h1", "h2", "rd")
              .sortWithinPartitions("h1", "h2", "rd", "pos"))
    stream = Window.partitionBy("h1", "h2", "rd").orderBy("pos")
    firsts = ranged.withColumn("n", F.row_number().over(stream)).filter("n = 1")
    repeated = (firsts.groupBy("h1", "h2")
                .agg(F.count(F.lit(1)).alias("n_docs"), F.min("rd").alias("first_rd"))
                .filter(F.col("n_docs") >= min_docs).drop("n_docs"))
    # as a written table its side of the join is shuffled anew, so that Spark can split the
    # rows of a hot key over tasks
    drops = (lines.join(stored(repeated, "repeated-lines"), ["h1", "h2"])
             .filter(~F.col("rd").eqNullSafe(F.col("first_rd"))))
    words = (drops.groupBy("rd", "th", F.shiftright("pos", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("gone")))
    return words.groupBy("rd", "th").agg(F.array_sort(F.collect_list(
        F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows (row, n_lines, n_dropped, kept): ``row`` the whole input row as a struct,
    ``kept`` the text with the lines that the bitmaps keep, joined by a line feed."""
    rows = docs.select(F.struct(*docs.columns).alias("row"),
                       F.bitwise_not(F.col("doc_id").cast("long")).alias("l_rd"),
                       F.xxhash64(_text()).alias("l_th"), _text().alias("text"))
    joined = rows.join(bitmaps, F.col("l_rd").eqNullSafe(F.col("rd"))
                       & (F.col("l_th") == F.col("th")), "left")
    lines = F.split("text", "\n", -1)
    joined = joined.withColumn("n_lines", (F.length("text") - F.length(
        F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long"))
    # every word of a document that loses lines, so that a line finds its bit by index
    dense = F.expr("transform(sequence(0L, (n_lines - 1) div 64), "
                   "w -> coalesce(map_from_entries(keep)[cast(w as int)], -1L))")
    joined = joined.withColumn("dense", F.when(F.col("keep").isNotNull(), dense))
    kept_lines = F.filter(lines, lambda line, i: (
        F.get(F.col("dense"), F.shiftright(i, 6)).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)))) != 0))
    joined = joined.withColumn("kept_lines", F.when(F.col("keep").isNotNull(), kept_lines))
    return joined.select(
        "row", "n_lines",
        F.coalesce(F.col("n_lines") - F.size("kept_lines"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text"))
        .otherwise(F.array_join("kept_lines", "\n")).alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines removed from ``text`` (and ``n_chars`` refreshed, if it
    is a column). Documents stay, also when every line went."""
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")),
           "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long"))
           .otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c)
                        for c in docs.columns])


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """Per input row: doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    docs = docs.select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
