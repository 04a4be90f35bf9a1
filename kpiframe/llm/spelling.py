"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

A single inserted, deleted or replaced code point leaves two words with a common prefix and a
common suffix that together reach the longer length less one, and nothing else does. Tiles of
words are laid out as padded code-point matrices, and a pair of tiles is compared whole,
column by column, for the lengths of both.

Either the prefix or the suffix holds half of that, so only tiles of words that share their
first half, or their last, meet (pairs found by the prefix are not counted again by the
suffix). A group of more than ``TILE`` words is cut into tiles by hash, and each pair of its
tiles is a row of its own, so that no task holds a group. A task returns one row per word and
pair of tiles, not the pairs of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import ascii_lower, stored

MIN_CHARS = 5
MIN_COUNT = 3
#: the form of a word is at least this many times as frequent
MORE = 2
#: words of a group in one tile, about
TILE = 1024
#: letters of a word; all are below U+0100, so that a word is one byte per code point
LETTERS = "a-zA-Z\\u00C0-\\u00FF"


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                slip: int | None = None) -> DataFrame:
    """(word, n): maximal runs of ``LETTERS`` in whole texts, A-Z lower-cased, of at least
    ``min_chars`` code points and ``min_count`` occurrences over all texts.

    With ``slip``, a run whose CRC-32 of ``<doc_id>:<run>`` is h loses its code point
    h mod length wherever ``slip`` divides h (made-up misspellings to test against; a NULL
    doc_id is written as nothing). NULL and empty texts have no words; rows that share a
    doc_id all count.
    """
    run = F.regexp_extract_all(ascii_lower(F.col("text").cast("string")),
                               F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
                        F.explode(run).alias("word"))
    if slip:
        words = words.withColumn("h", F.crc32(F.concat_ws(":", "d", "word").cast("binary")))
        without = F.overlay(F.col("word"), F.lit(""),
                            (F.col("h") % F.length("word") + 1).cast("int"), F.lit(1))
        words = words.withColumn("word", F.when(F.col("h") % slip == 0, without)
                                 .otherwise(F.col("word")))
    return (words.filter(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


def _halves(words: DataFrame) -> DataFrame:
    """Each word once per group it belongs to: (side, m, half, word, n). ``m`` is the longer
    length of the pairs that the group is for; its members have m or m - 1 code points and
    share ``half``, their first (side 0) or last (side 1) m // 2."""
    size = F.length("word")
    both = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    half = F.expr("m div 2").cast("int")
    return both.select(
        "word", "n", "m", F.inline(F.array(
            F.struct(F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), half).alias("half")),
            F.struct(F.lit(1).alias("side"), F.substring(F.col("word"), -half, half).alias("half")))))


def _tiles(words: DataFrame, tile: int) -> DataFrame:
    """One row per pair of tiles: (side, m, i, j, members), i <= j; a member has the number
    of its tile, its word as Latin-1 bytes and its count."""
    halves = stored(_halves(words), "word-halves")
    group = ["side", "m", "half"]
    # a pair needs two words, one of them of the longer length
    sizes = (halves.groupBy(*group).agg(F.count(F.lit(1)).alias("size"),
                                        F.max(F.length("word")).alias("longest"))
             .filter("size > 1 and longest = m")
             .select(*[F.col(c).alias(f"g_{c}") for c in group],
                     F.ceil(F.col("size") / tile).cast("int").alias("tiles")))
    sizes = stored(sizes, "half-sizes")
    same = (F.col("side") == F.col("g_side")) & (F.col("m") == F.col("g_m")) \
        & (F.col("half") == F.col("g_half"))
    mine = F.pmod(F.xxhash64("word"), "tiles").cast("int")
    member = F.struct(F.col("k").alias("tile"), F.encode("word", "ISO-8859-1").alias("word"),
                      F.col("n").alias("n"))
    return (halves.join(sizes, same).withColumn("k", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .groupBy(*group, F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"))
            .agg(F.collect_list(member).alias("members"))
            .filter(F.size("members") > 1).select("side", "m", "i", "j", "members"))


def _columns(words: list[bytes], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points by column, short words padded at the end, and padded at the beginning."""
    def laid(padded: Iterator[bytes]) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, m).T)
    return laid(w.ljust(m, b"\0") for w in words), laid(w.rjust(m, b"\0") for w in words)


def compare(a: list[bytes], b: list[bytes], m: int, by_suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (into a, into b) of the pairs one edit apart. All words have ``m`` or m - 1
    bytes and share their first (last, if ``by_suffix``) m // 2; pairs of two words of m - 1
    bytes are left to the group of their own length. By suffix, pairs that share the first
    half as well are left to that side's group."""
    half = m // 2
    kind = np.uint8 if m < 128 else np.int32
    (left_a, right_a), (left_b, right_b) = _columns(a, m), _columns(b, m)

    def common(rows, cols, columns, start) -> np.ndarray:
        """Length of the equal run over ``columns``, ``start`` known to be equal."""
        alive = np.ones((len(a), len(b)), kind)
        length = np.full((len(a), len(b)), start, kind)
        for c in columns:
            alive &= rows[c][:, None] == cols[c][None, :]
            if not alive.any():
                break
            length += alive
        return length

    prefix = common(left_a, left_b, range(0 if by_suffix else half, m), 0 if by_suffix else half)
    suffix = common(right_a, right_b, range(m - 1 - (half if by_suffix else 0), -1, -1),
                    half if by_suffix else 0)
    size_a = np.fromiter(map(len, a), np.int64, len(a))
    size_b = np.fromiter(map(len, b), np.int64, len(b))
    # padding equals padding only in two short words, and those are not compared here
    near = (prefix + suffix >= m - 1) & ((size_a == m)[:, None] | (size_b == m)[None, :])
    if by_suffix:
        near &= prefix < half
    return np.nonzero(near)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row (pair of tiles) and word: how many near words, and the best of them."""
    for batch in batches:
        words: list[bytes] = []
        counts: list[np.ndarray] = []
        own, other = [], []
        lists = batch.column("members")
        flat = lists.flatten()
        ends = lists.offsets.to_numpy()
        ends = (ends - ends[0]).tolist()
        tiles = flat.field("tile").to_numpy()
        for r, (side, m, i, j) in enumerate(zip(*(batch.column(c).to_pylist()
                                                  for c in ("side", "m", "i", "j")))):
            of_tile = tiles[ends[r]:ends[r + 1]]
            here = flat.field("word").slice(ends[r], ends[r + 1] - ends[r]).to_pylist()
            n = flat.field("n").slice(ends[r], ends[r + 1] - ends[r]).to_numpy()
            first = np.flatnonzero(of_tile == i)
            second = first if i == j else np.flatnonzero(of_tile == j)
            if not len(first) or not len(second):
                continue
            x, y = compare([here[k] for k in first.tolist()], [here[k] for k in second.tolist()],
                           m, bool(side))
            x, y = first[x], second[y]
            if i == j:  # every pair stands twice, and each word with itself
                x, y = x[x != y], y[x != y]
            else:
                x, y = np.concatenate([x, y]), np.concatenate([y, x])
            own.append(x + len(words))
            other.append(y + len(words))
            words += here
            counts.append(n)
        if not own:
            continue
        a, b, n = np.concatenate(own), np.concatenate(other), np.concatenate(counts)
        names = np.array(words, object)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(len(words))
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        word, at, near = np.unique(a, return_index=True, return_counts=True)
        best = b[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[word].tolist(), pa.binary()), pa.array(near.astype(np.int64)),
             pa.array(n[best]), pa.array(names[best].tolist(), pa.binary())],
            ["w", "near", "best_n", "best"])


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``words`` (word, n; every word once) with n_near, the number of words exactly one
    edit apart, and near_n and near_word, the most frequent of them (ties: the smallest in
    code-point order; NULL without any). Words hold code points below U+0100 only."""
    links = _tiles(words, tile).mapInArrow(
        _links, "w binary, near long, best_n long, best binary")
    text = lambda c: F.decode(c, "ISO-8859-1")
    best = (links.groupBy("w").agg(
        F.sum("near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("n"), text("best").alias("word"))).alias("best"))
        .select(text("w").alias("w"), "n_near", "best"))
    return words.join(best, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near_word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``form`` from ``word`` ends, the word itself if it has no
    form. Forms must lead to no circle; each round doubles how far every word has come."""
    far = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "word-roots")
    while True:
        step = far.select(F.col("word").alias("w"), F.col("root").alias("next"))
        step = step.filter("w <> next")
        moved = far.join(step, F.col("root") == F.col("w"), "left")
        moved = stored(moved.select("word", F.coalesce("next", "root").alias("root"),
                                    F.col("next").isNotNull().alias("moved")), "word-roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        far = moved.drop("moved")


def spelling_variants(words: DataFrame, more: int = MORE, tile: int = TILE) -> DataFrame:
    """Groups of spelling variants over (word, n) rows: word, form, root, n, n_near, form_n.

    ``form`` is the most frequent near word (ties: the smallest) if it is at least ``more``
    (2 or more) times as frequent, else NULL; ``root`` is where forms lead to in the end.
    A table without words gives no rows.
    """
    words = stored(words, "word-counts")
    near = near_words(words, tile)
    real = F.col("near_n") >= F.lit(more) * F.col("n")
    forms = stored(near.select("word", F.when(real, F.col("near_word")).alias("form"), "n", "n_near",
                               F.when(real, F.col("near_n")).alias("form_n")), "word-forms")
    ends = roots(forms).withColumnRenamed("word", "r_word")
    return forms.join(ends, F.col("word") == F.col("r_word")) \
        .select("word", "form", "root", "n", "n_near", "form_n")
