"""Benchmark decontamination: which documents hold a passage within a small edit distance of
a benchmark item.

Item-sized windows of words and the items are embedded by the CGK random walk (Chakraborty,
Goldenberg, Koucky 2016): a walk repeats each symbol or moves on, by shared random bits, so
that few edits become few Hamming differences. Bit-sampling LSH over the embeddings,
repeated with fresh walks, proposes (window, item) pairs; the exact edit distance decides.

Windows start where the text holds, word by word, one of the pieces that an item is cut
into: with at most d edits one of d + 1 pieces is left whole, so no window within the
distance is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: least edit similarity 1 - distance / words of the item
SIMILARITY = 0.8
#: walks, and embedding positions sampled for each: the LSH's recall is 1 - (1 - p ** BITS) **
#: WALKS for a share p of equal positions
WALKS = 40
BITS = 2
#: words of benchmark items one pass over the documents compares with (the broadcast's bound)
WORDS_PER_PASS = 1_000_000
#: words of documents embedded together
WORDS_PER_BLOCK = 400_000
#: windows embedded together
WINDOWS_PER_BLOCK = 1024
SEED = 20_240_601

_PARTS = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation; NULL has none."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PARTS).split()


def window_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance between the item and any window of the text, end of the first
    such window): the usual table with free ends in the text, a row at a time."""
    n = len(text)
    steps = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, symbol in enumerate(item.tolist(), 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (text != symbol), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def _piece_keys(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` symbols at each position."""
    key = np.zeros(max(0, len(ids) - length + 1), np.uint64)
    for j in range(length):
        key = (key ^ (ids[j:j + len(key)].astype(np.uint64) + np.uint64(1))) * _BASE
        key ^= key >> np.uint64(29)
    return key


def _random(*shape: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2 ** 63, shape, dtype=np.uint64) * 2 + 1


def walk_keys(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LSH keys of symbol rows, one per walk and row. Row i holds ``sizes[i]`` symbols.

    Step by step every walk writes the symbol it stands on to its embedding and then moves on
    or not, by a random bit of (walk, step, symbol); past the end it writes 0. A walk's key is
    made of the embedding's symbols at its sampled steps (shares of twice the size).
    """
    n, width = rows.shape
    factors = _random(WALKS, 2 * width + 1)
    share = np.random.default_rng(SEED + 1).random((BITS, WALKS, 1))
    sampled = (share * (2 * sizes)).astype(np.int64)
    at = np.zeros((WALKS, n), np.int64)
    keys = np.broadcast_to(sizes.astype(np.uint64) * _BASE, (WALKS, n)).copy()
    padded = np.concatenate([rows, np.zeros((n, 1), rows.dtype)], axis=1).astype(np.uint64)
    every = np.arange(n)
    for step in range(int(sampled.max(initial=-1)) + 1):
        symbol = padded[every, np.minimum(at, sizes)]
        for bit in range(BITS):
            mixed = (keys ^ symbol) * _BASE
            keys = np.where(sampled[bit] == step, mixed ^ (mixed >> np.uint64(31)), keys)
        at += (((symbol + np.uint64(1)) * factors[:, step:step + 1]) >> np.uint64(63)).astype(np.int64)
    return keys


@dataclass
class Matcher:
    """Items prepared for one pass. Symbol 0 stands for every word that no item has."""

    items: list[tuple[int | None, list[bytes]]]
    symbols: dict[bytes, int] = field(init=False)

    def __post_init__(self):
        self.symbols = {}
        for _, ws in self.items:
            for w in ws:
                self.symbols.setdefault(w, len(self.symbols) + 1)
        self.rows = [np.array([self.symbols[w] for w in ws], np.int64) for _, ws in self.items]
        self.radius = [int(len(r) * (1 - SIMILARITY) + 1e-9) for r in self.rows]
        pieces: dict[int, dict[int, set[tuple[int, int]]]] = {}
        self.sizes: dict[int, list[int]] = {}
        for i, (row, d) in enumerate(zip(self.rows, self.radius)):
            if not len(row):
                continue
            self.sizes.setdefault(len(row), []).append(i)
            cuts = [len(row) * k // (d + 1) for k in range(d + 2)]
            for a, b in zip(cuts, cuts[1:]):
                key = int(_piece_keys(row[a:b], b - a)[0])
                pieces.setdefault(b - a, {}).setdefault(key, set()).add((len(row), a))
        self.pieces = {n: (np.array(sorted(p), np.uint64), [sorted(p[k]) for k in sorted(p)])
                       for n, p in pieces.items()}
        self.width = max(self.sizes, default=1)
        self.by_key: list[dict[int, list[int]]] = [{} for _ in range(WALKS)]
        used = [i for i, row in enumerate(self.rows) if len(row)]
        for a in range(0, len(used), WINDOWS_PER_BLOCK):
            some = used[a:a + WINDOWS_PER_BLOCK]
            sizes = np.array([len(self.rows[i]) for i in some])
            rows = np.zeros((len(some), self.width), np.int64)
            for k, i in enumerate(some):
                rows[k, :sizes[k]] = self.rows[i]
            for table, keys in zip(self.by_key, walk_keys(rows, sizes)):
                for key, i in zip(keys.tolist(), some):
                    table.setdefault(key, []).append(i)
        self.known = [np.fromiter(t, np.uint64, len(t)) for t in self.by_key]

    def windows(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of the windows to embed, by size."""
        out: dict[int, set[int]] = {}
        for length, (keys, where) in self.pieces.items():
            found = _piece_keys(ids, length)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            for p in np.flatnonzero(keys[at] == found).tolist():
                for size, offset in where[at[p]]:
                    out.setdefault(size, set()).add(p - offset)
        return {size: np.array(sorted(starts)) for size, starts in out.items()}

    def match(self, texts: list[list[bytes]]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, end word) of each text and item within the
        radius, at its nearest window."""
        get = self.symbols.get
        lengths = [len(ws) for ws in texts]
        # texts one after the other, with foreign words before, between and after them, so that
        # a window may begin before its text or end after it, and matches no words of another
        gap = self.width * 2
        starts = np.cumsum([gap] + [n + gap for n in lengths])
        ids = np.zeros(int(starts[-1]) + gap, np.int64)
        for a, ws in zip(starts.tolist(), texts):
            ids[a:a + len(ws)] = np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws))
        wanted = self.windows(ids)
        sizes = np.repeat(list(wanted), [len(at) for at in wanted.values()])
        at = np.concatenate([*wanted.values(), np.zeros(0, np.int64)]).astype(np.int64)
        pairs: set[tuple[int, int]] = set()
        for k in range(0, len(at), WINDOWS_PER_BLOCK):
            size, start = sizes[k:k + WINDOWS_PER_BLOCK], at[k:k + WINDOWS_PER_BLOCK]
            column = np.arange(self.width)
            rows = ids[np.minimum(start[:, None] + column, len(ids) - 1)] * (column < size[:, None])
            for table, known, keys in zip(self.by_key, self.known, walk_keys(rows, size)):
                for p in np.flatnonzero(np.isin(keys, known)).tolist():
                    pairs.update((int(start[p]), i) for i in table[int(keys[p])])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for start, i in sorted(pairs):
            row, d = self.rows[i], self.radius[i]
            text = max(0, int(np.searchsorted(starts, start + len(row) // 2, "right")) - 1)
            a = int(starts[text])
            low, high = max(a, start - 2 * d), min(a + lengths[text], start + len(row) + 2 * d)
            if high <= low:
                continue
            distance, end = window_distance(row, ids[low:high])
            if distance <= d:
                back, begin = window_distance(row[::-1], ids[low:low + end][::-1])
                new = (distance, low + end - begin - a, low + end - a)
                if (text, i) not in best or new < best[text, i]:
                    best[text, i] = new
        return [(text, i, *found) for (text, i), found in sorted(best.items())]


def _blocks(column) -> Iterator[list[list[bytes]]]:
    """The texts' words, in runs of about WORDS_PER_BLOCK words."""
    run, size = [], 0
    for text in column:
        ws = words(text.as_py())
        run.append(ws)
        size += len(ws)
        if size >= WORDS_PER_BLOCK:
            yield run
            run, size = [], 0
    if run:
        yield run


def _passes(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks of at most ``limit`` words (or one item); the driver holds one
    block at a time. Items without words match nothing and are left out."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item, text in rows.toLocalIterator():
        ws = words(text)
        if block and size + len(ws) > limit:
            yield block
            block, size = [], 0
        if ws:
            block.append((item, ws))
            size += len(ws)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame,
                 words_per_pass: int = WORDS_PER_PASS) -> DataFrame:
    """One row per document row and benchmark item that it holds: doc_id, item_id, n_words (of
    the item), distance (words to insert, delete or replace), similarity (1 - distance /
    n_words, 0.8 or more), first_word and end_word of the nearest window (the first, on a
    tie), among the document's words.

    Words are lower-cased and free of ASCII punctuation. Windows do not cross documents. A
    NULL or empty text holds nothing, a NULL or empty item is in nothing; items with equal
    texts are reported each. The benchmark is a query set: it is compared with all documents
    in passes of at most ``words_per_pass`` words, each broadcast.
    """
    spark = docs.sparkSession
    kind = ("doc_id long, item_id long, n_words long, distance long, similarity double, "
            "first_word long, end_word long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], kind)
    for items in _passes(benchmark, words_per_pass):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            matcher = Matcher(sent.value)
            for batch in batches:
                ids, at, found = batch.column("doc_id").to_pylist(), 0, []
                for texts in _blocks(batch.column("text")):
                    for text, i, distance, a, b in matcher.match(texts):
                        item, ws = matcher.items[i]
                        found.append((ids[at + text], item, len(ws), distance,
                                      1 - distance / len(ws), a, b))
                    at += len(texts)
                columns = list(zip(*found)) if found else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.float64() if k == 4 else pa.int64())
                     for k, c in enumerate(columns)],
                    ["doc_id", "item_id", "n_words", "distance", "similarity", "first_word",
                     "end_word"])

        out = out.unionAll(rows.mapInArrow(run, kind))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame,
                      words_per_pass: int = WORDS_PER_PASS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay as they are.
    NULL and empty texts hold nothing and stay; repeated rows are judged alike."""
    out = docs
    for items in _passes(benchmark, words_per_pass):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            matcher = Matcher(sent.value)
            for batch in batches:
                keep, at = np.ones(batch.num_rows, bool), 0
                for texts in _blocks(batch.column("text")):
                    for text, *_ in matcher.match(texts):
                        keep[at + text] = False
                    at += len(texts)
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
