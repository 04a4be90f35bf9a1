"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

Only suffixes that can share ``LENGTH`` bytes with another one are sorted, one bucket at a
time:

* Cover. Of the K-byte strings that start in a LENGTH-byte window the one with the least hash
  (the last, on a tie) is the window's anchor. Equal windows have equal anchors at equal
  offsets, so the suffixes of a bucket, those around equal anchor strings, stand aligned, and
  the difference cover that any two of them need shrinks to one residue class: the columns
  0, V, 2 V, ... of the text around the anchor.
* Buckets. Anchors whose string occurs once are dropped. Anchors with equal surroundings as
  far as a window reaches are one class, counted with map-side partial sums; a class of two or
  more is settled. One member of each class goes to its bucket.
* Blocks. A task reads its buckets in order and sorts them block by block. Ranks of the cover
  columns' V-byte strings, doubled to LENGTH - V bytes, are made first. Suffixes whose
  cover ranks are tied are then told apart by the less than V bytes before and after, sorted
  once per cover column; the longest common prefixes of neighbours give the ties at every
  depth.

Memory is bounded by the block. A bucket of more than ``HOT`` distinct surroundings is not
sorted in one task: its windows are told apart by 128-bit digests, counted by Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import stored, text_bytes

LENGTH = 400
K = 64
V = 50
#: bytes before and after an anchor's start that a window with it can hold
LEFT, RIGHT = LENGTH - K, LENGTH
WIDTH = LEFT + RIGHT
#: rows that a task sorts together, and distinct surroundings of one anchor that it sorts at most
BLOCK_ROWS = 16_384
HOT = 32_768
#: bytes whose anchors are looked for at once
PIECE = 1 << 19

_LOW = np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(400)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64, at least ``n`` of them."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        one = np.ones(1, np.uint64)
        _powers[size] = tuple(np.cumprod(np.concatenate([one, np.full(size - 1, b, np.uint64)]))
                              for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers[size]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each K-byte string: differences of prefix sums, scaled alike."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * down[:len(data)], out=sums[1:])
    n = len(data) - K + 1
    h = (sums[K:] - sums[:n]) * up[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of every LENGTH-byte window of a text."""
    data = np.frombuffer(text, np.uint8)
    w = LENGTH - K + 1
    found, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        h = _gram_hashes(data[at:at + PIECE + LENGTH - 1])
        n = len(h) - w + 1
        # the low bits make the later of equals the lesser
        key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        blocks = -(-len(key) // w)
        grid = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        grid[:len(key)] = key
        grid = grid.reshape(blocks, w)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[:n], left[w - 1:w - 1 + n])
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        where = np.unique((_LOW - (least & _LOW)).astype(np.int64))
        found.append(where + at)
        hashes.append(h[where])
    where, first = np.unique(np.concatenate(found), return_index=True)
    return where, np.concatenate(hashes)[first]


def _around(text: bytes, at: int) -> bytes:
    """What a window with the anchor can hold, and where the anchor stands in it."""
    return min(at, LEFT).to_bytes(4, "little") + text[max(0, at - LEFT):at + RIGHT]


def anchor_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at, h, d): every anchor with the hashes of its string and surroundings."""
    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                some = batch.slice(part, 1000)
                counts, ats, hs, ds = [], [], [], []
                for text in some.column("text"):
                    text = text.as_py()
                    where, h = anchors(text)
                    counts.append(len(where))
                    ats.append(where)
                    hs.append(h)
                    ds += [xxhash.xxh3_64_intdigest(_around(text, p)) for p in where.tolist()]
                row = pa.array(np.repeat(np.arange(some.num_rows), counts))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(row), some.column("th").take(row),
                     pa.array(np.concatenate([np.zeros(0, np.int64), *ats])),
                     pa.array(np.concatenate([np.zeros(0, np.uint64), *hs]).view(np.int64)),
                     pa.array(np.array(ds, np.uint64).view(np.int64))],
                    ["doc_id", "th", "at", "h", "d"])

    return _identity(docs).mapInArrow(run, "doc_id long, th long, at long, h long, d long")


def _identity(docs: DataFrame) -> DataFrame:
    """Rows alike in doc_id and text hash count as copies of each other, as any texts do."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                       text_bytes().alias("text"))


def _same_row(left: str, right: str):
    return F.col(f"{left}_id").eqNullSafe(F.col(f"{right}_id")) & (
        F.col(f"{left}_th") == F.col(f"{right}_th"))


# --- one block of buckets ---------------------------------------------------------------

def _rank(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of the rows of equal-length columns."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _strings(rows: np.ndarray) -> np.ndarray:
    """Byte rows as sortable strings; equal lengths, so trailing zeros make no difference."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _rank_strings(rows: np.ndarray) -> np.ndarray:
    return np.unique(_strings(rows), return_inverse=True)[1].reshape(-1)


def _depth_classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the sorted order of the rows and each one's common prefix with the row
    before. ``cumsum(lcp < depth)`` numbers the classes of rows alike in ``depth`` bytes."""
    order = np.argsort(_strings(rows), kind="stable")
    s = rows[order]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.concatenate([[0], lcp])


def _class_at(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth) if depth else 0
    return out


def sort_block(bucket: np.ndarray, rows: np.ndarray, left: np.ndarray,
               right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) window columns of each row that equal the same columns of another row of
    its bucket; first is WIDTH and last -1 if there is none.

    ``rows`` are the texts around the anchors (WIDTH columns, the anchor at LEFT, zeros
    outside the document), of which ``left`` and ``right`` bytes are the document's.
    """
    n = len(rows)
    first, last = np.full(n, WIDTH), np.full(n, -1)
    padded = np.concatenate([rows, np.zeros((n, V), np.uint8)], axis=1)
    # ranks of the cover sample, doubled: V, 2 V, 4 V bytes, then two of those overlapping
    ranks = {c: _rank_strings(padded[:, c:c + V]) for c in range(0, WIDTH - V + 1, V)}
    for k in (1, 2):
        ranks = {c: _rank([r, ranks[c + k * V]]) for c, r in ranks.items() if c + k * V in ranks}
    rest = LENGTH - V - 4 * V
    bucket_rank = _rank([bucket])
    for c in range(0, LEFT + V, V):
        if c + rest not in ranks:
            continue
        tie = _rank([bucket_rank, ranks[c], ranks[c + rest]])
        some = np.flatnonzero(np.bincount(tie)[tie] > 1)
        if not len(some):
            continue
        tie = _rank([tie[some]])
        before = padded[some, max(0, c - V):c][:, ::-1]
        after = padded[some, c + LENGTH - V:c + LENGTH]
        lefts = _depth_classes(before) if c else (np.arange(len(some)), np.zeros(len(some)))
        rights = _depth_classes(after)
        for back in range(min(V, c + 1)):
            x = c - back
            if x > LEFT:
                continue
            inside = (x >= LEFT - left[some]) & (x + LENGTH <= LEFT + right[some])
            # tie, the bytes before the cover column and those after its rank
            alike = _rank([tie, _class_at(*lefts, back), _class_at(*rights, V - back)])[inside]
            twice = some[inside][np.bincount(alike, minlength=1)[alike] > 1]
            first[twice] = np.minimum(first[twice], x)
            last[twice] = np.maximum(last[twice], x)
    return first, last


def _sort_buckets(batches):
    """Blocks of whole buckets out of batches that are sorted by h."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= BLOCK_ROWS:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            h = whole.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield whole.slice(0, cut)
            waiting = whole.slice(cut).combine_chunks().to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _covered(batches):
    for block in _sort_buckets(batches):
        rows = np.zeros((block.num_rows, WIDTH), np.uint8)
        left = block.column("left").to_numpy()
        texts = block.column("around").to_pylist()
        for i, (text, a) in enumerate(zip(texts, left.tolist())):
            rows[i, LEFT - a:LEFT - a + len(text)] = np.frombuffer(text, np.uint8)
        right = np.array([len(t) for t in texts]) - left
        first, last = sort_block(block.column("h").to_numpy(), rows, left, right)
        some = np.flatnonzero((last >= 0) & (block.column("n").to_numpy() == 1))
        at = block.column("at").to_numpy()[some]
        keep = block.take(pa.array(some))
        yield from pa.table({"s_id": keep.column("s_id"), "s_th": keep.column("s_th"),
                             "start": at - LEFT + first[some],
                             "end": at - LEFT + last[some] + LENGTH}).to_batches()


def _windows(batches):
    """A digest per window of the anchors of hot buckets."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            text, left, at = (row.column(c)[0].as_py() for c in ("around", "left", "at"))
            starts = range(max(0, left - LEFT), min(left, len(text) - LENGTH) + 1)
            if not len(starts):
                continue
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[p:p + LENGTH]) for p in starts),
                              np.int64).reshape(-1, 2)
            same = pa.array(np.zeros(len(starts), np.int64))
            yield pa.RecordBatch.from_arrays(
                [row.column("s_id").take(same), row.column("s_th").take(same),
                 pa.array(np.array(starts) + at - left), pa.array(h[:, 0].copy()),
                 pa.array(h[:, 1].copy())], ["s_id", "s_th", "start", "g1", "g2"])


# --- the job ----------------------------------------------------------------------------

def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(s_id, s_th, spans): per document (doc_id, text hash) the intervals (start, end) of bytes
    that a repeated LENGTH-byte string covers; they may overlap."""
    every = stored(anchor_table(docs), "anchors")
    shared = stored(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                    .select("h"), "shared-anchors")
    live = stored(every.join(shared, "h"), "live-anchors")
    classes = live.groupBy("h", "d").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "at")).alias("one"))
    classes = stored(classes, "anchor-classes")
    # alike as far as a window reaches: all of it is repeated
    settled = live.join(classes.filter("n > 1").select("h", "d"), ["h", "d"]).select(
        F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"),
        (F.col("at") - LEFT).alias("start"), (F.col("at") + RIGHT).alias("end"))

    buckets = (classes.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
               .filter("m > 1 and least = 1").select("h", "m"))
    chosen = classes.join(buckets, "h").select("h", "m", "n", "one.*")
    places = chosen.groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).agg(
        F.collect_set(F.struct("at", "h", "m", "n")).alias("places"))
    rows = _identity(docs).select(F.col("doc_id").alias("t_id"), F.col("th").alias("t_th"), "text")
    # copies of a row would bring its anchors twice; their classes are settled
    texts = rows.join(places, _same_row("t", "s"))

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text = row.column("text")[0].as_py()
                found = row.column("places")[0].as_py()
                same = pa.array(np.zeros(len(found), np.int64))
                arounds = [_around(text, p["at"])[4:] for p in found]
                yield pa.RecordBatch.from_arrays(
                    [row.column("s_id").take(same), row.column("s_th").take(same),
                     *(pa.array([p[c] for p in found], pa.int64()) for c in ("at", "h", "m", "n")),
                     pa.array([min(p["at"], LEFT) for p in found], pa.int64()),
                     pa.array(arounds, pa.binary())],
                    ["s_id", "s_th", "at", "h", "m", "n", "left", "around"])

    around = stored(texts.mapInArrow(
        cut, "s_id long, s_th long, at long, h long, m long, n long, left long, around binary"),
        "anchor-surroundings").dropDuplicates(["s_id", "s_th", "at"])
    span = "s_id long, s_th long, start long, end long"
    sorted_ = (around.filter(F.col("m") <= hot).repartition("h").sortWithinPartitions("h")
               .mapInArrow(_covered, span))
    windows = around.filter(F.col("m") > hot)
    spans = settled.unionAll(sorted_)
    if not windows.isEmpty():
        windows = stored(windows.mapInArrow(
            _windows, "s_id long, s_th long, start long, g1 long, g2 long"), "hot-windows")
        # a window may hold several hot anchors and come once for each
        place = F.struct("s_id", "s_th", "start")
        twice = windows.groupBy("g1", "g2").agg(F.min(place).alias("a"), F.max(place).alias("b")) \
            .filter(~F.col("a").eqNullSafe(F.col("b"))).select("g1", "g2")
        spans = spans.unionAll(windows.join(stored(twice, "hot-repeats"), ["g1", "g2"])
                               .select("s_id", "s_th", "start", (F.col("start") + LENGTH).alias("end")))
    return spans.groupBy("s_id", "s_th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The maximal runs that overlapping or adjoining spans cover, within the text."""
    out: list[list[int]] = []
    for start, end in sorted((max(0, a), min(size, b)) for a, b in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        elif end > start:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _kept(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    runs = merged([(s["start"], s["end"]) for s in spans or []], len(text))
    ends = [0, *(b for _, b in runs)]
    starts = [*(a for a, _ in runs), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts)), runs


def suffix_report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 (of the bytes that stay).

    Texts are UTF-8 bytes (NULL: empty). A byte goes if a 400-byte string covers it that also
    starts anywhere else, in any row, overlapping or not; all copies go. Strings do not cross
    documents; a text under 400 bytes stays. Repeated rows are copies of each other; NULL
    doc_ids are ids like any other.
    """
    spans = repeated_spans(docs, hot)
    rows = _identity(docs).select(F.col("doc_id").alias("t_id"), F.col("th").alias("t_th"), "text")
    joined = rows.join(spans, _same_row("t", "s"), "left").select("t_id", "text", "spans")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column("spans")):
                text = text.as_py()
                kept, runs = _kept(text, found.as_py())
                out.append((len(text), len(text) - len(kept), len(runs),
                            hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            types = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("t_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, kind)


def dedup_suffixes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` without the repeated bytes in ``text`` (NULL stays NULL). A cut inside a
    character drops the bytes of that character that are left."""
    names = docs.columns
    spans = repeated_spans(docs, hot)
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("t_id"),
                       F.xxhash64("text").alias("t_th"))
    joined = rows.join(spans, _same_row("t", "s"), "left").select("row", "spans")

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            texts = [None if t is None else
                     _kept(t.encode("utf-8", "replace"), s.as_py())[0].decode("utf-8", "ignore")
                     for t, s in zip(row.field("text").to_pylist(), batch.column("spans"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == "text" else row.field(c) for c in names], names)

    return joined.mapInArrow(run, docs.schema)
