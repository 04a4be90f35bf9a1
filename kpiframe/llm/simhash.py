"""SimHash near-dedup by exact comparison within buckets.

Two fingerprints that differ in at most ``radius`` bits agree in one of ``radius`` + 1 runs
of bits at least, however the bits are cut into runs. So every distinct fingerprint is put
into one bucket per run, by its bits there, and only fingerprints of a bucket are compared
(exclusive-or and bit counts over numpy arrays). A bucket that is still large is cut again,
by runs of the bits that are left: between tasks while it has more than ``TILE``
fingerprints, inside a task below that. Where cutting does not lower the work (fingerprints
that are all alike), a bucket is compared whole, in pairs of tiles if it is large.

Compared pairs are not emitted: a task returns a spanning forest of the links it found, at
most one row per fingerprint that it read, which keeps every component.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.llm.common import stored, text_bytes

SHINGLE = 4
RADIUS = 4
SEED = 42
#: distinct fingerprints in one bucket at most, and in one block inside a task
TILE = 16_384
BLOCK = 512
#: buckets of up to so many fingerprints are compared all at once
FEW = 512
#: rows that a task reads, in tiles
TASK = 8
#: shingles hashed before their bits are counted: bounds memory for very long texts
SHINGLE_BATCH = 65_536


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: bit i is set if it is set in over half of the
    shingles' XXH64. A text with fewer words than ``shingle`` has one shingle, the whole
    sequence; a text without words has fingerprint 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[:len(words) - shingle + 1].tolist()
    last = ends[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), SHINGLE_BATCH):
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(first[at:at + SHINGLE_BATCH], last[at:at + SHINGLE_BATCH])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): one row per input row, the text's xxhash64 and its fingerprint as a
    signed long."""
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")],
                           np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64))],
                ["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                       text_bytes().alias("text")) \
        .mapInArrow(run, "doc_id long, th long, fp long")


def _quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row per fingerprint."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def _boxes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest counts (quarters and whole word) of each block of rows."""
    counts = np.column_stack([counts, counts.sum(axis=1, dtype=np.int8)])
    at = np.arange(0, len(counts), BLOCK)
    return np.minimum.reduceat(counts, at).astype(int), np.maximum.reduceat(counts, at).astype(int)


def _can_meet(low_a, high_a, low_b, high_b, radius: int) -> np.ndarray:
    """Which pairs of blocks are not kept apart by their population counts."""
    gap = np.maximum(0, np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None]))
    return (gap[..., :4].sum(axis=2) <= radius) & (gap[..., 4] <= radius)


def _in_count_order(fps: np.ndarray) -> np.ndarray:
    q = _quarters(fps)
    return fps[np.lexsort((fps, q[:, 3], q[:, 2], q[:, 1], q[:, 0], np.bitwise_count(fps)))]


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _runs(bits: int, radius: int) -> list[int]:
    """The bits that are set in ``bits``, cut into ``radius`` + 1 runs. Values that differ in
    at most ``radius`` bits, all of them among these, agree in one run at least."""
    places = [1 << k for k in range(64) if bits >> k & 1]
    cuts = [len(places) * i // (radius + 1) for i in range(radius + 2)]
    return [sum(places[start:stop]) for start, stop in zip(cuts, cuts[1:])]


def linked(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """Links among ``a`` (``b`` None) or between ``a`` and ``b``, within ``radius`` bits, as
    a spanning forest: rows (fingerprint, fingerprint)."""
    if b is None:
        return linked_in(np.zeros(len(a), np.int64), a, radius)
    return _compared(a, b, radius)


def linked_in(buckets: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Links between fingerprints of the same bucket, within ``radius`` bits, as a spanning
    forest: rows (fingerprint, fingerprint)."""
    values, of_row = np.unique(fps, return_inverse=True)
    label = np.arange(len(values))  # the same for values that links join so far
    out: list[np.ndarray] = []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        apart = label[a] != label[b]
        if not apart.any():
            return
        parts, ends = np.unique(label[np.column_stack([a, b])[apart]], return_inverse=True)
        parent, kept = list(range(len(parts))), []
        for u, v in ends.reshape(-1, 2).tolist():
            u, v = _root(parent, u), _root(parent, v)
            if u != v:
                parent[max(u, v)] = min(u, v)
                kept.append((u, v))
        out.append(parts[kept])
        now = np.arange(len(values))
        now[parts] = parts[[_root(parent, k) for k in range(len(parts))]]
        label = now[label]

    def search(keys: np.ndarray, at: np.ndarray) -> None:
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        fps = values[at]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        ends = np.repeat(starts + sizes, sizes)
        first = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
        for step in range(1, FEW):
            first = first[first + step < ends[first]]
            if not len(first):
                break
            near = first[np.bitwise_count(fps[first] ^ fps[first + step]) <= radius]
            join(at[near], at[near + step])
        for start, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            some = fps[start:start + n]
            parts = []
            if n > 2 * BLOCK:
                differing = int(np.bitwise_or.reduce(some ^ some[0]))
                parts = [some & np.uint64(run) for run in _runs(differing, radius)]
                pairs = sum(int((np.unique(k, return_counts=True)[1] ** 2).sum()) for k in parts)
                if 4 * pairs > n * n:  # too much alike: cutting makes no less work
                    parts = []
            for part in parts:
                search(part, at[start:start + n])
            if not parts:
                links = np.searchsorted(values, _compared(some, None, radius))
                join(links[:, 0], links[:, 1])

    if len(fps):
        search(buckets, of_row)
    return values[np.concatenate([np.empty((0, 2), np.int64), *out])]


def _compared(a: np.ndarray, b: np.ndarray | None, radius: int) -> np.ndarray:
    """What ``linked`` returns, by blocks of all pairs."""
    a = _in_count_order(np.unique(a))
    other = a if b is None else _in_count_order(np.unique(b))
    both = a if b is None else np.concatenate([a, other])
    shift = 0 if b is None else len(a)
    la, ha = _boxes(_quarters(a))
    lo, ho = _boxes(_quarters(other))
    parent = list(range(len(both)))
    out: list[tuple[int, int]] = []

    def join(rows: np.ndarray, columns: np.ndarray) -> None:
        for u, v in zip(rows.tolist(), columns.tolist()):
            u, v = _root(parent, u), _root(parent, v)
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((u, v))

    def labels(start: int, stop: int) -> np.ndarray:
        return np.array([_root(parent, k) for k in range(start, stop)])

    for i, j in np.argwhere(_can_meet(la, ha, lo, ho, radius)).tolist():
        if b is None and j < i:
            continue
        x, y = a[i * BLOCK:(i + 1) * BLOCK], other[j * BLOCK:(j + 1) * BLOCK]
        at_x, at_y = i * BLOCK, j * BLOCK + shift
        near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
        while near.any():
            # of the links between parts that are still apart: the first of each row and column
            near &= labels(at_x, at_x + len(x))[:, None] != labels(at_y, at_y + len(y))[None, :]
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            join(rows + at_x, near[rows].argmax(axis=1) + at_y)
            join(near[:, columns].argmax(axis=0) + at_x, columns + at_y)
    return both[np.array(out, np.int64).reshape(-1, 2)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def bucketed(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(bucket, fp) rows of distinct values of ``fp``: any two that differ in at most
    ``radius`` bits are together in a bucket, and no bucket has many more than 2 * ``tile``."""
    def sized(rows: DataFrame, *by: str) -> DataFrame:
        return stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "simhash-sizes")

    key = F.col("fp").bitwiseAND(F.col("mask"))
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask")).withColumn("key", key)
    sizes = sized(rows, "mask", "key")
    out = []
    while masks := [r.mask for r in sizes.filter(F.col("n") > tile)
                    .select("mask").distinct().collect()]:
        # what is broadcast here has one row per ``tile`` rows at most
        large = F.broadcast(sizes.filter(F.col("n") > tile))
        out.append(rows.join(large, ["mask", "key"], "left_anti")
                   .select(F.xxhash64("mask", "key").alias("bucket"), "fp"))
        # runs of the bits by which no bucket is cut yet
        runs = F.create_map(*[c for m in masks for c in (F.lit(m).cast("long"), F.array(*[
            F.lit(m | _signed(run)).cast("long") for run in _runs(~m & (1 << 64) - 1, radius)]))])
        parts = rows.join(large, ["mask", "key"]).select(
            F.struct("mask", "key", "n").alias("whole"), "fp",
            F.explode(runs[F.col("mask")]).alias("mask")).withColumn("key", key)
        counts = sized(parts, "whole", "mask", "key")
        pairs = F.sum(F.col("n").cast("double") * F.col("n"))
        less = stored(counts.groupBy("whole").agg(pairs.alias("pairs")).select(
            "whole", (2 * F.col("pairs") <= F.pow("whole.n", F.lit(2))).alias("less")),
            "simhash-less")
        # fingerprints too much alike: every two tiles of the bucket are a bucket
        alike = F.broadcast(less.filter("not less").select(
            "whole.mask", "whole.key", F.ceil(F.col("whole.n") / tile).cast("int").alias("tiles")))
        mine = F.pmod(F.xxhash64("fp"), "tiles").cast("int")
        out.append(rows.join(alike, ["mask", "key"]).withColumn("mine", mine)
                   .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
                   .filter("mine <> other")
                   .select(F.xxhash64("mask", "key", F.least("mine", "other"),
                                      F.greatest("mine", "other")).alias("bucket"), "fp"))
        less = F.broadcast(less.filter("less"))
        rows = parts.join(less, "whole").select("fp", "mask", "key")
        sizes = stored(counts.join(less, "whole").groupBy("mask", "key")
                       .agg(F.sum("n").alias("n")), "simhash-sizes")
    out.append(rows.select(F.xxhash64("mask", "key").alias("bucket"), "fp"))
    return reduce(DataFrame.unionByName, out)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(x, y) links between the distinct values of ``fp`` that keep the components of
    "at most ``radius`` differing bits"."""
    rows = bucketed(stored(fps.select("fp").distinct(), "simhash"), radius, tile)

    def run(batches):
        batches = list(batches)  # about TASK tiles, and the rest of a bucket
        if batches:
            read = pa.Table.from_batches(batches)
            links = linked_in(read.column("bucket").to_numpy(),
                              read.column("fp").to_numpy().view(np.uint64), radius).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])],
                                             ["x", "y"])

    n_tasks = max(1, -(-rows.count() // (TASK * tile)))
    return rows.repartition(n_tasks, "bucket").mapInArrow(run, "x long, y long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the links (x, y): root is the least node that can be
    reached. Alternating large-star and small-star rounds, each written to the shared
    folder; a node's neighbours are only ever reduced to their least, never collected."""
    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("x"), F.bit_xor(F.xxhash64("x", "y"))).first())

    edges = stored(links.filter("x <> y").select(
        F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), name)
    before, now = None, state(edges)
    while now != before:
        # large star: every neighbour above a node is linked to the node's least neighbour
        both = edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")) \
            .select("x", F.least("m", "x").alias("m"))
        large = both.join(least, "x").filter("y > x").select(
            F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # small star: a node and its lower neighbours are linked to the least of them
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        pairs = large.join(low, "x").select(F.explode(F.array(
            F.struct("x", F.col("m").alias("y")),
            F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        edges = stored(pairs.select("e.*").filter("x <> y").distinct(), name)
        before, now = now, state(edges)
    roots = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.unionAll(edges.select(F.col("y").alias("node"), F.col("y").alias("root"))
                          .distinct())


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
            tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """((doc_id, th, fp) of each row, (c_fp, root) of each distinct fingerprint)."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    roots = components(fingerprint_links(fps, radius, tile))
    classes = fps.select(F.col("fp").alias("c_fp")).distinct()
    return fps, classes.join(roots, F.col("c_fp") == F.col("node"), "left") \
        .select("c_fp", F.coalesce("root", "c_fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    tile: int = TILE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits) and
    component_id, the least doc_id that links of at most ``radius`` differing bits reach,
    the document itself included.

    NULL and empty texts have fingerprint zero and link like any other. Rows that share a
    doc_id are one node per fingerprint. A row with a NULL doc_id joins its component but
    never names it (component_id NULL if all its rows are so). Empty input: no rows.
    """
    fps, classes = grouped(docs, shingle, radius, tile)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")) \
        .join(classes, F.col("fp") == F.col("c_fp"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = least.join(named, "root").select("c_fp", "component_id")
    return fps.join(classes, F.col("fp") == F.col("c_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
             tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (a NULL only if
    there is no other), ties by the hash of the text; of rows alike in both, any one."""
    fps, classes = grouped(docs, shingle, radius, tile)
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("k_id"),
                    F.col("th").alias("k_th"))
    best = (fps.groupBy("fp", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
            .join(classes, F.col("fp") == F.col("c_fp"))
            .groupBy("root").agg(F.min_by(F.struct("doc_id", "th", "n"), rank).alias("best"))
            .select(F.col("best.doc_id").alias("k_id"), F.col("best.th").alias("k_th"), "best.n"))
    rows = docs.select(F.struct(*docs.columns).alias("row"),
                       F.col("doc_id").cast("long").alias("r_id"), F.xxhash64("text").alias("r_th"))
    kept = rows.join(best, F.col("r_id").eqNullSafe(F.col("k_id"))
                     & (F.col("r_th") == F.col("k_th")))
    again = kept.filter("n > 1").withColumn("nth", F.row_number().over(
        Window.partitionBy("k_id", "k_th").orderBy("n"))).filter("nth = 1").select("row.*")
    return kept.filter("n = 1").select("row.*").unionAll(again)
