"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 32 bytes decides where chunks end, so equal passages are cut
alike wherever they stand and an insertion moves the cuts of its neighbourhood only. Chunks
are found again by a 96-bit digest: the first occurrence stays, later ones go.

A repeated passage begins and ends inside chunks that are cut in two ways. Adjoining repeated
chunks whose first occurrences adjoin as well are one segment, and a segment is extended to
both sides, byte by byte, against the text around its first occurrence; the least length is
asked of the extended match. Only segments and the bytes around distinct first occurrences
travel for that, and of the texts only those that hold a first occurrence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import stored, text_bytes

#: a byte ends a chunk with this chance, if the chunk has the least size
MEAN, LEAST, MOST = 48, 16, 512
#: bytes an extended match has at least to be removed (about 30 words)
MIN_RUN = 200
#: bytes that a segment is extended by at most to each side (a whole chunk there would have been
#: found itself, and so few are longer)
AROUND = 192
#: most rows of the broadcast table that says which texts hold a first occurrence (a long each)
SLOTS = 1 << 20
#: bytes hashed at once
BLOCK = 1 << 20
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k over the last 32 bytes, mod 2**32: what rolling
    h = (h << 1) + GEAR[byte] gives, by doubling the window five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k) if len(h) > k else h[:0]
    return h


def chunk_ends(text: bytes, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """End offsets of the chunks of a text; none for an empty one."""
    data = np.frombuffer(text, np.uint8)
    limit = np.uint32((1 << 32) // mean)
    marks = []
    for at in range(0, len(data), BLOCK):
        before = min(at, 31)
        h = gear_hash(data[at - before:at + BLOCK])[before:]
        marks.append(np.flatnonzero(h < limit) + at + 1)
    ends, last = [], 0
    for mark in (np.concatenate(marks).tolist() if marks else []) + [len(data)]:
        while mark - last > most:
            last += most
            ends.append(last)
        if mark - last >= least or mark == len(data) > last:
            last = mark
            ends.append(last)
    return ends


def _identity(rest: list | None = None) -> list:
    """doc_id and th, 32 bits of the text's hash: what tells documents apart."""
    return [F.col("doc_id").cast("long").alias("doc_id"),
            F.shiftright(F.xxhash64("text"), 32).cast("int").alias("th"), *(rest or [])]


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, th, start, size, h, g) of every chunk; (h, g) is its digest."""
    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                counts, starts, sizes, digests = [], [], [], []
                for text in some.column("text"):
                    text = text.as_py()
                    ends = chunk_ends(text)
                    begins = [0, *ends][:len(ends)]
                    counts.append(len(ends))
                    starts += begins
                    sizes += [b - a for a, b in zip(begins, ends)]
                    digests += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(begins, ends)]
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                row = pa.array(np.repeat(np.arange(some.num_rows), counts))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(row), some.column("th").take(row),
                     pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()),
                     pa.array(h[:, 0].copy()), pa.array(h[:, 1].astype(np.int32))],
                    ["doc_id", "th", "start", "size", "h", "g"])

    return docs.select(*_identity([text_bytes().alias("text")])).mapInArrow(
        run, "doc_id long, th int, start int, size int, h long, g int")


def segments_of(found: list[dict]) -> list[tuple]:
    """(start, end, f_id, f_th, f_start) of the runs of repeated chunks that adjoin, as do
    their first occurrences."""
    out: list[list] = []
    for x in sorted(found, key=lambda x: x["start"]):
        last = out[-1] if out else None
        if last and last[1] == x["start"] and last[2:4] == [x["f_id"], x["f_th"]] \
                and last[4] + last[1] - last[0] == x["f_start"]:
            last[1] += x["size"]
        else:
            out.append([x["start"], x["start"] + x["size"], x["f_id"], x["f_th"], x["f_start"]])
    return [tuple(x) for x in out]


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, th, start, end, f_id, f_th, f_start): per document the segments of chunks that
    occur before, in another document or in the same one, and where. The first occurrence is
    that of the least (doc_id, th, start), NULL doc_ids first. A common chunk is reduced
    map-side to one row per task, and its rows join the result with skew splitting."""
    every = stored(chunks(docs), "chunks")
    place = F.struct("doc_id", "th", "start")
    firsts = (every.groupBy("h", "g")
              .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    firsts = stored(firsts.select("h", "g", "first"), "first-chunks")
    again = every.join(firsts, ["h", "g"]).filter(~place.eqNullSafe(F.col("first")))
    found = again.groupBy("doc_id", "th").agg(F.collect_set(F.struct(
        "start", "size", F.col("first.doc_id").alias("f_id"), F.col("first.th").alias("f_th"),
        F.col("first.start").alias("f_start"))).alias("found"))
    names = ["doc_id", "th", "start", "end", "f_id", "f_th", "f_start"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            rows = [(i, th, *x) for i, th, found in zip(*(
                batch.column(c).to_pylist() for c in ("doc_id", "th", "found"))) for x in segments_of(found)]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return stored(found.mapInArrow(run, "doc_id long, th int, start int, end int, f_id long, f_th int, "
                                        "f_start int"), "segments")


def _surroundings(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """(f_id, f_th, f_start, f_end, before, after): the bytes around the distinct first
    occurrences of segments."""
    wanted = segs.select("f_id", "f_th", "f_start",
                         (F.col("f_start") + F.col("end") - F.col("start")).alias("f_end")).distinct()
    wanted = stored(wanted.groupBy("f_id", "f_th").agg(
        F.collect_list(F.struct("f_start", "f_end")).alias("places")), "first-places")
    slot = F.pmod(F.xxhash64("doc_id", "th"), F.lit(SLOTS))
    slots = wanted.select(F.pmod(F.xxhash64("f_id", "f_th"), F.lit(SLOTS)).alias("slot")).distinct()
    # only texts that can hold a first occurrence are shuffled
    texts = docs.select(*_identity([text_bytes().alias("text")])) \
        .join(F.broadcast(slots), slot == F.col("slot"), "left_semi")
    held = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")))
    kind = "f_id long, f_th int, f_start int, f_end int, before binary, after binary"
    names = [c.split()[0] for c in kind.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        for batch in batches:
            rows = []
            for i, th, text, places in zip(*(batch.column(c) for c in ("f_id", "f_th", "text", "places"))):
                i, th, text = i.as_py(), th.as_py(), text.as_py()
                rows += [(i, th, x["f_start"], x["f_end"],
                          text[max(0, x["f_start"] - AROUND):x["f_start"]],
                          text[x["f_end"]:x["f_end"] + AROUND]) for x in places.as_py()]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    # repeated rows give the same bytes
    return held.select("f_id", "f_th", "text", "places").mapInArrow(run, kind) \
        .dropDuplicates(["f_id", "f_th", "f_start", "f_end"])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def extended(text: bytes, found: list[dict], min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """(start, end) of the matches to remove: segments with the equal bytes to both sides of
    them and of their first occurrence, joined where they meet, of at least ``min_run`` bytes.
    A segment does not grow into its own first occurrence (``room`` bytes before it)."""
    out: list[list[int]] = []
    grown = []
    for x in found:
        a, b = x["start"], x["end"]
        before = x["before"][max(0, len(x["before"]) - x["room"]):]
        left = _common(text[max(0, a - AROUND):a][::-1], before[::-1])
        grown.append((a - left, b + _common(text[b:b + AROUND], x["after"])))
    for a, b in sorted(grown):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= min_run]


def _with_found(docs: DataFrame, rest: list) -> DataFrame:
    segs = segments(docs)
    around = _surroundings(docs, segs).withColumnsRenamed(
        {"f_id": "a_id", "f_th": "a_th", "f_start": "a_start"})
    f_end = F.col("f_start") + F.col("end") - F.col("start")
    own = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th"))
    found = (segs.join(around, F.col("f_id").eqNullSafe(F.col("a_id")) & (F.col("f_th") == F.col("a_th"))
                       & (F.col("f_start") == F.col("a_start")) & (f_end == F.col("f_end")))
             .groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"))
             .agg(F.collect_list(F.struct(
                 "start", "end", "before", "after",
                 F.when(own, F.col("start") - F.col("f_end")).otherwise(F.lit(AROUND)).alias("room")))
                 .alias("found")))
    rows = docs.select(*_identity(rest))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("s_id"))
                     & (F.col("th") == F.col("s_th")), "left").drop("th", "s_id", "s_th")


def _kept(text: bytes, found, min_run: int) -> tuple[bytes, list[tuple[int, int]]]:
    gone = extended(text, found or [], min_run)
    pieces, last = [], 0
    for a, b in gone:
        pieces.append(text[last:a])
        last = b
    return b"".join(pieces) + text[last:], gone


def substring_report(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (removed runs), kept_sha256
    (of the bytes that stay) and spans, an array of (start, end).

    Texts are UTF-8 bytes, NULL is empty. Of equal chunks the first stays, in order of
    doc_id, text hash and position (NULL doc_id first); matches around later ones of at least
    ``min_run`` bytes go. Rows alike in doc_id and text are one document.
    """
    kind = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
            "spans array<struct<start: long, end: long>>")

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text"), batch.column("found")):
                text = text.as_py()
                kept, gone = _kept(text, found.as_py(), min_run)
                rows.append((len(text), len(text) - len(kept), len(gone),
                             hashlib.sha256(kept).hexdigest(),
                             [{"start": a, "end": b} for a, b in gone]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string(), span]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return _with_found(docs, [text_bytes().alias("text")]).mapInArrow(run, kind)


def dedup_substrings(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text`` (NULL stays NULL). A cut inside a
    character drops the bytes of that character that are left."""
    def run(batches):
        for batch in batches:
            rows, found = batch.column("row"), batch.column("found")
            texts = [None if t is None else
                     _kept(t.encode("utf-8", "replace"), f.as_py(), min_run)[0].decode("utf-8", "ignore")
                     for t, f in zip(rows.field("text").to_pylist(), found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if name == "text" else rows.field(name)
                 for name in docs_columns], docs_columns)

    docs_columns = docs.columns
    return _with_found(docs, [F.struct(*docs.columns).alias("row")]).select("row", "found") \
        .mapInArrow(run, docs.schema)
