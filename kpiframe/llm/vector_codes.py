"""Vector codes: product quantisation in integers, searched by Walsh-Hadamard coefficients.

Components become integers (``floor(scale * x)``), a vector is cut into equal parts, and each
part is coded by the nearest entry of its position's codebook. To find it, part and entries
are zero-padded to a power of two m and transformed by the integer Walsh-Hadamard matrix: the
squared distances of the transforms are exactly m times those of the parts. Coefficients are
taken in sequency order, where the first few hold most of the distance; an entry whose sum so
far exceeds the whole distance of the best candidate is out. Nothing is floating point.

Codebooks are entries x components integers, which a parameter bounds; vectors stay in Spark:
a round sends one partial (sum, count) row per cell and task, and no vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: components up to this size leave room in 64 bits for sums over 4,096 coefficients
SMALL = 1 << 18
#: coefficients that are summed for every entry before any is dropped
FIRST = 2
#: vectors compared at once
BLOCK = 2048
LARGEST = (1 << 63) - 1


def walsh_matrix(m: int) -> np.ndarray:
    """The m x m Walsh-Hadamard matrix (m a power of two), rows by number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < m:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def transformed(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, zero-padded to a power of two. Squared
    distances of the results are that power times those of the rows."""
    n, width = parts.shape
    m = 1 << (width - 1).bit_length()
    padded = np.zeros((n, m), parts.dtype)
    padded[:, :width] = parts
    return padded @ walsh_matrix(m).astype(parts.dtype)


def _roomy(values: np.ndarray) -> np.ndarray:
    """``values`` as Python integers if 64 bits could overflow."""
    if values.dtype != object and values.size and (values.max() > SMALL or values.min() < -SMALL):
        return values.astype(object)
    return values


def nearest(x: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each row of ``x``, ties to the lower entry; both
    arguments are transforms, and the distance is that of the transforms."""
    if len(x) > BLOCK:
        done = [nearest(x[a:a + BLOCK], e) for a in range(0, len(x), BLOCK)]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    n, m = x.shape
    start = min(FIRST, m)
    so_far = sum((x[:, s, None] - e[None, :, s]) ** 2 for s in range(start))
    guess = so_far.argmin(axis=1)
    bound = ((x - e[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(so_far <= bound[:, None])
    total = so_far[row, entry]
    for s in range(start, m):
        total = total + (x[row, s] - e[entry, s]) ** 2
        stay = total <= bound[row]
        row, entry, total = row[stay], entry[stay], total[stay]
    # pairs stand by row and entry; the guess of each row is among them
    first = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(total, first) if n else total
    hits = np.flatnonzero(total == least[row])
    rows, at = np.unique(row[hits], return_index=True)
    return entry[hits[at]], least


@dataclass
class Codebooks:
    """``entries[part, entry, position]``, integers."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry per part, error) of each row of integer ``vectors``."""
        n, parts = len(vectors), len(self.entries)
        code = np.zeros((n, parts), np.int64)
        error: np.ndarray = np.zeros(n, object)
        size = 1 << (self.width - 1).bit_length()
        both = _roomy(np.concatenate([vectors.reshape(-1), self.entries.reshape(-1)])).dtype
        for p in range(parts):
            cut = vectors[:, p * self.width:(p + 1) * self.width].astype(both)
            code[:, p], far = nearest(transformed(cut), transformed(self.entries[p].astype(both)))
            error += far.astype(object) // size
        return code, error

    def text(self) -> str:
        """All integers by part, entry and position, joined by commas."""
        return ",".join(str(int(v)) for v in self.entries.reshape(-1))

    def decoded(self, code: bytes) -> list[float]:
        """The vector that a code stands for."""
        return [int(v) / self.scale for p, c in enumerate(code) for v in self.entries[p, c]]


def integer_vectors(vectors: DataFrame, column: str = "embedding", parts: int = PARTS,
                    scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows whose vector can be coded, as integers (array of long).

    Left out are rows whose vector is NULL or holds a NULL, NaN or infinite component, and
    vectors of another length than most have (of the lengths that ``parts`` divides; ties:
    the shorter). Integers beyond 2^62 stop there.
    """
    x = F.col(column)
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c)
                                      | (F.abs(c) == F.lit(float("inf"))))
    top = float(1 << 62)
    number = F.transform(x, lambda c: F.floor(F.least(F.lit(top), F.greatest(
        F.lit(-top), c.cast("double") * F.lit(float(scale))))).cast("long"))
    rows = stored(vectors.filter(whole & (F.size(x) > 0) & (F.size(x) % parts == 0))
                  .select(F.col("vec_id").cast("long").alias("vec_id"), "label", number.alias("v")),
                  "integer-vectors")
    size = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "size").first()
    return rows.filter(F.size("v") == F.lit(size["size"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floored mean of the parts that it is nearest to."""
    sent = rows.sparkSession.sparkContext.broadcast(books)  # entries x components integers

    def add(batches: Iterator[pa.RecordBatch]):
        held = sent.value
        parts, entries, width = held.entries.shape
        total = np.zeros((parts, entries, width), object)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("v"))
            if not len(vectors):
                continue
            code, _ = held.codes(vectors)
            wide = _roomy(vectors)
            for p in range(parts):
                some = np.zeros((entries, width), wide.dtype)
                np.add.at(some, code[:, p], wide[:, p * width:(p + 1) * width])
                total[p] += some.astype(object)
                count[p] += np.bincount(code[:, p], minlength=entries)
        at = np.flatnonzero(np.repeat(count.reshape(-1), width))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array([Decimal(int(t)) for t in total.reshape(-1)[at]],
                                    pa.decimal128(28, 0)),
             pa.array(np.repeat(count.reshape(-1), width)[at])], ["cell", "total", "n"])

    sums = (rows.select("v").mapInArrow(add, "cell long, total decimal(28,0), n long")
            .groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    new = books.entries.reshape(-1).copy()
    for cell, total, n in sums.collect():  # one row per integer of the codebooks
        new[cell] = int(total) // n
    sent.destroy()
    return Codebooks(new.reshape(books.entries.shape), books.scale)


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
                  rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``integer_vectors`` rows: started from the parts of the ``entries``
    smallest vec_ids (NULL last, ties by vector; fewer rows make fewer entries), then refined
    ``rounds`` times. An entry without parts stays. None without rows."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    start = [r["v"] for r in rows.orderBy(*order).limit(entries).collect()]  # ``entries`` rows
    if not start:
        return None
    first = np.array(start, np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    books = Codebooks(np.ascontiguousarray(first), scale)
    for _ in range(rounds):
        books = _refined(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The rows of ``integer_vectors`` with ``code`` (binary: one byte per part; at most 256
    entries) and ``error``, the squared distance to what the code stands for, in squared
    integer steps (at most the largest long)."""
    if books.entries.shape[1] > 256:
        raise ValueError("a code holds one byte per part")
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            vectors = _matrix(batch.column("v"))
            if not len(vectors):
                continue
            code, error = sent.value.codes(vectors)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()),
                 pa.array([min(int(e), LARGEST) for e in error], pa.int64())],
                ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(
        run, f"vec_id long, label {kind}, code binary, error long")


def vector_codes(vectors: DataFrame, column: str = "embedding", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per vector that can be coded (see ``integer_vectors``): vec_id, code (two hex
    digits per part), error, label_error (errors summed over equal labels, NULL labels
    together) and codebooks_sha256. Repeated vec_ids are rows of their own."""
    rows = integer_vectors(vectors, column, parts, scale)
    books = fit_codebooks(rows, parts, entries, rounds, scale)
    if books is None:
        books = Codebooks(np.zeros((parts, 0, 1), np.int64), scale)
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    out = stored(encode(rows, books), "vector-codes")
    by_label = stored(out.groupBy(F.col("label").alias("l"))
                      .agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "label-errors")
    # both sides are written tables: Spark sends the labels' table if it is small, and splits
    # the rows of a hot label otherwise
    return out.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error",
        F.least("total", F.lit(LARGEST)).cast("long").alias("label_error"),
        F.lit(digest).alias("codebooks_sha256"))
