"""Quality rules by compression bands.

Zstandard's ratio (compressed / original bytes) tells repetitive text (low) and noise (high)
from prose. Short texts compress worse, so the limits follow the length: a band over the whole
text, whose limits are interpolated in the logarithm of its bytes, and a band for chunks of a
fixed size, so that a bad stretch shows in a long document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import WHITE, text_bytes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LEVEL = 3
#: (bytes, least ratio, greatest ratio) of a whole text; between them linear in log(bytes),
#: before the first and after the last constant
BANDS = ((256, 0.520, 0.820), (512, 0.515, 0.750), (1024, 0.483, 0.670), (2048, 0.456, 0.610),
         (4096, 0.435, 0.590), (8192, 0.416, 0.580), (16384, 0.405, 0.570),
         (32768, 0.393, 0.570), (65536, 0.380, 0.570), (131072, 0.365, 0.570))
#: bytes of a chunk, its least and greatest ratio, and the share of chunks that may be outside
CHUNK = 2048
CHUNK_BAND = (0.458, 0.620)
CHUNKS_OUTSIDE = 1 / 3

_WHITE = WHITE.encode()
_NOT_WORD_STARTS = _WHITE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[bytes]) -> int:
    """Words in a 3-word window that the text holds twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].reshape(-1)
    _, which, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True,
                                 return_counts=True)
    again = counts[which.reshape(-1)] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def band(n_bytes: int) -> tuple[float, float]:
    """Least and greatest ratio for a whole text of this length."""
    at, low, high = zip(*BANDS)
    x, xs = np.log(max(n_bytes, 1)), np.log(at)
    return float(np.interp(x, xs, low)), float(np.interp(x, xs, high))


def chunk_starts(n_bytes: int) -> list[int]:
    """Where the chunks of a text start: one after the other, and a last one that ends with
    the text, so that every byte is in a chunk. A text shorter than a chunk has none."""
    starts = list(range(0, n_bytes - CHUNK + 1, CHUNK))
    if starts and starts[-1] + CHUNK < n_bytes:
        starts.append(n_bytes - CHUNK)
    return starts


def compression(text: bytes, zstd: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio of the whole text, chunks, chunks outside their band, verdict). An empty text
    has ratio 1 and fails."""
    if not text:
        return 1.0, 0, 0, False
    ratio = len(zstd.compress(text)) / len(text)
    view = memoryview(text)
    starts = chunk_starts(len(text))
    low, high = CHUNK_BAND
    outside = sum(not low <= len(zstd.compress(view[at:at + CHUNK])) / CHUNK <= high for at in starts)
    least, greatest = band(len(text))
    return ratio, len(starts), outside, \
        least <= ratio <= greatest and outside <= CHUNKS_OUTSIDE * len(starts)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id; n_words; word_chars (code points in words); n_symbols
    (characters ``#*$%&|<>``); n_dup_lines (lines with a word that equal an earlier line);
    n_repeat_words; base_failed (under 50 words, or over half of them repeated); kept (base
    passed, and the compression of the whole and of its chunks within their bands); ratio,
    n_chunks, n_chunks_outside.

    NULL is an empty text: no words, base_failed. No shuffle: each text is judged alone.
    """
    kind = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, base_failed boolean, kept boolean, ratio double, "
            "n_chunks long, n_chunks_outside long")
    names = [c.split()[0] for c in kind.split(", ")]
    types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                words = text.split()
                again = repeat_words(words)
                failed = len(words) < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * len(words)
                ratio, chunks, outside, good = compression(text, zstd)
                rows.append((len(words), len(text.translate(None, _NOT_WORD_STARTS)),
                             len(text) - len(text.translate(None, _SYMBOLS)), dup_lines(text),
                             again, failed, good and not failed, ratio, chunks, outside))
            columns = list(zip(*rows)) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types[1:]))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")) \
        .mapInArrow(run, kind)


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns stay as they are. NULL and
    empty texts have too few words and go; repeated rows are judged alike."""
    def run(batches):
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                text = (text.as_py() or "").encode("utf-8", "replace")
                words = text.split()
                keep.append(len(words) >= MIN_WORDS
                            and 100 * repeat_words(words) <= MAX_REPEAT_PERCENT * len(words)
                            and compression(text, zstd)[3])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
