"""Shared plumbing of the training-data operators: tables, durable cuts, byte-level words.

Text kernels read Arrow buffers directly, so a batch costs a handful of numpy
passes instead of a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.tables import durable, scratch, small, table

__all__ = ["durable", "scratch", "small", "table"]

#: Bytes of text that a numpy kernel works on at once; longer single texts form a slice of their own.
SLICE_BYTES = 2 << 20
#: Rows that one Arrow batch carries to Python.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches: texts may be long, and both sides hold a batch in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def crc32_mod(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# --- Arrow text ------------------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and int64 offsets (one more than rows); null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_BYTES of text each."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


# --- words and shingles ----------------------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Word bytes when only the six ASCII blanks separate words.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes when words are runs of a-z, 0-9 and everything beyond ASCII (upper case is lowered first).
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("a") : ord("z") + 1] = ALNUM[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all of it."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else _INVERSE
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def spans(data: np.ndarray, offsets: np.ndarray, wordly: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; ``wordly`` tells word bytes, and no word crosses a document's end."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = wordly[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begin[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span's bytes and length, from one running polynomial sum."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power("down", n + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, docs: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every ``width``-word shingle; a shorter document is one shingle of all its words."""
    if not len(words):
        return words.astype(np.uint64), docs
    m = len(words) - width + 1
    parts, owners = [], []
    if m > 0:
        value = np.zeros(m, np.uint64)
        for k in range(width):
            value = mix(value + words[k : k + m] + np.uint64(k + 1))
        whole = docs[:m] == docs[width - 1 :]
        parts.append(value[whole])
        owners.append(docs[:m][whole])
    counts = np.bincount(docs, minlength=n_docs)
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            first = np.searchsorted(docs, short)
            value = np.full(len(short), size, np.uint64) * np.uint64(0xA24BAED4963EE407)
            for k in range(size):
                value = mix(value + words[first + k] + np.uint64(k + 1))
            parts.append(value)
            owners.append(short)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order]
