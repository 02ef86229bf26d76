"""Vectorised byte, word and shingle hashing over Arrow string batches.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased.  A word's
64-bit hash is a polynomial over random byte values modulo 2**64, finalised by a
bijective mixer; all words of a chunk are hashed by one running sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at once; a longer single text forms a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII bytes that are no letters: with these as breaks, words are runs of letters.
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[np.r_[65:91, 97:123, 128:256]] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in runs of at most ``limit`` bytes or one row."""
    data, off = string_parts(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, words before each document and in all)."""
    low = _LOWER[data]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = ~breaks[low]
    step = np.diff(inside)
    starts = step[:-1] == 1
    ends = step[1:] == -1
    inner = off[(off > 0) & (off < len(low))]
    cut = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]
    starts[cut] = True
    ends[cut - 1] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return low, starts, ends, np.searchsorted(starts, off)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    power, inverse = _pow(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct, sorted hashes of runs of ``width`` words; of all words if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    w = min(width, n)
    h = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        h = h * _STEP + hashes[k : n - w + 1 + k]
    return np.unique(mix(h))


def document_shingles(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes) of each text."""
    for a, b, data, off in chunks(column):
        low, starts, ends, first = words(data, off)
        h = span_hashes(low, starts, ends)
        for k in range(b - a):
            yield a + k, shingles(h[first[k] : first[k + 1]], width)


def bounded(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """``df``, with its session's Arrow batches bounded to so many bytes.

    A batch of 64 MB, Spark's default, stands several times in an executor and its
    Python worker; of long texts that would be most of a small executor's memory.
    """
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or not 0 < int(now[1]) <= most:
        spark.conf.set(name, str(most))
    return df


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
