"""NumPy helpers on the UTF-8 bytes of a column, used inside Arrow tasks.

A column is handled as one byte buffer plus row offsets, so that tokenising
and hashing are a handful of array passes instead of a Python loop per word.
Nulls count as empty texts.

Hashes of spans are polynomial modulo 2**64. That is sound for short spans
only: of two texts made to cancel out (Thue-Morse sequences), those of 1,024
bytes collide whatever the base. Spans of more than ``LONGEST`` bytes are
therefore hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and 0x09 to 0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Texts are taken in blocks of about this many bytes, which bounds the work arrays.
BLOCK_BYTES = 1 << 20
#: Powers are kept for blocks of up to this size; a longer text has its own made and dropped.
KEPT_POWERS = 2 << 20
#: The most bytes of a span that is hashed as a polynomial.
LONGEST = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=2)
def byte_codes(seed: int = 0) -> np.ndarray:
    """A fixed random 64-bit code for each byte value."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
        steps = np.full(n, base, dtype=np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KEPT_POWERS)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; a worker keeps at most KEPT_POWERS of each."""
    up, down = _kept_powers() if n <= KEPT_POWERS else _powers(n)
    return up[:n], down[:n]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and the offset of each row (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.frombuffer(data.tobytes().translate(LOWER), dtype=np.uint8)


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES):
    """Row ranges (a, b) whose texts hold about ``size`` bytes; a longer text stands alone."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), rows)
        yield a, b
        a = b


def text_blocks(column: pa.Array | pa.ChunkedArray, lowered: bool = True, size: int = BLOCK_BYTES):
    """(a, b, data, offsets) of the row ranges of ``blocks``: their bytes, in lower case if asked for."""
    data, offsets = column_bytes(column)
    for a, b in blocks(offsets, size):
        part = data[offsets[a] : offsets[b]]
        yield a, b, lower(part) if lowered else part, offsets[a : b + 1] - offsets[a]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    inside = ~WHITE[data]
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Polynomial prefix hashes: out[i] covers data[:i]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_codes(seed)[data] * up[:-1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]: equal bytes get equal values wherever they stand."""
    _, down = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def content_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end] of any length, the starts ascending."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(data), BLOCK_BYTES):  # in slices, so that a very long text needs no long arrays
        x, y = np.searchsorted(starts, [a, a + BLOCK_BYTES])
        part = data[a : a + BLOCK_BYTES + LONGEST]
        out[x:y] = span_hashes(prefix_hashes(part), starts[x:y] - a, np.minimum(ends[x:y] - a, len(part)))
    for i in np.flatnonzero(ends - starts > LONGEST).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a block."""
    starts, ends, rows = word_spans(data, offsets)
    return content_hashes(data, starts, ends), rows
