"""Vectorised hashing over batches of text: words, shingles, lines and any other substring.

Texts are looked at as UTF-8 bytes, straight from the Arrow buffer. A batch is cut into slices of about `SLICE` bytes (a
longer text is a slice of its own), so temporary memory is about 60 bytes per byte of a slice, whatever the batch size.
A substring's hash is a polynomial over random 64-bit values of its bytes, taken from prefix sums in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
_U = np.uint64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
WORD_BASE = 0xA0761D6478BD642F
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class _Powers:
    """Powers up to the longest slice seen so far."""

    up = down = np.empty(0, dtype=_U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BASE, n), _powers(INVERSE, n)
        return cls.up, cls.down


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in these bytes and their end); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Prefix:
    """Hashes of substrings of `data` (bytes, or 64-bit values such as the hashes of words), given by starts and ends."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=_U)
        with np.errstate(over="ignore"):
            values = BYTE_VALUES[data] if data.dtype == np.uint8 else mix(data)
            values *= up[: len(data)]
            np.cumsum(values, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(_U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower-cased A-Z, cut at ASCII white space and text ends), and each text's first word index."""
    data = LOWER[data]
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Prefix(data).of(starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter text gives one for its whole sequence, an empty one none."""
    n = len(hashes)
    width = min(width, n)
    if not width:
        return hashes
    with np.errstate(over="ignore"):
        out = np.zeros(n - width + 1, dtype=_U)
        for k in range(width):
            out = out * _U(WORD_BASE) + hashes[k : n - width + 1 + k]
        return mix(out + _U(width))
