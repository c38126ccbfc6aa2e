"""Vectorised views of Arrow text columns, shared by the operators of this subpackage.

Words are runs of bytes other than 0x20 and 0x09-0x0D and never cross rows. Hashes are
polynomial sums modulo 2**64 over a fixed random table, so that the hash of any span comes
from two prefix sums; they are the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1
_BASE = 0xD1B54A32D192ED03
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of an ordered pair of hashes."""
    return mix(a * U64(_ODD) + mix(b + U64(0x5851F42D4C957F2D)))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _INV):
            p = np.full(size, base, U64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        _powers[size] = tuple(both)
    return _powers[size]


class Prefix:
    """Prefix sums from which the hash of every span of the values follows."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power, self.inverse = _power(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * power[:n], dtype=U64, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end); the length is hashed too."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64) * U64(_ODD))


def byte_prefix(buf: np.ndarray) -> Prefix:
    return Prefix(_TABLE[buf])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(column: pa.Array, limit: int = 1 << 22, most: int = 8192):
    """Consecutive (first row, end row, bytes, offsets) of at most ``limit`` bytes, or one row, and ``most`` rows."""
    buf, offs = raw(column)
    row, n = 0, len(offs) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        stop = min(stop, row + most)
        yield row, stop, buf[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begin, end = offs[:-1], offs[1:]
    begin, end = begin[begin < end], end[begin < end]
    first[begin] = solid[begin]
    last[end - 1] = solid[end - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs, start, "right") - 1


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes stay."""
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
