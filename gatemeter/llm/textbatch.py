"""Vectorised word tables over Arrow string columns.

A *slice* is a run of rows of a record batch whose texts are taken together: their UTF-8
bytes stand in one numpy array, and words, lines and n-grams of all rows are found by a
few array passes. Slices are cut by bytes, so memory is bounded by the slice size or by
the longest single text, whichever is larger.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; no word crosses a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 256 << 10

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.Generator(np.random.PCG64(20_240_611))
#: A random 64-bit value for each byte, so that the polynomial below isn't over small integers.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for x in (_BASE, _BACK):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=np.uint64))
        if size > 4 * SLICE_BYTES:
            return made[0][:n], made[1][:n]
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each; a longer single text stands alone."""
    off = offsets_of(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


class Slice:
    """Bytes, row offsets and words of some rows; see the module's text."""

    def __init__(self, column: pa.Array, lower: bool = False):
        off = offsets_of(column)
        raw = column.buffers()[2] if len(column) else None
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        self.off = off - off[0]
        self.n = len(column)
        solid = ~_BLANK[self.data]
        self.solid = solid
        before = np.zeros(len(solid), bool)
        before[1:] = solid[:-1]
        first = self.off[:-1]
        before[first[first < len(solid)]] = False
        after = np.zeros(len(solid), bool)
        after[:-1] = solid[1:]
        last = self.off[1:]
        after[last[last > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.row = np.searchsorted(self.off, self.start, "right") - 1
        self.n_words = np.bincount(self.row, minlength=self.n)
        self._sums: np.ndarray | None = None

    def sums(self) -> np.ndarray:
        """Running sums of the byte values times powers of the base, one longer than the data."""
        if self._sums is None:
            up = powers(max(1, len(self.data)))[0]
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], dtype=np.uint64, out=self._sums[1:])
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they stand."""
        c, down = self.sums(), powers(len(self.data) + 1)[1]
        return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def counted(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each row has."""
        c = running(flags)
        return c[self.off[1:]] - c[self.off[:-1]]

    def code_points(self) -> np.ndarray:
        """Flags of the bytes that begin a code point."""
        return _LEAD[self.data]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the \\n-split lines, the empty ones included."""
        breaks = np.flatnonzero(self.data == 10)
        filled = np.flatnonzero(self.off[1:] > self.off[:-1])
        start = np.sort(np.concatenate([self.off[filled], breaks + 1]))
        row = np.concatenate([filled, np.searchsorted(self.off, breaks, "right") - 1])
        row.sort()
        end = np.sort(np.concatenate([self.off[filled + 1], breaks]))
        return start, end, row


def running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def grams(word: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each n-word window inside one row, and a rolling hash of the window."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h *= _BASE
        h += word[k : k + m]
    return at, mix(h[at] + np.uint64(n))


def repeated(key: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Flags of the words inside n-word windows that start at `at`."""
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, at, 1) if len(at) < 64 else delta.__iadd__(np.bincount(at, minlength=size + 1))
    delta -= np.bincount(at + n, minlength=size + 1)[: size + 1]
    return np.cumsum(delta[:size]) > 0
