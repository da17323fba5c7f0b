"""Word and shingle hashes of Arrow string columns, vectorised over slices of a batch.

Words are `[^\\x20\\x09-\\x0D]+`; A-Z is lower-cased where asked. A word's hash is a polynomial over random
64-bit byte values modulo 2^64, finished by a bijective mixer, so equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Byte classes that end a word: white space, or all ASCII but letters and digits.
SPACES = _SPACE
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        table = np.full(max(n, SLICE_BYTES * 5 // 4), base, np.uint64)
        table[0] = 1
        have = np.multiply.accumulate(table)
        if n <= SLICE_BYTES * 2:
            _powers[name] = have
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int32)
    return at.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of rows with about `most` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of rows [lo, hi): byte ranges in `data`, hashes, and each row's first word in `first`."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lo: int, hi: int, fold: bool, breaks: np.ndarray = SPACES):
        base = int(offsets[lo])
        self.data = raw = data[base:int(offsets[hi])]
        row = offsets[lo:hi + 1] - base
        n = len(raw)
        ink = ~breaks[raw]
        edge = np.zeros(n + 1, bool)
        edge[row] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = ink[:-1]
        self.start = np.flatnonzero(ink & (~before | edge[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = ink[1:]
        self.end = np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, row)
        self.count = np.diff(self.first)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTES)[raw] * _power("up", _BASE, n), out=total[1:])
        inverse = _power("down", _INVERSE, n)
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start]) if n else np.zeros(0, np.uint64)

    def rows(self) -> np.ndarray:
        """The row of each word, counted from lo."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, hash) of every run of k words in a row; with short, fewer words than k are one gram."""
        h, n = self.hash, len(self.hash)
        row = self.rows()
        out_row, out_at, out = [], [], []
        if n >= k:
            at = np.flatnonzero(row[:n - k + 1] == row[k - 1:])
            value = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                value = value * _BASE + h[j:n - k + 1 + j]
            out_row, out_at, out = [row[at]], [at], [mix(value[at] + np.uint64(k))]
        if short:
            for r in np.flatnonzero((self.count > 0) & (self.count < k)):
                value = np.uint64(0)
                with np.errstate(over="ignore"):
                    for x in h[self.first[r]:self.first[r + 1]]:
                        value = value * _BASE + x
                    out.append(mix(np.array([value + np.uint64(int(self.count[r]))], np.uint64)))
                out_row.append(np.array([r]))
                out_at.append(np.array([self.first[r]]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(out_row), np.concatenate(out_at), np.concatenate(out)

    def long_grams(self, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words in a row, by prefix sums; for large k. second: another hash."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        row = self.rows()
        at = np.flatnonzero(row[:n - k + 1] == row[k - 1:])
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((mix(self.hash + np.uint64(1)) if second else self.hash) * _power("up", _BASE, n), out=total[1:])
        return at, mix((total[at + k] - total[at]) * _power("down", _INVERSE, n)[at] + np.uint64(k))

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the distinct k-word shingles of each row, sorted; a row of fewer words has one."""
        row, _, value = self.grams(k, short=True)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        return row[new], value[new]

    def text_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit keys of each row's word sequence."""
        rows = len(self.count)
        place = np.arange(len(self.hash), dtype=np.uint64) - np.repeat(self.first[:-1], self.count).astype(np.uint64)
        a, b = mix(self.hash + place * np.uint64(0xD6E8FEB86659FD93)), mix(self.hash * np.uint64(0xC2B2AE3D27D4EB4F) + mix(place))
        out = []
        for x in (a, b):
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x, out=total[1:])
            out.append(mix(total[self.first[1:]] - total[self.first[:-1]] + self.count.astype(np.uint64)) if rows else np.zeros(0, np.uint64))
        return out[0], out[1]
