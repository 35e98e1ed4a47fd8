"""Vectorised word kernels over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All kernels
work on the UTF-8 buffer of a slice of rows at once, so the cost per row is
small, and slices are cut at about ``SLICE_BYTES`` so that memory stays
bounded whatever the batch size is (a single longer text is one slice).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCT = _SPACE.copy()
_PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit multipliers, a function of the seed alone."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(steps + np.uint64(seed)) | np.uint64(1)


#: byte multipliers of each family of word hashes
_SEEDS = (11, 5_000_011)
_POWERS = [constants(256, seed) for seed in _SEEDS]


def _powers(n: int, family: int) -> np.ndarray:
    if n > len(_POWERS[family]):
        _POWERS[family] = constants(2 * n, _SEEDS[family])
    return _POWERS[family]


class Words:
    """The words of a slice of rows; with ``punct`` ASCII punctuation separates words too.

    ``start``/``end`` are byte positions in ``data``; ``row_first[i]`` is the
    index of row i's first word and ``row_first[-1]`` the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, punct: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        solid = ~(_PUNCT if punct else _SPACE)[data]
        first = solid.copy()
        if len(solid):
            first[1:] &= ~solid[:-1]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        first[edge] = solid[edge]
        self.start = np.flatnonzero(first)
        last = solid.copy()
        if len(solid):
            last[:-1] &= ~solid[1:]
        last[edge - 1] = solid[edge - 1]
        self.end = np.flatnonzero(last) + 1
        self.row_first = np.searchsorted(self.start, offsets)
        self._solid = solid

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.row_first)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.row_first) - 1), self.counts())

    def hashes(self, family: int = 0) -> np.ndarray:
        """One 64-bit hash for each word; families are independent."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.start
        powers = _powers(int(size.max()), family)
        at = np.flatnonzero(self._solid)
        within = at - np.repeat(self.start, size)
        with np.errstate(over="ignore"):
            parts = (self.data[at].astype(np.uint64) + np.uint64(1)) * powers[within]
            firsts = np.concatenate(([0], np.cumsum(size)[:-1]))
            return mix64(np.add.reduceat(parts, firsts) + size.astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values of h; the last n-1 are missing.

    Runs may cross rows; callers mask those.  Built by doubling, so it costs
    about 2*log2(n) passes.
    """
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    base = np.uint64(0x9E6C63D0876A3F6B)
    with np.errstate(over="ignore"):
        done, have, out = 0, None, None
        power, width, mult = h, 1, base
        left = n
        while True:
            if left & 1:
                if out is None:
                    out, have = power, width
                else:
                    m = len(h) - (have + width) + 1
                    out, have = out[:m] * mult + power[have : have + m], have + width
                done += width
            left >>= 1
            if not left:
                break
            m = len(h) - 2 * width + 1
            power = power[:m] * mult + power[width : width + m]
            width, mult = 2 * width, mult * mult
        return mix64(out)


def run_starts(words: Words, n: int) -> np.ndarray:
    """Mask over the len-n+1 runs of n words: true where a run lies in one row."""
    m = max(0, len(words) - n + 1)
    ok = np.zeros(m, dtype=bool)
    if not m:
        return ok
    rows = words.rows()
    return rows[:m] == rows[n - 1 :]


def slices(column: pa.Array, lower: bool = False, punct: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over slices of a string column; null rows have no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower, punct)
        at = to


class HashSet:
    """Membership and position in a sorted set of 64-bit hashes; a bit table rejects most misses."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.uint64))
        bits = max(16, int(len(self.values)).bit_length() + 4)
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[self.values & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, index into values) of all members."""
        maybe = np.flatnonzero(self.table[h & self.mask])
        at = np.searchsorted(self.values, h[maybe])
        ok = at < len(self.values)
        ok[ok] = self.values[at[ok]] == h[maybe[ok]]
        return maybe[ok], at[ok]
