"""Words of whole Arrow text columns as arrays: spans, 64-bit hashes, hashes of word runs.

A chunk of rows is treated as one byte array, so the work per word is a few vector operations instead of
Python calls. Hashes are polynomial prefix sums over random byte codes; any run of words costs one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_BYTE_CODES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_RUN_BASE = np.uint64(0xD6E8FEB86659FD93)

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: digits, a-z and everything outside ASCII (after LOWER).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of words between ASCII white space.
VISIBLE = np.ones(256, bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 2**64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(int(base), 1 << max(20, int(n + 1).bit_length()))


def prefix_sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums whose differences, times the inverse power of the start, are hashes of runs."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _tables(base, len(values))[0][: len(values)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _tables(base, len(sums))[1][start])


class Chunk:
    """Rows ``first`` to ``last`` of a text column and their words, which are found when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, word_bytes: np.ndarray):
        self.data, self.offsets, self.first, self.rows = data, offsets, first, len(offsets) - 1
        self._word_bytes = word_bytes

    @cached_property
    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = self.data, self.offsets
        inside = self._word_bytes[data]
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        return np.flatnonzero(inside & (~before | border[:-1])), np.flatnonzero(inside & (~after | border[1:])) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._spans[0]

    @property
    def ends(self) -> np.ndarray:
        return self._spans[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Words of row r are those from word_offsets[r] to word_offsets[r + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def word_hashes(self) -> np.ndarray:
        sums = prefix_sums(_BYTE_CODES[self.data], _BASE)
        return run_hashes(sums, self.starts, self.ends, _BASE)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def window_starts(word_offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``length`` words inside one row, and the row of each."""
    counts = np.maximum(np.diff(word_offsets) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return word_offsets[:-1][rows] + within, rows


class Runs:
    """Hashes of runs of consecutive words, given one hash per word."""

    def __init__(self, hashes: np.ndarray):
        self._sums = prefix_sums(hashes, _RUN_BASE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return run_hashes(self._sums, start, end, _RUN_BASE)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, word_bytes: np.ndarray, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column into chunks of whole rows of about ``size`` bytes (a longer row is a chunk of its own)."""
    data, offsets = raw_text(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        part = data[offsets[first] : offsets[last]]
        yield Chunk(LOWER[part] if lower else part, offsets[first : last + 1] - offsets[first], first, word_bytes)
        first = last


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
