"""Vectorised words, hashes and word windows of a batch of texts (NumPy; no loop over words).

A polynomial over the bytes, modulo 2**64, is summed once for a whole batch; the hash of any byte range is a difference
of two sums, shifted back by the inverse power of its start. Windows of words are hashed likewise over word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from broadsheet.llm import memory  # its import acts too, in every worker that looks at texts

_MASK = (1 << 64) - 1
#: Bytes of text that one vectorised step looks at; a single longer text is a step of its own.
STEP_BYTES = 1 << 20

_BASES = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93}
_table = np.random.default_rng(20240501).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
#: Longer tables of powers are made anew for the rare text that needs them.
KEPT_POWERS = 1 << 21
_powers: dict[tuple[int, int], np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size > KEPT_POWERS:
        return _new_power(base, size)[:n]
    if (base, size) not in _powers:
        _powers[base, size] = _new_power(base, size)
    return _powers[base, size][:n]


def _new_power(base: int, size: int) -> np.ndarray:
    low = np.full(4096, base, np.uint64)
    low[0] = 1
    low = np.multiply.accumulate(low)
    high = np.full(size // 4096, pow(base, 4096, 1 << 64), np.uint64)
    high[0] = 1
    high = np.multiply.accumulate(high)
    return (high[:, None] * low[None, :]).ravel()


def _power_at(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64, from two small tables."""
    top = int(at.max(initial=0))
    low = _power(base, 4096)
    step = pow(base, 4096, 1 << 64)
    high = np.full(top // 4096 + 1, step, np.uint64)
    high[0] = 1
    high = np.multiply.accumulate(high)
    return low[at & 4095] * high[at >> 12]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[s:e] for each range, independent of where the range lies."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    h = (sums[ends] - sums[starts]) * _power_at(inverse, starts)
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return range_hashes(_table[which][buf], starts, ends, _BASES[which])


def window_hashes(word_hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words; entry i is the run from word i."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n, dtype=np.int64)
    return range_hashes(word_hashes, at, at + size, _BASES[which])


class Texts:
    """A batch of texts as bytes, with the words of each.

    buf: bytes; bounds: byte offsets of the texts; starts, ends: byte offsets of the words; doc: text of each word;
    first: number of the first word of each text, and the number of words behind them all.
    """

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.buf, self.bounds = buf, bounds
        word = ~SPACE[buf]
        begins, stops = word.copy(), word.copy()
        if len(buf):
            begins[1:] &= ~word[:-1]
            stops[:-1] &= ~word[1:]
            inner = bounds[1:-1]
            inner = inner[(inner > 0) & (inner < len(buf))]
            begins[inner] = word[inner]
            stops[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), self.n_words)

    def lowered(self) -> np.ndarray:
        return LOWER[self.buf]

    def words(self, which: int = 0, lower: bool = False) -> np.ndarray:
        return byte_hashes(self.lowered() if lower else self.buf, self.starts, self.ends, which)

    def inside(self, size: int) -> np.ndarray:
        """Whether the run of ``size`` words from each word lies in one text (as long as window_hashes)."""
        n = len(self.doc) - size + 1
        return self.doc[:n] == self.doc[size - 1 :] if n > 0 else np.zeros(0, bool)

    def text(self, start: int, end: int) -> str:
        return self.buf[start:end].tobytes().decode("utf-8")


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def steps(column: pa.Array, step_bytes: int = STEP_BYTES):
    """(first row, Texts) for consecutive rows of at most about ``step_bytes`` together."""
    buf, bounds = string_bytes(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        stop = int(np.searchsorted(bounds, bounds[row] + step_bytes, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, Texts(buf[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row])
        row = stop
    memory.trim()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one after another."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
