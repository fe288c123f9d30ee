"""Vectorised text work on numpy arrays: words and rolling hashes of whole
Arrow batches without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64
    finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Hash of any substring of a sequence of symbols from prefix sums:
    sum(value(symbol) * B^i) modulo 2^64, shifted to i = 0 and mixed with the
    length.  ``values`` gives each symbol a random 64-bit number."""

    BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, U64)
    _inverse = np.ones(1, U64)

    def __init__(self, symbols: np.ndarray, values: np.ndarray):
        n = len(symbols)
        if len(Rolling._powers) < n + 1:
            size = max(2 * n, 1 << 16)
            Rolling._powers = _geometric(self.BASE, size)
            Rolling._inverse = _geometric(pow(self.BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values[symbols] * Rolling._powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * Rolling._inverse[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def random_values(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of the rows in them) of a string column; null is
    empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def row_chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes; a larger row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def runs(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``, cut at ``breaks``
    (positions where a new row begins)."""
    before = np.empty(len(inside), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[breaks[breaks < len(inside)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    cut = breaks[(breaks > 0) & (breaks <= len(inside))] - 1
    after[cut] = False
    return start, np.flatnonzero(inside & ~after) + 1
