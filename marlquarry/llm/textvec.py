"""Words of whole Arrow batches with numpy: bounds and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: The ASCII white space that separates words, and an odd base for the rolling hash.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODES = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_SEP = np.zeros(256, dtype=bool)
_SEP[list(SEPARATORS)] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a string column of about limit bytes each (one row at least), with their first row's number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    ends = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=float))).astype(np.int64)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, column.slice(start, stop - start)
        start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8)[offs[0] : offs[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a slice of texts: first[i]:first[i + 1] are those of row i."""

    def __init__(self, column: pa.Array, lower: bool = True):
        data, offs = raw(column)
        inside = ~_SEP[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offs] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.data, self.offs, self.lower = data, offs, lower
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans start:end."""
        if self._sums is None:
            up, _ = _power_tables(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, dtype=U64)
            np.cumsum((_LOWER if self.lower else _CODES)[self.data] * up[:-1], out=sums[1:])
            self._sums = sums
        _, down = _power_tables(len(self.data) + 1)
        return mix((self._sums[end] - self._sums[start]) * down[start])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def rows(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def shingles(self, k: int) -> list[np.ndarray]:
        """Sorted distinct hashes of the k-word shingles of each row; fewer than k words make one shingle."""
        h = self.hashes()
        n = len(h)
        step = mix(np.arange(1, k + 1, dtype=U64))
        m = max(0, n - k + 1)
        window = np.zeros(m, dtype=U64)
        for j in range(k):
            window = mix(window + h[j : j + m] * (step[j] | U64(1)))
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(window[a : b - k + 1]))
            elif b > a:
                x = np.zeros(1, dtype=U64)
                for j in range(b - a):
                    x = mix(x + h[a + j : a + j + 1] * (step[j] | U64(1)))
                out.append(mix(x ^ U64(b - a)))
            else:
                out.append(np.zeros(0, dtype=U64))
        return out
