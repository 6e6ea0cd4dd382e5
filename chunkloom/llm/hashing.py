"""Vectorised hashes over the bytes of an Arrow batch: any substring's hash from two prefix sums."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SIGNS = np.random.Generator(np.random.PCG64(20_240_601)).integers(0, 1 << 64, 256, dtype="uint64")
_LOWERED = _SIGNS.copy()
_LOWERED[65:91] = _SIGNS[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=3)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, "uint64"), np.full(n, _INVERSE, "uint64")
    up[0] = down[0] = 1
    return np.cumprod(up, dtype="uint64"), np.cumprod(down, dtype="uint64")


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Substrings:
    """Hashes of substrings of ``data``; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, lowered: bool = False):
        n = len(data)
        size = 1 << max(21, int(n).bit_length())
        self.up, self.down = (p[:n + 1] for p in _powers(size))
        self.sums = np.zeros(n + 1, "uint64")
        np.cumsum((_LOWERED if lowered else _SIGNS)[data] * self.up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype("uint64"))

    def all(self, size: int) -> np.ndarray:
        """Hashes of all substrings of one size."""
        h = self.sums[size:] - self.sums[:-size]
        h *= self.down[:len(h)]
        h += np.uint64(size)
        return mixed(h)


def text_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts run together, and the offsets of the texts; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    offsets = np.frombuffer(filled.buffers()[1], "int64")[filled.offset:filled.offset + len(filled) + 1]
    body = filled.buffers()[2]
    data = np.frombuffer(body, "uint8") if body is not None else np.zeros(0, "uint8")
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of the first word of each text (and past the last)."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_TURNS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(column, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``size`` words, A-Z lower-cased.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    data, offsets = text_column(column)
    starts, ends, bounds = words(data, offsets)
    hashed = Substrings(data, lowered=True).of(starts, ends) if len(starts) else np.zeros(0, "uint64")

    def sequence(parts: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(parts[0]), len(parts), "uint64")
        for i, part in enumerate(parts):
            total = mixed(total * _TURNS[i % len(_TURNS)] + part)
        return total

    every = sequence([hashed[i:len(hashed) - size + 1 + i] for i in range(size)]) if len(hashed) >= size else hashed[:0]
    out = []
    for a, z in zip(bounds[:-1], bounds[1:]):
        if z - a >= size:
            out.append(np.unique(every[a:z - size + 1]))
        elif z > a:
            out.append(sequence([hashed[i:i + 1] for i in range(a, z)]))
        else:
            out.append(hashed[:0])
    return out
