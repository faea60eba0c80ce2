"""Texts as flat byte arrays: what the operators on words and bytes work on.

All functions are vectorised over the documents of a chunk. A chunk holds whole
documents and about ``CHUNK`` bytes (a longer document is a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows' texts in the bytes); null counts as empty."""
    if pa.types.is_null(texts.type):
        texts = pa.nulls(len(texts), pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, end, flat[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base and their inverses modulo 2**64, made longer on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 1 << 16)

        def powers(b: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(b, len(out), 1 << 64))])
            return out

        self.up, self.down = powers(self.base), powers(self.inverse)


POWERS = Powers(0xC6A4A7935BD1E995)
#: A random 64-bit word for every byte, with and without A-Z lower-cased.
EXACT = np.random.default_rng(91).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWERED = EXACT.copy()
LOWERED[65:91] = EXACT[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def prefix(data: np.ndarray, values: np.ndarray = EXACT) -> np.ndarray:
    """p so that the substring [a, b) has the fingerprint (p[b] - p[a]) * POWERS.down[a]."""
    POWERS.need(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * POWERS.up[: len(data)], out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII space, and each row's first word (rows + 1)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    full = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, full[:-1]]
    after = np.r_[full[1:], False]
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of every word with A-Z lower-cased."""
    p = prefix(data, LOWERED)
    return mix((p[ends] - p[starts]) * POWERS.down[starts] + (ends - starts).astype(np.uint64) * _M)


_FACTORS = tuple(np.uint64(x | 1) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def shingles(texts: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct fingerprints) of every text's shingles of ``size`` words.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    for first, end, data, offsets in chunks(texts):
        starts, ends, at = words(data, offsets)
        w = word_prints(data, starts, ends)
        h = np.zeros(max(0, len(w) - size + 1), np.uint64)
        for k in range(size):
            h += w[k : k + len(h)] * _FACTORS[k % 5] * np.uint64(2 * (k // 5) + 1)
        h = mix(h)
        for row in range(first, end):
            a, b = at[row - first], at[row - first + 1]
            if b - a >= size:
                yield row, np.unique(h[a : b - size + 1])
            elif b > a:
                one = np.array([b - a], np.uint64)
                for k in range(a, b):
                    one = mix(one * _M + w[k : k + 1])
                yield row, one
            else:
                yield row, np.zeros(0, np.uint64)
