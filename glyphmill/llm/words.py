"""Words of whole Arrow text columns, their hashes and those of word n-grams, in numpy.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Hashes have 64 bits: a polynomial over the
word's bytes with a random value for each byte, mixed; n-grams combine the hashes of their words in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_random = np.random.default_rng(20240229)
_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_BASE = int(_random.integers(1 << 40, 1 << 62)) * 2 + 1
_STEP = int(_random.integers(1 << 40, 1 << 62)) * 2 + 1
_MASK = (1 << 64) - 1

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Bytes hashed at once; keeps the arrays in the CPU's caches.
BLOCK = 1 << 19

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64, or of its inverse."""
    known = _powers.get((base, inverse))
    if known is None or len(known) < n:
        size = max(n, 1 << 12)
        known = np.full(size, pow(base, -1, 1 << 64) if inverse else base & _MASK, np.uint64)
        known[0] = 1
        known = _powers[base, inverse] = np.multiply.accumulate(known)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that leaves no structure."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a text column: places in its bytes, and for each text the first of its words and the one after its last."""

    def __init__(self, column: pa.Array, fold: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        large = pa.types.is_large_string(column.type)
        n = len(column)
        _, ends, data = column.buffers()
        at = np.frombuffer(ends, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.texts = at - at[0]
        self.value = _FOLDED if fold else _VALUE
        inside = ~WHITE[self.bytes]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = self.texts[:-1][np.diff(self.texts) > 0]
        begins[cuts] = inside[cuts]
        ends_ = inside.copy()
        ends_[:-1] &= ~inside[1:]
        lasts = self.texts[1:][np.diff(self.texts) > 0] - 1
        ends_[lasts] = inside[lasts]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends_) + 1
        self.first = np.searchsorted(self.starts, self.texts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A hash of each word, in blocks of words that lie within BLOCK bytes."""
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            begin = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, begin + BLOCK, "right")))
            data = self.value[self.bytes[begin : self.ends[b - 1]]]
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(data * powers(_BASE, len(data)), out=sums[1:])
            s, e = self.starts[a:b] - begin, self.ends[a:b] - begin
            out[a:b] = mix((sums[e] - sums[s]) * powers(_BASE, len(data), True)[s] + (e - s).astype(np.uint64))
            a = b
        return out

    def text_of(self, start: int, end: int) -> bytes:
        return self.bytes[start:end].tobytes()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words; the order of words counts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(_STEP) + hashes[k : k + len(out)]
        return mix(out)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_STEP, len(hashes)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(_STEP, len(hashes) - n + 1, True))
