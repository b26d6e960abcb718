"""64-bit hashes of words and of runs of words, as numpy arrays over many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers of 64 bits (Steele and Vigna, 2021), one for each independent hash of runs. Fixed values.
FACTORS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


class WordHashes(dict):
    """XXH64 of each word met so far; emptied when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix (Steele et al., 2014); its two multipliers are fixed values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of runs of words, from prefix sums modulo 2**64."""

    def __init__(self, factor: int):
        self.factor, self.inverse = factor, pow(factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, words: np.ndarray) -> np.ndarray:
        n = len(words) + 1
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            made = []
            for factor in (self.factor, self.inverse):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                made.append(np.multiply.accumulate(powers))
            self.up, self.down = made
        sums = np.zeros(n, np.uint64)
        np.cumsum(words * self.up[: n - 1], out=sums[1:])
        return sums

    def hashes(self, sums: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        size = np.asarray(size)
        return mix((sums[start + size] - sums[start]) * self.down[start] + size.astype(np.uint64) * np.uint64(self.factor))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .., one after another."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def fixed_binary(parts: list[np.ndarray]) -> pa.Array:
    """A binary column whose values are the 64-bit ``parts``, side by side, high bytes first."""
    table = np.stack(parts, 1).astype(">u8")
    size = 8 * len(parts)
    offsets = np.arange(0, (len(table) + 1) * size, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(offsets), pa.py_buffer(table)])
