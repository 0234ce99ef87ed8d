"""Hashes of substrings of a buffer, vectorised."""

from __future__ import annotations

import numpy as np

#: An odd base: powers of it can be undone modulo 2^64. Strings up to 2^10 bytes are safe from Thue-Morse collisions.
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any substring of a buffer from one running sum, modulo 2^64."""

    def __init__(self, most: int, salt: int):
        base = np.uint64(BASE + 2 * salt)
        undo = np.uint64(pow(int(base), -1, 1 << 64))
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(salt << 32))
        self.up, self.down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(most, x, np.uint64)))) for x in (base, undo))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))
