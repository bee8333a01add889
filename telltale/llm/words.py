"""Words of many texts at once, as 64-bit hashes, computed with whole-array operations."""

from __future__ import annotations

import numpy as np

PRIME = 0x9E3779B97F4A7C15
#: Keeps non-ASCII bytes and letters, lower-cases A-Z, and turns ASCII digits, marks and white space into blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Lower-cases A-Z and turns ASCII white space into blanks.
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes of the words of a buffer. Powers of the multiplier are kept between calls."""

    def __init__(self):
        self.power = self.back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 2 * len(self.power))
            inverse = pow(PRIME, -1, 1 << 64)
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, PRIME, np.uint64)]))
            self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse, np.uint64)]))

    def __call__(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(hashes, starts, ends)`` of the runs of bytes other than a blank."""
        data = np.frombuffer(buffer, np.uint8)
        solid = np.concatenate([[False], data != 32, [False]])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edge[::2], edge[1::2]
        self._grow(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)])])
        return mix((total[ends] - total[starts]) * self.back[starts]), starts, ends


def owners(starts: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The text of each word in a buffer that joins texts of these lengths with one byte between them."""
    tops = np.cumsum(np.array(lengths, np.int64) + 1)
    return np.searchsorted(tops, starts, side="right")
