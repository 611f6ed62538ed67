"""Vectorised hashes of words and word parts: prefix sums of a polynomial hash, so any span costs two look-ups."""

from __future__ import annotations

import numpy as np

BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n at least; kept by each worker."""
    if len(_powers[0]) < n:
        for slot, base in enumerate((BASE, _INVERSE)):
            grown = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            grown[0] = 1
            _powers[slot] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """Hashes of spans of one sequence of codes (bytes or code points)."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        if codes.dtype == np.uint8:
            coded = mix(np.arange(1, 257, dtype=np.uint64))[codes]
        else:
            coded = mix(codes.astype(np.uint64) + np.uint64(1))
        np.cumsum(coded * up[: len(codes)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
