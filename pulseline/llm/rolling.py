"""Hashes of many stretches of one byte string, without a loop over bytes or stretches."""

from __future__ import annotations

import numpy as np

# An odd base of a polynomial modulo 2^64, and its inverse there.
BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from the 0th to the nth at least."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 14, 1 << n.bit_length())
        _POWERS[:] = [
            np.cumprod(np.r_[np.uint64(1), np.full(size, b, dtype=np.uint64)]) for b in (BASE, INVERSE)
        ]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a one-to-one map."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Stretches:
    """Hashes of stretches [a, b) of a byte string, equal for equal bytes wherever they stand."""

    def __init__(self, raw: np.ndarray):
        power, _ = _powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, inverse = _powers(len(self.sums))
        return mixed((self.sums[b] - self.sums[a]) * inverse[a])
