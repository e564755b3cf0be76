"""Rolling 64-bit hashes in numpy: of all slices of a sequence, from one running sum."""

from __future__ import annotations

import numpy as np

#: A value for each byte, from a fixed seed: all executors draw alike.
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
#: Odd numbers, and with them their inverses modulo 2^64.
_BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_powers: dict[int, np.ndarray] = {}
#: Powers of more places than this are not kept.
_KEPT = 4 << 20


def _power(number: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1."""
    known = _powers.get(number)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), number, np.uint64)
        known[0] = 1
        known = np.cumprod(known)
        if n <= _KEPT:
            _powers[number] = known
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of slices of ``values``; ``base`` chooses one of three independent families."""

    def __init__(self, values: np.ndarray, base: int):
        number, inverse = _BASES[base]
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * _power(number, len(values)), dtype=np.uint64, out=self.sums[1:])
        self.inverse = _power(inverse, len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
