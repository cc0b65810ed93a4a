"""64-bit hashes of many byte or character runs at once, as array operations.

A run's hash is a polynomial in a fixed odd base modulo 2**64, taken from
running sums and mixed at the end; one table of powers serves all operators.
"""

from __future__ import annotations

import numpy as np

_BASE = 0xD1342543DE82EF95
_BASES = (_BASE, pow(_BASE, -1, 1 << 64))
_TABLES: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers, one for each symbol."""
    return scramble(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def powers(n: int) -> list[np.ndarray]:
    """The first n or more powers of the base and of its inverse."""
    if len(_TABLES[0]) < n:
        for k, base in enumerate(_BASES):
            t = np.full(n, base, dtype=np.uint64)
            t[0] = 1
            _TABLES[k] = np.cumprod(t)
    return _TABLES


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start[i]:end[i]] for each i; the same run has the same hash anywhere."""
    return run_hasher(values)(start, end)


def run_hasher(values: np.ndarray):
    """A function (start, end, salt) of the runs of one array."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])

    def hashed(start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return scramble((sums[end] - sums[start]) * down[start] + ((end - start).astype(np.uint64) if not salt else np.uint64(salt)))

    return hashed
