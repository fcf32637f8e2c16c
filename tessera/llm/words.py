"""Words and word hashes of many texts at once, with numpy inside a task.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its 64-bit hash is a polynomial over its bytes,
taken as a difference of prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            up, down = (np.full(size, np.uint64(x)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA5CB9243F3ECE94D)
        return x ^ (x >> np.uint64(32))


def words(raw: np.ndarray, off: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word of the rows that lie end to end in ``raw``.

    ``solid`` marks the bytes of words where another rule than the module's holds.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    if solid is None:
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        code = mix((sums[end] - sums[start]) * down[start])
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    return start, end, row, code


def grams(code: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, at each word; and where such a run lies in one text."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total = total * np.uint64(0xC2B2AE3D27D4EB4F) + code[i : i + n]
    return mix(total), row[:n] == row[k - 1 :]
