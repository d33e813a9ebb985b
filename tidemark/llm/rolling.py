"""Hashes of all windows of a byte string, by one running sum."""

from __future__ import annotations

import numpy as np

BASE = 0x5851F42D4C957F2D
#: Windows that are hashed at once.
STEP = 1 << 20
_SPREAD = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(BASE, STEP + 1024), _powers(pow(BASE, -1, 1 << 64), STEP + 1024)


def rolling(part: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash for each of the len(part) - window + 1 windows of at most STEP + 1,023 bytes; equal windows have equal hashes."""
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_SPREAD[part] * _UP[: len(part)], dtype=np.uint64, out=sums[1:])
    rolled = (sums[window:] - sums[:-window]) * _DOWN[: len(part) - window + 1]
    rolled = (rolled ^ rolled >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return rolled ^ rolled >> np.uint64(32)
