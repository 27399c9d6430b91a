"""Vectors in the order of a space-filling curve: what is near in the order is near in space.

Sorting by the code is a range-partitioned sort, so cells and neighbours of any number of vectors come from
consecutive rows, without comparing all pairs.
"""

from __future__ import annotations

import numpy as np

# Axes of the curve; longer vectors are projected onto this many random directions.
AXES = 7
SEED = 20


def directions(size: int) -> np.ndarray | None:
    """Orthonormal directions for vectors longer than AXES, always the same ones."""
    if size <= AXES:
        return None
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, AXES)))
    return q


def codes(v: np.ndarray, low: np.ndarray, high: np.ndarray, shift: float = 0.0) -> np.ndarray:
    """Code of each row of ``v``, whose columns lie in [low, high]; ``shift`` (a share of the range) moves the grid.

    Bits of all axes are interleaved from the highest down, 63 in all. A missing entry counts as the middle.
    """
    span = np.where(high > low, high - low, 1.0)
    u = np.where(np.isfinite(v), (v - low) / span, 0.5)
    turn = directions(v.shape[1])
    if turn is not None:
        u = 0.5 + (u - 0.5) @ turn / np.sqrt(v.shape[1])
    bits = 63 // max(1, u.shape[1])
    cell = np.floor(np.clip((u + shift) / 2, 0, 1 - 2.0**-40) * 2.0**bits).astype(np.uint64)
    out = np.zeros(len(u), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(u.shape[1]):
            out = out << np.uint64(1) | (cell[:, axis] >> np.uint64(bit) & np.uint64(1))
    return out.view(np.int64)
