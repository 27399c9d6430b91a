"""Distances between runs of great-circle arcs, in numpy."""

from __future__ import annotations

import numpy as np


def points(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Unit vectors of positions in degrees."""
    lo, la = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=-1)


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angle between unit vectors; exactly 0 for equal ones."""
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(axis=-1))


def cap(v: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and reach of a cap that holds the arcs between the points; one wider than a hemisphere reaches everything."""
    total = v.sum(axis=0)
    size = np.linalg.norm(total)
    if size <= 1e-9:
        return np.array([1.0, 0.0, 0.0]), 3.2
    reach = float(angle(np.broadcast_to(total / size, v.shape), v).max())
    return total / size, reach if reach < 1.5 else 3.2


def _to_arcs(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angle from points to arcs a-b, all by all."""
    n = np.cross(a, b)
    size = np.linalg.norm(n, axis=1)
    inside = (size > 0) & (p @ np.cross(n, a).T >= 0) & (p @ np.cross(n, b).T <= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        across = np.arcsin(np.minimum(np.abs(p @ n.T) / size, 1.0))
    ends = np.minimum(angle(p[:, None], a[None]), angle(p[:, None], b[None]))
    # An end is never nearer than the arc, and exactly 0 away from itself.
    return np.minimum(np.where(inside, across, np.inf), ends)


def crossing(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Where arcs a-b properly cross arcs c-d (all shorter than half a turn), all by all.

    Arcs on one great circle give side products that are only rounding noise, so the arcs must also be near enough
    for a common point: their middles no further apart than their two half lengths.
    """
    n, m = np.cross(a, b), np.cross(c, d)
    sc, sd = n @ c.T, n @ d.T
    sa, sb = a @ m.T, b @ m.T
    reach = (angle(a, b)[:, None] + angle(c, d)[None]) / 2 + 1e-9
    return (sc * sd < 0) & (sa * sb < 0) & (sc * sb > 0) & (angle((a + b)[:, None], (c + d)[None]) <= reach)


def least_distance(first: np.ndarray, second: np.ndarray) -> float:
    """Smallest angle between two runs of arcs, each ``(arcs, 6)`` of start and end: zero where any cross, else at some end point."""
    a, b, c, d = first[:, :3], first[:, 3:], second[:, :3], second[:, 3:]
    if crossing(a, b, c, d).any():
        return 0.0
    return float(min(_to_arcs(a, c, d).min(), _to_arcs(b, c, d).min(), _to_arcs(c, a, b).min(), _to_arcs(d, a, b).min()))
