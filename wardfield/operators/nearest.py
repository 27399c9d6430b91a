"""Exact nearest neighbours of clusters by Ward value without looking at all pairs.

Clusters are halved along their widest axis until a cell holds a few dozen. A cell has a box and a least weight, which bound the Ward
value of any cluster in it from below; a cell is looked into only if that bound does not exceed the best value known for a cluster that
asks. Ties go to the smallest id, and a value is the same from both of its ends, so two clusters agree on being each other's nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Clusters in a cell; cells looked into before bounds are compared again, at first and at most.
CELL, FIRST, MOST = 64, 4, 16


def halved(v: np.ndarray) -> np.ndarray:
    """An order of the rows in which every CELL consecutive ones lie together."""
    order, open_ = np.arange(len(v)), [(0, len(v))]
    while open_:
        a, b = open_.pop()
        if b - a <= CELL:
            continue
        part = v[order[a:b]]
        axis = int((part.max(0) - part.min(0)).argmax())
        half = CELL * (-(-(b - a) // CELL) // 2)
        order[a:b] = order[a:b][np.argpartition(part[:, axis], half)]
        open_ += [(a, a + half), (a + half, b)]
    return order


@dataclass
class Cells:
    """Clusters in cells: ids, weights, stretched mean vectors and their squared lengths, a row a cell; boxes and least weights.

    ``order`` has the clusters' places in what the cells were made of. The last cell is filled up with entries of infinite length.
    """
    order: np.ndarray
    ids: np.ndarray
    w: np.ndarray
    v: np.ndarray
    norm: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, w: np.ndarray, v: np.ndarray) -> Cells:
        order = halved(v)
        return cls.ordered(order, ids[order], w[order], v[order])

    @classmethod
    def ordered(cls, order: np.ndarray, ids: np.ndarray, w: np.ndarray, v: np.ndarray) -> Cells:
        at, fill = np.arange(0, len(ids), CELL), -len(ids) % CELL

        def rows(c: np.ndarray, rest) -> np.ndarray:
            return np.concatenate([c, np.full((fill, *c.shape[1:]), rest, c.dtype)]).reshape(-1, CELL, *c.shape[1:])

        return cls(order, rows(ids, -1), rows(w, 1.0), rows(v, 0.0), rows((v * v).sum(1), np.inf),
                   np.minimum.reduceat(v, at), np.maximum.reduceat(v, at), np.minimum.reduceat(w, at))

    def unknown(self) -> tuple[np.ndarray, np.ndarray]:
        """No nearest neighbour yet: infinite values and no ids, in cells; what fills up the last cell asks for nothing."""
        best = np.full(self.ids.shape, np.inf)
        best.ravel()[len(self.order):] = -np.inf
        return best, np.full(self.ids.shape, -1, np.int64)


def least_values(a: Cells, b: Cells) -> np.ndarray:
    """The least Ward value that two cells' boxes allow, for all pairs; a little less, for rounding."""
    d = np.zeros((len(a.lo), len(b.lo)))
    for k in range(a.lo.shape[1]):
        gap = np.maximum(b.lo[:, k] - a.hi[:, k, None], a.lo[:, k, None] - b.hi[:, k])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        d += gap
    return d * (a.least[:, None] * b.least / (a.least[:, None] + b.least)) * (1 - 1e-9)


def _best_of(v, w, norm, limit, own, ids, base: Cells, cells: np.ndarray):
    """For clusters whose nearest in ``cells`` has a value of at most ``limit``: place, value, and id of the nearest, ties to the smallest.

    A product of matrices finds the few that may be nearest; their values are then taken from differences, alike from both ends.
    ``own`` has the clusters' places in ``base``, if they are there.
    """
    u, x, length = base.v[cells].reshape(-1, v.shape[1]), base.w[cells].ravel(), base.norm[cells].ravel()
    m = (-2 * v) @ u.T
    m += norm[:, None]
    m += length
    m *= x
    m /= w[:, None] + x
    if own is not None:
        slot = np.full(len(base.ids), -1)
        slot[cells] = np.arange(len(cells))
        at = slot[own // CELL]
        here = np.flatnonzero(at >= 0)
        m[here, at[here] * CELL + own[here] % CELL] = np.inf
    slack = 1e-13 * (norm + length.max(where=np.isfinite(length), initial=0.0))
    i, j = np.nonzero(m <= np.minimum(m.min(1) + 2 * slack, limit / w * (1 + 1e-12) + slack)[:, None])
    fine = np.isfinite(m[i, j])
    i, j = i[fine], j[fine]
    gap = v[i] - u[j]
    value = (gap * gap).sum(1) * (w[i] * x[j] / (w[i] + x[j]))
    other = base.ids[cells].ravel()[j]
    order = np.lexsort((other, value, i))
    i, value, other = i[order], value[order], other[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    return i[first], value[first], other[first]


def search(ask: Cells, base: Cells, best: np.ndarray, nbr: np.ndarray, own: np.ndarray | None = None) -> None:
    """Improve the smallest value ``best`` and the id ``nbr`` it belongs to of each cluster of ``ask`` by the clusters of ``base``.

    ``own`` has the places of ``ask`` in ``base`` where the one is part of the other, as no cluster is its own neighbour.
    """
    bound = least_values(ask, base)
    top = best.max(1)
    for i in np.flatnonzero(bound.min(1) <= top):
        cells = np.flatnonzero(bound[i] <= top[i])
        cells = cells[np.argsort(bound[i, cells], kind="stable")]
        least, take = bound[i, cells], FIRST
        done = 0
        while done < len(cells):
            mine = np.flatnonzero(best[i] >= least[done])
            if not len(mine):
                break
            at, value, who = _best_of(ask.v[i, mine], ask.w[i, mine], ask.norm[i, mine], best[i, mine], None if own is None else own[i, mine],
                                      ask.ids[i, mine], base, cells[done:done + take])
            at = mine[at]
            better = (value < best[i, at]) | ((value == best[i, at]) & (who < nbr[i, at]))
            best[i, at[better]], nbr[i, at[better]] = value[better], who[better]
            done, take = done + take, MOST


def places(order: np.ndarray) -> np.ndarray:
    """Where each row of what cells were made of stands in the cells."""
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    return at


def grown(ids: np.ndarray, w: np.ndarray, z: np.ndarray, h: np.ndarray, factor: np.ndarray, few: int) -> Iterator[tuple]:
    """Merge all clusters that are each other's nearest, round by round, until at most ``few`` are left.

    Clusters in the order of their ids, ``z`` their vector sums. Yields after each round (places of the left ones, of the right ones,
    Ward values, and the clusters (ids, w, z, h) before it); the last item has no merges and the clusters that are left.

    Ward linkage is reducible: what two other clusters form is no nearer than the nearer of both. So the nearest neighbour of a cluster
    stays the nearest until one of the two merges, and only clusters that have lost theirs, and new ones, ask again.
    """
    best, nbr = np.full(len(ids), np.inf), np.full(len(ids), -1, np.int64)
    open_ = np.ones(len(ids), bool)
    while len(ids) > few:
        v = z / w[:, None] * factor
        base = Cells.of(ids, w, v)
        at = np.flatnonzero(open_)
        ask = Cells.of(ids[at], w[at], v[at])
        value, who = ask.unknown()
        own = np.zeros(ask.ids.size, np.int64)
        own[:len(at)] = places(base.order)[at[ask.order]]
        search(ask, base, value, who, own.reshape(ask.ids.shape))
        best[at[ask.order]], nbr[at[ask.order]] = value.ravel()[:len(at)], who.ravel()[:len(at)]
        known = np.isfinite(best)
        to = np.where(known, np.searchsorted(ids, nbr), 0)
        left = np.flatnonzero(known & (ids < nbr) & (nbr[to] == ids))
        right = to[left]
        if not len(left):
            if open_.all():
                raise ValueError("no clusters to merge: a vector has missing entries")
            open_[:] = True  # values that are equal but for rounding: all ask
            continue
        ward = best[left]
        yield left, right, ward, (ids, w, z, h)
        w, z, h = w.copy(), z.copy(), h.copy()
        h[left] = np.maximum(ward, np.maximum(h[left], h[right]))
        w[left] += w[right]
        z[left] += z[right]
        moved = np.zeros(len(ids), bool)
        moved[left] = moved[right] = True
        open_ = moved | ~known | moved[to]
        keep = np.ones(len(ids), bool)
        keep[right] = False
        ids, w, z, h, best, nbr, open_ = (c[keep] for c in (ids, w, z, h, best, nbr, open_))
    none = np.empty(0, int)
    yield none, none, np.empty(0), (ids, w, z, h)
