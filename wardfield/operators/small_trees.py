"""Trees of few clusters, each finished by one task: a bounded group, so no round of its own for every handful of merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .nearest import grown

# Clusters of a tree up to which one task merges the rest of it, smallest pair first; and of vectors, up to which it merges what is each other's nearest.
FEW, LARGE = 128, 32_768
MERGED = "scenario string, alpha_step int, round int, left bigint, right bigint, height double, dw0 double, dw1 double"
_NAMES = [f.split()[0] for f in MERGED.split(", ")]


def _table(tree: tuple[str, int], merges: list[tuple]) -> pa.Table:
    cols = list(zip(*merges)) if merges else [[]] * 6
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    return pa.table([pa.array([tree[0]] * len(merges), pa.string()), pa.array([tree[1]] * len(merges), pa.int32()),
                     *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=_NAMES)


def _merge_all(ids: np.ndarray, h: np.ndarray, first: int, growths, join) -> list[tuple]:
    """Merge the pair of the smallest Ward value, ties to the smallest ids, until one is left.

    ``growths()`` gives the growth of both inertias and the Ward value for all pairs, ``join(a, b)`` puts b into a.
    """
    out, alive = [], np.ones(len(ids), bool)
    for step in range(len(ids) - 1):
        dw0, dw1, ward = growths()
        ward = np.where(np.triu(alive[:, None] & alive[None], 1), ward, np.inf)
        a, b = divmod(int(ward.argmin()), len(ids))
        if not np.isfinite(ward[a, b]):
            break
        h[a] = max(ward[a, b], h[a], h[b])
        out.append((first + step, int(ids[a]), int(ids[b]), float(h[a]), float(dw0[a, b]), float(dw1[a, b])))
        join(a, b)
        alive[b] = False
    return out


def finish_pairs(state: DataFrame, first_round: int) -> DataFrame:
    """The merges that are left in a pair state of :mod:`wardfield.operators.ward`, whose trees have at most FEW clusters."""
    def run(rows: pa.Table) -> pa.Table:
        tree = rows["scenario"][0].as_py(), rows["alpha_step"][0].as_py()
        alpha = tree[1] / 100.0
        alive = rows["alive"].to_numpy()
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        ids = np.sort(a[alive])
        n = len(ids)
        order = np.searchsorted(ids, a[alive])
        w, t0, t1, h = (np.empty(n) for _ in range(4))
        for c, x in (("w", w), ("s0", t0), ("s1", t1), ("h", h)):
            x[order] = rows[c].to_numpy()[alive]
        s0, s1 = np.full((n, n), np.nan), np.full((n, n), np.nan)
        x, y = np.searchsorted(ids, a[~alive]), np.searchsorted(ids, b[~alive])
        for c, m in (("s0", s0), ("s1", s1)):
            v = rows[c].to_numpy()[~alive]
            m[x, y] = v
            m[y, x] = v

        def growths():
            both = w[:, None] + w[None]
            d0 = (t0[:, None] + t0[None] + s0) / both - (t0 / w)[:, None] - (t0 / w)[None]
            d1 = (t1[:, None] + t1[None] + s1) / both - (t1 / w)[:, None] - (t1 / w)[None]
            ward = (1 - alpha) * d0 + alpha * d1
            return d0, d1, np.where(np.isnan(ward), np.inf, ward)

        def join(p, q):
            for t, s in ((t0, s0), (t1, s1)):
                t[p] += t[q] + s[p, q]
                s[p] = s[p] + s[q]
                s[:, p] = s[p]
            w[p] += w[q]

        return _table(tree, _merge_all(ids, h, first_round, growths, join))

    return state.groupBy("scenario", "alpha_step").applyInArrow(run, MERGED)


def stretched(scale: tuple[float, float], split: int, alpha_step: int) -> np.ndarray:
    """Factor of each entry that makes the squared mix of both distances one squared length."""
    alpha = alpha_step / 100.0
    return np.sqrt(np.r_[np.full(split, (1 - alpha) / scale[0] ** 2), np.full(3, alpha / scale[1] ** 2)])


def finish_vectors(clusters: DataFrame, split: int, scales: dict[str, tuple[float, float]], first_round: int) -> DataFrame:
    """The same for ``clusters(scenario, alpha_step, unit, w, z, h)``, sums of vectors, with at most LARGE clusters a tree."""
    few = FEW

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("unit").combine_chunks()
        tree = rows["scenario"][0].as_py(), rows["alpha_step"][0].as_py()
        alpha, scale = tree[1] / 100.0, scales[tree[0]]
        ids, w, h = (rows[c].to_numpy().copy() for c in ("unit", "w", "h"))
        z = rows["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).copy()
        out, step = [], first_round
        for left, right, ward, (ids, w, z, h) in grown(ids, w, z, h, stretched(scale, split, tree[1]), few):
            if not len(left):
                continue
            gap = z[left] / w[left, None] - z[right] / w[right, None]
            half = w[left] * w[right] / (w[left] + w[right])
            dw0, dw1 = ((part * part).sum(1) * half / s ** 2 for part, s in ((gap[:, :split], scale[0]), (gap[:, split:], scale[1])))
            out.append(_table(tree, list(zip([step] * len(left), ids[left].tolist(), ids[right].tolist(), np.maximum(ward, np.maximum(h[left], h[right])).tolist(),
                                             dw0.tolist(), dw1.tolist()))))
            step += 1

        def squares(v):
            d = np.zeros((len(v), len(v)))
            for k in range(v.shape[1]):
                gap = v[:, k, None] - v[None, :, k]
                d += gap * gap
            return d

        def growths():
            mean = z / w[:, None]
            half = w[:, None] * w[None] / (w[:, None] + w[None])
            d0 = squares(mean[:, :split]) * half / scale[0] ** 2
            d1 = squares(mean[:, split:]) * half / scale[1] ** 2
            return d0, d1, (1 - alpha) * d0 + alpha * d1

        def join(p, q):
            w[p] += w[q]
            z[p] += z[q]

        return pa.concat_tables([*out, _table(tree, _merge_all(ids, h, step, growths, join))])

    return clusters.groupBy("scenario", "alpha_step").applyInArrow(run, MERGED)
