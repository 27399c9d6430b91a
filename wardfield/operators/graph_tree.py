"""Ward trees of vectors on a neighbour graph: state linear in the clusters, work linear in the edges.

A cluster is its weight and its vector sum, so the Ward value of any two clusters needs only those. A round sorts the clusters of each
tree along a space-filling curve, a range-partitioned shuffle of the clusters and of nothing else, and cuts the order into stretches. A
task links the clusters of a stretch to near ones, neighbours along several shifted curves, takes the Ward value of every edge, merges
clusters that are each other's nearest over an edge, and links what is left anew, some times over. Edges never leave their task. The next
round's curve is shifted, so the ends of stretches fall elsewhere. Once a tree has few clusters, all of them are compared: the top of the
tree, where cuts are made, has no missing link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..state import Rounds, maybe_broadcast, ship_package, written
from . import small_trees
from .extremes import largest_distance, vector_frame
from .small_trees import stretched
from .tiles import merged_vectors, nearest_clusters
from .ward import GROUP, MERGES, Steps, Tree, all_merges, by_scenario, steps_column, steps_in, unit_counts
from .zorder import codes

# Clusters of a tree from which all pairs are compared.
DENSE = 128
# Shifts of the curve, neighbours looked at on one side along it, and links a cluster keeps of each.
SHIFTS, WINDOW, LINKS = 4, 16, 6
# Clusters of a stretch; passes of a round over a tree that has more than EARLY clusters, which end when a quarter is left; one pass else.
STRETCH, PASSES, EARLY = 65_536, 8, 1_024

Scales = dict[str, tuple[float, float]]


def scales_of(units: DataFrame, split: int) -> Scales:
    """Largest feature distance and largest straight distance of places, per scenario; both found without all pairs."""
    joined = units.select("scenario", "x", "g")
    far = largest_distance(joined, "x", split, key="scenario")
    wide = largest_distance(joined, "g", 3, key="scenario")
    return {s: (far[s] or 1.0, wide[s] or 1.0) for s in far}


def _vectors(b: pa.RecordBatch, scales: Scales, split: int) -> np.ndarray:
    """Mean vectors of clusters, stretched by their tree's weight."""
    z = b.column("z").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) / b.column("w").to_numpy()[:, None]
    trees, own = _trees(b)
    return z * np.array([stretched(scales[s], split, a) for s, a in trees]).reshape(len(trees), -1)[own]


def _trees(b: pa.RecordBatch) -> tuple[list[tuple[str, int]], np.ndarray]:
    """The trees of a batch's rows, and the number of each row's tree."""
    name = b.column("scenario").dictionary_encode()
    key, own = np.unique(name.indices.to_numpy().astype(np.int64) * 1_000 + b.column("alpha_step").to_numpy(), return_inverse=True)
    return [(name.dictionary[int(k) // 1_000].as_py(), int(k) % 1_000) for k in key], own


def _placed(scales: Scales, split: int, low: np.ndarray, high: np.ndarray, shift: float):
    """Clusters with their place on the shifted curve of their tree's vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _vectors(b, scales, split)
            trees, own = _trees(b)
            code = np.empty(b.num_rows, np.int64)
            for number, t in enumerate(trees):
                mine = np.flatnonzero(own == number)
                code[mine] = codes(v[mine], *_range(scales[t[0]], split, t[1], low, high), shift)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=[*b.schema.names, "code"])
    return run


def _range(scale: tuple[float, float], split: int, alpha_step: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One range for all axes of a tree's curve: an axis that the weight makes short takes few bits."""
    factor = stretched(scale, split, alpha_step)
    span = max(float(((high - low) * factor).max()), 1e-300)
    middle = (high + low) / 2 * factor
    return middle - span / 2, middle + span / 2


def _links(v: np.ndarray, w: np.ndarray, box: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j, Ward value), i < j: each row's LINKS nearest by Ward value of the WINDOW rows on each side, along every curve."""
    n, found = len(v), []
    for shift in range(SHIFTS):
        at = np.argsort(codes(v, *box, shift / SHIFTS), kind="stable")
        u, x = v[at], w[at]
        cost = np.full((2 * WINDOW, n), np.inf)
        for lag in range(1, min(WINDOW, n - 1) + 1):
            gap = u[lag:] - u[:-lag]
            d = np.einsum("ij,ij->i", gap, gap) * x[lag:] * x[:-lag] / (x[lag:] + x[:-lag])
            cost[lag - 1, :n - lag] = d
            cost[WINDOW + lag - 1, lag:] = d
        pick = np.argpartition(cost, LINKS - 1, axis=0)[:LINKS].ravel()
        here = np.tile(np.arange(n), LINKS)
        fine = np.isfinite(cost[pick, here])
        here, pick = here[fine], pick[fine]
        there = np.where(pick < WINDOW, here + pick + 1, here - (pick - WINDOW + 1))
        i, j = at[here], at[there]
        found.append(np.minimum(i, j) * n + np.maximum(i, j))
    i, j = np.divmod(np.unique(np.concatenate(found)), n)
    gap = v[i] - v[j]
    return i, j, np.einsum("ij,ij->i", gap, gap) * w[i] * w[j] / (w[i] + w[j])


def _reciprocal(n: int, i: np.ndarray, j: np.ndarray, ward: np.ndarray, limit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are each other's nearest, ties to the first row; with ``limit`` only those up to the middle of all nearest values."""
    node, nbr, value = np.r_[i, j], np.r_[j, i], np.r_[ward, ward]
    order = np.lexsort((nbr, value, node))
    node, first = np.unique(node[order], return_index=True)
    best, near = np.full(n, -1), np.full(n, np.inf)
    best[node], near[node] = nbr[order][first], value[order][first]
    a = np.flatnonzero((best >= 0) & (best[best] == np.arange(n)) & (best > np.arange(n)))
    if limit:
        a = a[near[a] <= np.median(near[node])]
    return a, best[a]


_MERGED = "round int, left bigint, right bigint, height double, dw0 double, dw1 double"


def _stretch(tree: tuple[str, int], rows: pa.Table, whole: bool, scale: tuple[float, float], split: int, frame, step: int, few: int):
    """Merges of one stretch, the clusters left and the number of its first edges; rows in the order of their ids."""
    rows = rows.sort_by("unit").combine_chunks()
    ids, w, h = (rows[c].to_numpy().copy() for c in ("unit", "w", "h"))
    z = rows["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).copy()
    factor, box = stretched(scale, split, tree[1]), _range(scale, split, tree[1], *frame)
    early, target, edges, out, turn = len(ids) > EARLY, len(ids) // 4, 0, [], 0
    while turn < (PASSES if early else 1) and len(ids) > max(1, target if early else few if whole else 1):
        mean = z / w[:, None]
        v = mean * factor
        group, size = None, 0
        if early and not turn:  # copies are one cluster at no cost
            _, lead, group = np.unique(v, axis=0, return_index=True, return_inverse=True)
            size = len(lead)
        if group is not None and size < len(ids):
            right = np.flatnonzero(lead[group] != np.arange(len(ids)))
            left = lead[group][right]
        else:
            i, j, ward = _links(v, w, box)
            edges = edges or len(i)
            left, right = _reciprocal(len(ids), i, j, ward, not whole)
        if not len(left):
            break
        gap = mean[left] - mean[right]
        half = w[left] * w[right] / (w[left] + w[right])
        dw0, dw1 = (gap[:, :split] ** 2).sum(1) * half / scale[0] ** 2, (gap[:, split:] ** 2).sum(1) * half / scale[1] ** 2
        alpha = tree[1] / 100.0
        height = np.maximum((1 - alpha) * dw0 + alpha * dw1, np.maximum(h[left], h[right]))
        out.append((np.full(len(left), step + turn), ids[left], ids[right], height, dw0, dw1))
        np.add.at(w, left, w[right])
        np.add.at(z, left, z[right])
        np.maximum.at(h, left, height)
        keep = np.ones(len(ids), bool)
        keep[right] = False
        ids, w, h, z = ids[keep], w[keep], h[keep], z[keep]
        turn += 1
    return out, (ids, w, h, z), edges


_STATE = f"unit bigint, w double, z array<double>, h double, {_MERGED}, links bigint"


def _stretches(scales: Scales, split: int, frame, step: int, few: int, size: int, left: dict[tuple[str, int], int]):
    """Consecutive rows of a tree to stretches; gives the clusters that are left (with a unit) and the merges (with a round)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None

        def give():
            rows = pa.Table.from_batches(held)
            out, (ids, w, h, z), edges = _stretch(name, rows, rows.num_rows == left[name], scales[name[0]], split, frame, step, few)
            n = len(ids)
            links = np.zeros(n, np.int64)
            links[:1] = edges
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            names = ["scenario", "alpha_step", "unit", "w", "z", "h", *[c.split()[0] for c in _MERGED.split(", ")], "links"]

            def tree(rows_: int):
                return [pa.array([name[0]] * rows_, pa.string()), pa.array(np.full(rows_, name[1]), pa.int32())]

            yield pa.RecordBatch.from_arrays([*tree(n), pa.array(ids), pa.array(w), flat, pa.array(h), *[pa.nulls(n, k) for k in kinds], pa.array(links)], names=names)
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                m = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [*tree(m), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, flat.type), pa.nulls(m, pa.float64()),
                     *[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array(np.zeros(m, np.int64))], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            trees, own = _trees(b)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), b.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                start, end = int(start), int(end)
                if held and trees[own[start]] != name:
                    yield from give()
                    held.clear()
                name = trees[own[start]]
                while start < end:
                    take = min(end - start, size - sum(x.num_rows for x in held))
                    held.append(b.slice(start, take))
                    start += take
                    if sum(x.num_rows for x in held) == size:
                        yield from give()
                        held.clear()
        if held:
            yield from give()
    return run


def ward_tree_graph(units: DataFrame, alpha_steps: Steps, scales: Scales | None = None, dense: int = DENSE) -> Tree:
    """Ward trees (squared mix, weights 1/n) of ``units(scenario, unit, x, g)`` for every scenario and weight.

    ``x`` are features without gaps, ``g`` unit vectors of places, whose distance is the straight line. Trees of at most ``dense``
    units are exact; larger ones are exact Ward trees of the clusters that the graph has formed until ``dense`` are left.
    ``Tree.rounds`` lists (round, clusters of all trees, edges), with no edges once all pairs are compared.
    """
    spark = units.sparkSession
    units = written(units.select("scenario", F.col("unit").cast("bigint").alias("unit"), "x", "g"), "graph-units")
    sizes = unit_counts(units)
    split = units.select(F.max(F.size("x"))).first()[0] or 0
    scales = scales_of(units, split) if scales is None else scales
    frame = vector_frame(units.select(F.concat("x", "g").alias("v")), "v")
    w = by_scenario({s: 1.0 / n for s, n in sizes.items()}) if sizes else F.lit(1.0)
    left = {(s, int(a)): n for s, n in sizes.items() for a in steps_in(alpha_steps, s)}
    rounds, done, report = Rounds(spark, "ward-graph"), [], []
    clusters = rounds.keep(units.select(
        "scenario", F.explode(steps_column(alpha_steps)).alias("alpha_step"), "unit", w.alias("w"),
        F.transform(F.concat("x", "g"), lambda v: v * w).alias("z"), F.lit(0.0).alias("h")), "clusters-0")
    step, turn, kind = 1, 0, dict(units.dtypes)["scenario"]
    order = ["scenario", "alpha_step", "code", "unit"]
    ship_package(spark)
    while left and max(left.values()) > 1:
        alive, per_tree = sum(left.values()), max(left.values())
        rounds.fit(alive)
        if per_tree <= min(dense, small_trees.FEW):
            report.append((step, alive, 0))
            done.append(rounds.keep(small_trees.finish_vectors(clusters, split, scales, step), f"merges-{step}"))
            break
        if per_tree > dense:
            placed = clusters.mapInArrow(_placed(scales, split, *frame, (turn % 7) / 7), f"scenario {kind}, alpha_step int, unit bigint, w double, z array<double>, h double, code bigint")
            dealt = placed.repartitionByRange(max(min(len(left), 8), -(-alive // STRETCH)), *order).sortWithinPartitions(*order)
            state = dealt.drop("code").mapInArrow(_stretches(scales, split, frame, step, dense, STRETCH, dict(left)), f"scenario {kind}, alpha_step int, {_STATE}")
            seen = Observation()
            kept = rounds.keep(state.observe(seen, F.sum("links").alias("links"), F.count("round").alias("merged")), f"state-{step}")
            merged = seen.get["merged"]
            report.append((step, alive, seen.get["links"]))
            merges = kept.where(F.col("round").isNotNull()).select([c.split()[0] for c in MERGES.split(", ")])
            after = kept.where(F.col("unit").isNotNull()).select("scenario", "alpha_step", "unit", "w", "z", "h")
        else:
            report.append((step, alive, 0))
            formed, merged = rounds.keep_counted(merged_vectors(clusters, nearest_clusters(clusters, per_tree, split, scales), split, scales, step), f"merges-{step}")
            merges = formed.drop("w", "z")
            touched = formed.select(*GROUP, F.explode(F.array("left", "right")).alias("unit"))
            stay = clusters.join(maybe_broadcast(touched, 2 * merged), [*GROUP, "unit"], "left_anti")
            grown = formed.select(*GROUP, F.col("left").alias("unit"), "w", "z", F.col("height").alias("h"))
            after = rounds.keep(stay.select(grown.columns).unionByName(grown), f"clusters-{step}")
        if not merged:
            raise ValueError("no clusters to merge: a vector has missing entries")
        done.append(merges)
        for r in merges.groupBy(*GROUP).count().collect():  # one row per tree
            left[r["scenario"], r["alpha_step"]] -= r["count"]
        clusters = after
        # Passes of a round have numbers of their own: a later one may merge what an earlier one has formed, at the same height.
        step, turn = step + PASSES, turn + 1
    tree = Tree(units.select("scenario", "unit"), all_merges(rounds, done, spark), alpha_steps, sizes)
    tree.rounds = report
    return tree


def vector_totals(units: DataFrame, scales: Scales) -> DataFrame:
    """(scenario, t0, t1): total inertia of both tables, each over its squared scale, from column variances."""
    def spread(column: str, place: int) -> DataFrame:
        at = units.select("scenario", F.posexplode(column).alias("pos", "v")).groupBy("scenario", "pos").agg(F.var_pop("v").alias("s"))
        return at.groupBy("scenario").agg((F.sum("s") / by_scenario({s: v[place] ** 2 for s, v in scales.items()})).alias(f"t{place}"))

    return spread("x", 0).join(spread("g", 1), "scenario")
