"""Largest and smallest distances of many vectors without looking at all pairs.

Vectors are sorted along a space-filling curve inside each cluster and cut into blocks of consecutive ones, and these into cells. Both have
a box. A pair of blocks is looked into only if the bounds of its boxes still allow a pair that beats the best one known from real
vectors, and inside it a pair of cells likewise. Where boxes rule little out, as with many independent dimensions, a pair of blocks is
measured as a whole. Blocks meet as :func:`wardfield.operators.blocks.crossed` says: no vector is shuffled once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..state import ship_package, written
from .blocks import crossed, squared
from .zorder import codes

# Vectors in a cell, and cells in a block.
CELL, TOP = 32, 64
# Pairs of blocks that a key measures first on each side, the most promising ones.
FIRST = 8
# Pairs of cells on each side that a pair of blocks measures between two looks at the bounds.
STEP = 4
# Open pairs of cells are measured as whole blocks beyond this share of all, and only in blocks with more pairs of cells than this.
DENSE_SHARE, DENSE_FROM = 0.125, 64
_BLOCK = ("key string, blk bigint, n bigint, cells bigint, least_label int, most_label int, lo array<double>, hi array<double>, "
          "tip array<double>, tip_label int")


@dataclass(frozen=True)
class Metric:
    """``a * |x - x'| + b * angle(g, g')`` of vectors whose first ``split`` entries are x and the rest g, unit vectors.

    With b = 0 there is no g. Missing entries are not supported.
    """
    split: int
    a: float = 1.0
    b: float = 0.0

    def parts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[..., :self.split], v[..., self.split:]

    def of(self, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
        """From the Euclidean distances of both parts; monotone in each."""
        return self.a * d0 + (self.b * 2 * np.arcsin(np.clip(d1 / 2, 0, 1)) if self.b else 0.0)

    def between(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """All distances between two blocks."""
        (x, g), (y, h) = self.parts(p), self.parts(q)
        return self.of(_euclid(x, y), _euclid(g, h) if self.b else 0.0)


def _euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        gap = x[:, k, None] - y[None, :, k]
        d += gap * gap
    return np.sqrt(d)


def vector_frame(vectors: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest entry at each place of an array column: as many rows as places."""
    rows = vectors.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    rows = sorted(rows, key=lambda r: r["at"])
    return np.array([r["lo"] for r in rows], float), np.array([r["hi"] for r in rows], float)


def _coded(low: np.ndarray, high: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes(v, low, high) if len(v) else [], pa.int64())], names=[*b.schema.names, "code"])
    return run


def _cut(size: int, cell: int):
    """Consecutive rows of one key to blocks; ids are the task's number and a running one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 24, 0
        held: list[pa.RecordBatch] = []
        name = None

        def give():
            nonlocal held, made
            rows = pa.Table.from_batches(held)
            held = []
            label = rows["label"].to_numpy().astype(np.int32)
            v = np.ascontiguousarray(rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1), float)
            made += 1
            one = {"key": name, "blk": base + made, "n": len(v), "cells": -(-len(v) // cell), "least_label": label.min(), "most_label": label.max(),
                   "lo": v.min(axis=0).tolist(), "hi": v.max(axis=0).tolist(), "tip": v[0].tolist(), "tip_label": label[0],
                   "v": v.tobytes(), "labels": label.tobytes()}
            kinds = {c: pa.int32() for c in ("least_label", "most_label", "tip_label")} | {c: pa.binary() for c in ("v", "labels")}
            return pa.RecordBatch.from_arrays([pa.array([x], kinds.get(c)) for c, x in one.items()], names=list(one))

        for b in batches:
            at = b.column("key").dictionary_encode()
            number = at.indices.to_numpy()
            ends = [*(np.flatnonzero(np.diff(number)) + 1), b.num_rows]
            start = 0
            for end in ends:
                if start == end:
                    continue
                key = at.dictionary[int(number[start])].as_py()
                if held and key != name:
                    yield give()
                name = key
                while start < end:
                    take = min(end - start, size - sum(h.num_rows for h in held))
                    held.append(b.slice(start, take))
                    start += take
                    if sum(h.num_rows for h in held) == size:
                        yield give()
        if held:
            yield give()
    return run


def cell_blocks(points: DataFrame) -> DataFrame:
    """Blocks of ``points(key string, label int, v)`` along the curve, with their vectors and labels as bytes; a written table."""
    ship_package(points.sparkSession)
    low, high = vector_frame(points, "v")
    coded = written(points.select("key", "label", "v").mapInArrow(_coded(low, high), "key string, label int, v array<double>, code bigint"), "extreme-codes")
    dealt = coded.repartitionByRange("key", "label", "code").sortWithinPartitions("key", "label", "code", "v")
    return written(dealt.select("key", "label", "v").mapInArrow(_cut(CELL * TOP, CELL), f"{_BLOCK}, v binary, labels binary"), "extreme-blocks")


def _boxes(metric: Metric) -> tuple[Column, Column, Column]:
    """Of a pair of blocks: least and largest possible distance, and that of the pair's first vectors."""
    def length(gaps: Column) -> Column:
        def part(at: Column) -> Column:
            return F.sqrt(F.aggregate(at, F.lit(0.0), lambda s, x: s + x * x))

        d0 = F.lit(metric.a) * part(F.slice(gaps, 1, metric.split))
        if not metric.b:
            return d0
        return d0 + F.lit(2 * metric.b) * F.asin(F.least(part(F.slice(gaps, metric.split + 1, F.greatest(F.size(gaps) - metric.split, F.lit(0)))) / 2, F.lit(1.0)))

    def gap(p: str, q: str) -> Column:
        return F.zip_with(p, q, lambda x, y: x - y)

    least = length(F.zip_with(gap("lo_b", "hi_a"), gap("lo_a", "hi_b"), lambda x, y: F.greatest(x, y, F.lit(0.0))))
    most = length(F.zip_with(gap("hi_b", "lo_a"), gap("hi_a", "lo_b"), lambda x, y: F.greatest(x, y)))
    return least * (1 - 1e-9) - 1e-12, most * (1 + 1e-9) + 1e-12, length(gap("tip_a", "tip_b"))


def _sides() -> tuple[Column, Column]:
    """Whether a pair of blocks can hold two vectors of one label, and of two."""
    shared = (F.col("least_label_a") <= F.col("most_label_b")) & (F.col("least_label_b") <= F.col("most_label_a"))
    return shared, F.least("least_label_a", "least_label_b") < F.greatest("most_label_a", "most_label_b")


class _Cells:
    """The vectors of a block, its cells and their boxes."""

    def __init__(self, v: np.ndarray, label: np.ndarray, cell: int):
        self.v, self.label, self.cell = v, label, cell
        self.at = np.arange(0, len(v), cell)
        self.lo, self.hi = np.minimum.reduceat(v, self.at), np.maximum.reduceat(v, self.at)
        self.first, self.last = np.minimum.reduceat(label, self.at), np.maximum.reduceat(label, self.at)

    def part(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(i * self.cell, (i + 1) * self.cell)
        return self.v[s], self.label[s]


def _cell_bounds(metric: Metric, a: _Cells, b: _Cells) -> tuple[np.ndarray, np.ndarray]:
    def length(gaps) -> np.ndarray:
        sums = [np.zeros((len(a.at), len(b.at))) for _ in range(2)]
        for k in range(a.v.shape[1]):
            gap = gaps(k)
            sums[k >= metric.split] += gap * gap
        return metric.of(np.sqrt(sums[0]), np.sqrt(sums[1]))

    least = length(lambda k: np.maximum(np.maximum(b.lo[None, :, k] - a.hi[:, None, k], a.lo[:, None, k] - b.hi[None, :, k]), 0))
    most = length(lambda k: np.maximum(b.hi[None, :, k] - a.lo[:, None, k], a.hi[:, None, k] - b.lo[None, :, k]))
    return least * (1 - 1e-9) - 1e-12, most * (1 + 1e-9) + 1e-12


def _ends(d: np.ndarray, same: np.ndarray) -> tuple[float, float]:
    return float(np.max(d, where=same, initial=-1.0)), float(np.min(d, where=~same, initial=np.inf))


def _whole(metric: Metric, a: _Cells, b: _Cells) -> tuple[float, float]:
    """Both extremes of two blocks. Products of matrices find the pairs that may hold them, which are then measured."""
    if metric.b:
        found = [_ends(metric.between(a.v[s:s + 256], b.v), a.label[s:s + 256, None] == b.label[None]) for s in range(0, len(a.v), 256)]
        return max(f[0] for f in found), min(f[1] for f in found)
    d2 = squared(a.v, b.v)
    # Rounding of the product form is far below this.
    slack = 1e-11 * float((a.v * a.v).sum(1).max() + (b.v * b.v).sum(1).max())
    same = a.label[:, None] == b.label[None]
    inside = np.where(same, d2, -1.0)
    across = np.where(same, np.inf, d2)
    far, near = inside.max(), across.min()
    none = np.empty(0, int), np.empty(0, int)
    pairs = (np.nonzero(inside >= far - slack) if far >= 0 else none, np.nonzero(across <= near + slack) if near < np.inf else none)
    out = [-1.0, np.inf]
    for side, (i, j) in enumerate(pairs):
        for s in range(0, len(i), 100_000):
            gap = a.v[i[s:s + 100_000]] - b.v[j[s:s + 100_000]]
            d = metric.a * np.sqrt((gap * gap).sum(1))
            out[side] = min(out[1], float(d.min())) if side else max(out[0], float(d.max()))
    return out[0], out[1]


def _look(metric: Metric, a: _Cells, b: _Cells, once: bool, far: float, near: float) -> tuple[float, float, int]:
    """Largest distance inside a label and smallest across labels of two blocks, as far as they beat ``far`` and ``near``, and the pairs of cells measured."""
    def better(v, lv, w, lw):
        nonlocal far, near
        f, n = _ends(metric.between(v, w), lv[:, None] == lw[None])
        far, near = max(far, f), min(near, n)

    better(a.v[a.at], a.label[a.at], b.v[b.at], b.label[b.at])
    least, most = _cell_bounds(metric, a, b)
    live = np.triu(np.ones(least.shape, bool)) if once else np.ones(least.shape, bool)
    shared = (a.first[:, None] <= b.last[None]) & (b.first[None] <= a.last[:, None])
    apart = np.minimum(a.first[:, None], b.first[None]) < np.maximum(a.last[:, None], b.last[None])
    measured, looks, possible = 0, 0, int(live.sum())
    while True:
        inside, across = live & shared & (most > far), live & apart & (least < near)
        left = int((inside | across).sum())
        if not left:
            return far, near, measured
        if looks >= 4 and possible > DENSE_FROM and left > DENSE_SHARE * possible:
            f, n = _whole(metric, a, b)
            return max(far, f), min(near, n), measured + left
        for open_, rank in ((inside, -most), (across, least)):
            at = np.flatnonzero(open_)
            at = at[np.argsort(rank.ravel()[at], kind="stable")[:STEP]]
            for x in at:
                i, j = divmod(int(x), least.shape[1])
                if live[i, j]:
                    better(*a.part(i), *b.part(j))
                    live[i, j] = False
                    measured += 1
        looks += 1


_FOUND = "key string, max_w double, min_b double, measured bigint"


def _measured(metric: Metric, known: dict[str, tuple[float, float]], cell: int):
    """What each pair of blocks adds to the best distances ``known``, carried on from pair to pair of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {k: [w, b, 0] for k, (w, b) in known.items()}

        def side(b: pa.RecordBatch, s: str, i: int) -> _Cells:
            label = np.frombuffer(b.column(f"labels_{s}")[i].as_buffer(), np.int32)
            return _Cells(np.frombuffer(b.column(f"v_{s}")[i].as_buffer()).reshape(len(label), -1), label, cell)

        for b in batches:
            for i, key in enumerate(b.column("key_a").to_pylist()):
                once = b.column("blk_a")[i] == b.column("blk_b")[i]
                far, near, count = best[key]
                far, near, more = _look(metric, side(b, "a", i), side(b, "b", i), once, far, near)
                best[key] = [far, near, count + more]
        if best:
            keys = list(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([None if best[k][0] < 0 else best[k][0] for k in keys], pa.float64()),
                 pa.array([None if np.isinf(best[k][1]) else best[k][1] for k in keys], pa.float64()), pa.array([best[k][2] for k in keys], pa.int64())],
                names=["key", "max_w", "min_b", "measured"])
    return run


class _Best:
    """The best distances known per key; a row of each comes to the driver."""

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.known: dict[str, tuple[float, float]] = {}

    def add(self, rows: DataFrame, label: str) -> None:
        """Rows (key, max_w, min_b, measured)."""
        found = written(rows.groupBy("key").agg(F.max("max_w").alias("max_w"), F.min("min_b").alias("min_b"), F.sum("measured").alias("measured")), label)
        self.tables.append(found)
        for r in found.collect():
            w, b = self.known.get(r["key"], (-1.0, float("inf")))
            self.known[r["key"]] = (w if r["max_w"] is None else max(w, r["max_w"]), b if r["min_b"] is None else min(b, r["min_b"]))

    def beaten(self, least: Column, most: Column) -> Column:
        """Whether a pair of blocks may still hold something better."""
        def now(place: int) -> Column:
            cells = [F.lit(x) for k, v in self.known.items() for x in (k, float(v[place]))]
            return F.create_map(*cells)[F.col("key_a")] if cells else F.lit(None).cast("double")

        shared, apart = _sides()
        return (shared & (most > now(0))) | (apart & (least < now(1)))

    def table(self) -> DataFrame:
        rows = self.tables[0]
        for t in self.tables[1:]:
            rows = rows.unionByName(t)
        return rows.groupBy("key").agg(F.min("min_b").alias("min_b"), F.max("max_w").alias("max_w"), F.sum("measured").cast("bigint").alias("measured"))


def cluster_extremes(points: DataFrame, metric: Metric) -> DataFrame:
    """(key, min_b, max_w, measured, possible) of ``points(key string, label int, v array<double>)``.

    ``min_b`` is the smallest distance between two vectors of different labels (NULL with one label), ``max_w`` the largest of two
    of one label (0 where all labels have one vector). ``measured`` counts the pairs of cells whose vectors were compared,
    ``possible`` the pairs there are. A key is a whole task of its own: a partition, a scenario. Exact; an empty table gives no rows,
    a vector without label takes no part.
    """
    blocks = cell_blocks(points.where(F.col("label").isNotNull()))
    least, most, tips = _boxes(metric)
    alike = F.col("key_a") == F.col("key_b")
    best = _Best()
    boxes = crossed(blocks.drop("v", "labels"), where=alike)
    same = F.col("tip_label_a") == F.col("tip_label_b")
    best.add(boxes.select(F.col("key_a").alias("key"), F.when(same, tips).alias("max_w"), F.when(~same, tips).alias("min_b"), F.lit(0).alias("measured")),
             "extreme-tips")
    shared, apart = _sides()
    open_ = boxes.where(best.beaten(least, most)).select("key_a", "blk_a", "blk_b", F.when(shared, -most).alias("inside"), F.when(apart, least).alias("across"))
    first = set()
    for side in ("inside", "across"):
        rank = F.row_number().over(Window.partitionBy("key_a").orderBy(side, "blk_a", "blk_b"))
        top = open_.where(F.col(side).isNotNull()).withColumn("place", rank).where(F.col("place") <= FIRST)
        first |= {(r["blk_a"], r["blk_b"]) for r in top.select("blk_a", "blk_b").collect()}  # FIRST rows a key
    pair = F.concat_ws("|", "blk_a", "blk_b")
    chosen = pair.isin([f"{a}|{b}" for a, b in first]) if first else F.lit(False)

    def measure(where: Column) -> DataFrame:
        columns = [f"{c}_{s}" for c in ("key", "blk", "v", "labels") for s in "ab"]
        return crossed(blocks, where=alike & where).select(columns).mapInArrow(_measured(metric, dict(best.known), CELL), _FOUND)

    if first:
        best.add(measure(chosen), "extreme-first")
        best.add(measure(best.beaten(least, most) & ~chosen), "extreme-rest")
    cells = F.sum("cells")
    possible = blocks.groupBy("key").agg((cells * (cells + 1) / 2).cast("bigint").alias("possible"))
    return best.table().join(possible, "key").select("key", "min_b", "max_w", "measured", "possible")


def largest_distance(vectors: DataFrame, column: str, split: int, angle: bool = False, key: str | None = None) -> dict[str, float]:
    """Largest Euclidean distance per key (a column of few values) of the first ``split`` entries, or with ``angle`` of unit vectors."""
    name = F.col(key).cast("string") if key else F.lit("all")
    points = vectors.select(name.alias("key"), F.lit(0).alias("label"), F.slice(column, 1, split).alias("v"))
    found = cluster_extremes(points, Metric(split)).collect()  # one row per key
    return {r["key"]: 2 * float(np.arcsin(min(1.0, r["max_w"] / 2))) if angle else float(r["max_w"] or 0.0) for r in found}
