"""Polygons with holes: largest part, centroid, and the distance between boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arcs
from ..functions.geometry import (EARTH_RADIUS_M, cell_level, cell_of, cells_of, chord, direction, part_moments,
                                  part_sphere_moment, point_in_part, rings_of)
from ..state import ship_package, written
from .pairs import in_tiles

# Consecutive boundary segments that share one bounding cap.
CHUNK = 64
# Units whose caps one task compares with as many.
BLOCK_UNITS = 64
# Angles below this are rounding of a bound; it only makes a bound looser.
SLACK = 1e-6


def largest_part(boundaries: DataFrame, key: str = "code") -> DataFrame:
    """The polygon with the largest planar area, holes taken off; equal areas keep the smaller part id."""
    sized = boundaries.select(key, F.explode("parts").alias("part")).withColumn("m", part_moments(F.col("part")))
    best = F.min(F.struct((-F.col("m.area")).alias("less"), F.col("part.part_id").alias("part_id"), "part", "m")).alias("b")
    return sized.groupBy(key).agg(best).select(
        key, "b.part_id", "b.part.ring", "b.part.holes", F.col("b.m.area").alias("area"),
        F.struct(F.try_divide("b.m.x", "b.m.area").alias("lon"), F.try_divide("b.m.y", "b.m.area").alias("lat")).alias("middle"))


def centroid(boundaries: DataFrame, key: str = "code", spherical: bool = False) -> DataFrame:
    """Centroid of the largest polygon, holes taken off, planar in lon/lat or on the sphere."""
    parts = largest_part(boundaries, key)
    if not spherical:
        return parts.select(key, "middle.lon", "middle.lat")
    return parts.select(key, direction(part_sphere_moment(F.struct("ring", "holes"))).alias("c")).select(key, "c.lon", "c.lat")


def _rings(boundaries: DataFrame) -> DataFrame:
    """(unit, part, lon, lat): one row a ring, outer rings first."""
    part = F.posexplode("parts").alias("part", "shape")
    return boundaries.select("unit", part).select("unit", "part", F.posexplode(rings_of(F.col("shape"))).alias("ring", "points")).select(
        "unit", "part", "ring", F.col("points.lon").alias("lon"), F.col("points.lat").alias("lat"))


RUN = "part int, ring int, run int, mid array<double>, reach double, tip array<double>, segs array<double>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rings to runs of at most CHUNK arcs, each with its cap and one of its points; repeated points add nothing."""
    for b in batches:
        row: list[int] = []
        cols: list[list] = [[] for _ in range(7)]
        for at in range(b.num_rows):
            lon, lat = (np.array(b.column(c)[at].as_py(), np.float64) for c in ("lon", "lat"))
            v = arcs.points(lon, lat)
            ahead = np.roll(v, -1, axis=0)
            kept = np.flatnonzero((v != ahead).any(axis=1))
            for run, start in enumerate(range(0, len(kept), CHUNK)):
                pick = kept[start:start + CHUNK]
                mid, reach = arcs.cap(np.concatenate([v[pick], ahead[pick]]))
                row.append(at)
                for c, x in zip(cols, (b.column("part")[at].as_py(), b.column("ring")[at].as_py(), run, mid, reach, v[pick[0]],
                                       np.concatenate([v[pick], ahead[pick]], axis=1).ravel())):
                    c.append(x)
        kinds = [pa.int32()] * 3 + [pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([b.column("unit").take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                         names=["unit", *[f.split()[0] for f in RUN.split(", ")]])


def boundary_runs(boundaries: DataFrame) -> DataFrame:
    """Runs of the boundaries of ``boundaries(unit, parts)``, holes included, as a written table."""
    ship_package(boundaries.sparkSession)
    return written(_rings(boundaries).mapInArrow(_cut, f"unit {dict(boundaries.dtypes)['unit']}, {RUN}"), "boundary-runs")


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class _Caps:
    """The caps of one block, sorted by unit."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.mid, self.tip, self.reach = _matrix(rows["mid"]), _matrix(rows["tip"]), rows["reach"].to_numpy()
        units = rows["unit"].to_pylist()
        self.start = np.array([k for k in range(len(units)) if not k or units[k] != units[k - 1]], np.int64)
        self.end = np.r_[self.start[1:], len(units)]
        self.units = [units[k] for k in self.start]


def _close_runs(rows: pa.Table) -> pa.Table:
    """Of a tile of two blocks: the pairs of runs that can hold the least distance of their units.

    A pair of runs is at least its caps' gap apart, and at most the distance of one point of each; a gap larger than the
    smallest such distance of the two units rules it out.
    """
    rows = rows.sort_by([("unit", "ascending"), ("place", "ascending")])
    p, q = rows["p"][0].as_py(), rows["q"][0].as_py()
    left = _Caps(rows.filter(pa.compute.equal(rows["blk"], p)))
    right = left if p == q else _Caps(rows.filter(pa.compute.equal(rows["blk"], q)))
    places = rows["place"]
    out = {"i": [], "ri": [], "j": [], "rj": []}
    lp, rp = left.rows["place"].to_numpy(), right.rows["place"].to_numpy()
    for k, unit in enumerate(left.units):
        mine = slice(left.start[k], left.end[k])
        first = k + 1 if p == q else 0
        if first >= len(right.units):
            continue
        theirs = slice(right.start[first], len(rp))
        apart = np.arccos(np.clip(left.mid[mine] @ right.mid[theirs].T, -1, 1))
        least = apart - left.reach[mine, None] - right.reach[None, theirs]
        most = np.arccos(np.clip(left.tip[mine] @ right.tip[theirs].T, -1, 1)).min(axis=0)
        starts = right.start[first:] - right.start[first]
        best = np.minimum.reduceat(most, starts)
        owner = np.repeat(np.arange(len(starts)), right.end[first:] - right.start[first:])
        a, b = np.nonzero(least <= best[owner][None] + SLACK)
        for x, y in zip((lp[mine][a], rp[theirs][b]), ("mine", "theirs")):
            out["ri" if y == "mine" else "rj"].append(x)
        out["i"] += [unit] * len(a)
        out["j"] += [right.units[first + o] for o in owner[b]]
    kind = rows.schema.field("unit").type
    ri, rj = (np.concatenate(out[c]) if out[c] else np.zeros(0, np.int64) for c in ("ri", "rj"))
    return pa.table([pa.array(out["i"], kind), pa.array(ri, places.type), pa.array(out["j"], kind), pa.array(rj, places.type)], names=["i", "ri", "j", "rj"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least distance of each pair of runs, as an angle."""
    for b in batches:
        d = [arcs.least_distance(np.array(x.as_py()).reshape(-1, 6), np.array(y.as_py()).reshape(-1, 6))
             for x, y in zip(b.column("x"), b.column("y"))]
        yield pa.RecordBatch.from_arrays([b.column("i"), b.column("j"), pa.array(d, pa.float64())], names=["i", "j", "d"])


def _distances(runs: DataFrame, close: DataFrame) -> DataFrame:
    """(i, j, d): least angle of each pair of units from ``close(i, ri, j, rj)``; only these runs' segments move."""
    kind = dict(runs.dtypes)["unit"]
    first = runs.select(F.col("unit").alias("i"), F.col("place").alias("ri"), F.col("segs").alias("x"))
    second = runs.select(F.col("unit").alias("j"), F.col("place").alias("rj"), F.col("segs").alias("y"))
    met = close.join(first, ["i", "ri"]).join(second, ["j", "rj"]).select("i", "j", "x", "y")
    measured = met.mapInArrow(_measure, f"i {kind}, j {kind}, d double")
    ordered = measured.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")
    return ordered.groupBy("i", "j").agg(F.min("d").alias("d"))


def _placed(runs: DataFrame) -> DataFrame:
    """Runs with their number inside the unit."""
    place = (F.col("part").cast("bigint") * 2 ** 44 + F.col("ring").cast("bigint") * 2 ** 28 + F.col("run")).alias("place")
    return runs.select("*", place)


def _xyz(column: str):
    v = F.col(column)
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def nested(boundaries: DataFrame, runs: DataFrame) -> DataFrame:
    """(i, j), i < j: pairs of which one has a part that starts inside the other, and not in one of its holes.

    Outer rings' caps are put into all cells of a grid around the sphere that they may touch, and their first
    points into one cell for each cell size in use: an equi-join on cells finds the points to test, so only
    polygons round another's first point move.
    """
    outer = runs.where("ring = 0")
    tips = outer.where("run = 0").select(F.col("unit").alias("inner"), F.col("part").alias("inner_part"), "tip")
    # A part's cap from its runs' caps: centre of the sum, and the furthest edge of any run.
    sums = outer.groupBy("unit", "part").agg(F.array(*[F.sum(F.col("mid")[k]) for k in range(3)]).alias("sum"), F.max("reach").alias("far"))
    size = F.sqrt(sum((F.col("sum")[k] * F.col("sum")[k] for k in range(3)), F.lit(0.0)))
    mids = sums.select("unit", "part", F.array(*[F.try_divide(F.col("sum")[k], size) for k in range(3)]).alias("centre"))
    dot = sum((F.col("centre")[k] * F.col("mid")[k] for k in range(3)), F.lit(0.0))
    edge = F.coalesce(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))), F.lit(3.2)) + F.col("reach") + SLACK
    caps = outer.join(mids, ["unit", "part"]).groupBy("unit", "part").agg(F.first("centre").alias("centre"), F.max(edge).alias("reach"))
    balls = caps.withColumn("radius", chord(F.col("reach"))).withColumn("level", cell_level(F.col("radius")))
    levels = [r[0] for r in balls.select("level").distinct().collect()]  # at most one a halving of the sphere, 22 in all
    if not levels:
        return runs.select(F.col("unit").alias("i"), F.col("unit").alias("j")).where("false")
    centre = F.when(F.col("centre")[0].isNull(), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).otherwise(_xyz("centre"))
    covered = balls.select("unit", "part", F.explode(cells_of(centre, F.col("radius"), F.col("level"))).alias("cell"))
    asked = tips.select("inner", "inner_part", F.explode(F.array(*[cell_of(_xyz("tip"), F.lit(n)) for n in levels])).alias("cell"))
    hits = covered.join(asked, "cell").where(F.col("unit") != F.col("inner")).select("unit", "part", "inner", "inner_part").distinct()
    shapes = boundaries.select("unit", F.posexplode("parts").alias("part", "shape"))
    corners = shapes.select(F.col("unit").alias("inner"), F.col("part").alias("inner_part"), F.col("shape.ring")[0].alias("corner"))
    tested = hits.join(corners, ["inner", "inner_part"]).join(shapes, ["unit", "part"])
    return tested.where(point_in_part(F.col("corner"), F.col("shape"))).select(
        F.least("unit", "inner").alias("i"), F.greatest("unit", "inner").alias("j")).distinct()


def _in_metres(lines: DataFrame, inside: DataFrame) -> DataFrame:
    return lines.join(inside.withColumn("nested", F.lit(True)), ["i", "j"], "left").select(
        "i", "j", F.when(F.col("nested"), 0.0).otherwise(F.col("d") * EARTH_RADIUS_M).alias("d1"))


def boundary_distance(boundaries: DataFrame) -> DataFrame:
    """(i, j, d1): smallest distance in metres between two units' polygons, for every pair of units.

    Zero where they touch, cross or nest; a unit in another's hole has the distance to the hole's edge. ``boundaries(unit, parts)``;
    units without a point are in no pair. Caps of runs of segments are compared block by block, and segments are fetched for
    those runs only that can still hold the least distance of their pair.
    """
    spark = boundaries.sparkSession
    runs = _placed(boundary_runs(boundaries))
    units = runs.select("unit").distinct().count()
    kind = dict(runs.dtypes)["unit"]
    caps = in_tiles(runs.select("unit", "place", "mid", "reach", "tip"), max(1, -(-units // BLOCK_UNITS)))
    ship_package(spark)
    close = caps.groupBy("p", "q").applyInArrow(_close_runs, f"i {kind}, ri bigint, j {kind}, rj bigint")
    return _in_metres(_distances(runs, written(close, "boundary-close")), nested(boundaries, runs))


def boundaries_within(boundaries: DataFrame, metres: float) -> DataFrame:
    """(i, j, d1): pairs of units at most so far apart, without looking at all pairs.

    Caps of runs meet in the cells of a grid whose side is the reach of the largest cap twice plus the distance, so the
    work follows the number of near runs. Pass a distance that is small against the units' spread.
    """
    runs = _placed(boundary_runs(boundaries))
    far = metres / EARTH_RADIUS_M
    widest = runs.agg(F.max(chord(F.col("reach"))).alias("r")).first()["r"]
    kind = dict(runs.dtypes)["unit"]
    if widest is None:
        return boundaries.sparkSession.createDataFrame([], f"i {kind}, j {kind}, d1 double")
    caps = runs.select("unit", "place", _xyz("mid").alias("mid"), "reach")
    gap = F.lit(2 * np.sin(min(far, np.pi) / 2))
    radius = chord(F.col("reach")) + F.lit(float(widest)) + gap + SLACK
    level = F.lit(int(np.floor(-np.log2(min(2.0, 2 * widest + float(2 * np.sin(min(far, np.pi) / 2)) + SLACK)))))
    left = caps.select(F.col("unit").alias("i"), F.col("place").alias("ri"), F.col("mid").alias("m"), F.col("reach").alias("r"),
                       F.explode(cells_of(F.col("mid"), radius, level)).alias("cell"))
    right = caps.select(F.col("unit").alias("j"), F.col("place").alias("rj"), F.col("mid").alias("n"), F.col("reach").alias("s"),
                        cell_of(F.col("mid"), level).alias("cell"))
    dot = F.col("m.x") * F.col("n.x") + F.col("m.y") * F.col("n.y") + F.col("m.z") * F.col("n.z")
    apart = F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))
    close = left.join(right, "cell").where((F.col("i") < F.col("j")) & (apart <= F.col("r") + F.col("s") + far + SLACK)).select("i", "ri", "j", "rj")
    lines = _distances(runs, close)
    inside = nested(boundaries, runs).join(lines.select("i", "j"), ["i", "j"], "left_anti").select("i", "j", F.lit(0.0).alias("d"))
    both = _in_metres(lines.unionByName(inside), nested(boundaries, runs))
    return both.where(F.col("d1") <= metres)
