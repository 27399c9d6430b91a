"""Expressions over rings of lon/lat points and over points on the unit sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: radius of the sphere in metres.
EARTH_RADIUS_M = 6371010.0


def unwrapped(ring: Column, near: Column | None = None) -> Column:
    """Move every longitude within half a turn of ``near``, by default of the first vertex."""
    near = ring[0]["lon"] if near is None else near
    return F.transform(ring, lambda p: F.struct(
        (p["lon"] + F.lit(360.0) * F.round((near - p["lon"]) / 360)).alias("lon"),
        p["lat"].alias("lat")))


def holes_of(part: Column) -> Column:
    """The hole rings of a polygon; none for NULL."""
    return F.coalesce(part["holes"], F.array().cast("array<array<struct<lon:double,lat:double>>>"))


def rings_of(part: Column) -> Column:
    """The outer ring and the holes of a polygon."""
    return F.concat(F.array(part["ring"]), holes_of(part))


def next_points(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.array(ring[0]))


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs, closing the ring (a repeated last vertex adds nothing)."""
    return F.zip_with(ring, next_points(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _edge_sum(ring: Column, term) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + term(e["a"], e["b"]))


def _cross(a: Column, b: Column) -> Column:
    return a["lon"] * b["lat"] - b["lon"] * a["lat"]


def signed_area(ring: Column) -> Column:
    """Shoelace area in square degrees, positive for counter-clockwise rings."""
    return _edge_sum(ring, _cross) / 2


def _ring_moments(ring: Column) -> Column:
    """(area, x, y) of an unwrapped ring, counted positive whichever way it turns: the area, and its integrals of lon and lat."""
    area = signed_area(ring)
    side = F.when(area < 0, -1.0).otherwise(1.0)
    x = _edge_sum(ring, lambda a, b: (a["lon"] + b["lon"]) * _cross(a, b)) / 6
    y = _edge_sum(ring, lambda a, b: (a["lat"] + b["lat"]) * _cross(a, b)) / 6
    return F.struct((area * side).alias("area"), (x * side).alias("x"), (y * side).alias("y"))


def part_moments(part: Column) -> Column:
    """(area, x, y) of a polygon: its outer ring less its holes, all on the side of the antimeridian of the first vertex."""
    near = part["ring"][0]["lon"]
    outer = _ring_moments(unwrapped(part["ring"]))
    return F.aggregate(F.transform(holes_of(part), lambda h: _ring_moments(unwrapped(h, near))), outer, lambda m, h: F.struct(
        *[(m[c] - h[c]).alias(c) for c in ("area", "x", "y")]))


def to_xyz(lon: Column, lat: Column) -> Column:
    lo, la = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"),
                    F.sin(la).alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"),
                    (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"),
                    (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Column, b: Column) -> Column:
    """Angle between two unit vectors; exactly 0 for equal ones."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def ring_vectors(ring: Column) -> Column:
    """The ring's vertices as unit vectors."""
    return F.transform(ring, lambda p: to_xyz(p["lon"], p["lat"]))


def sphere_moment(vectors: Column) -> Column:
    """Area moment of a ring on the sphere: the sum over edges of (edge angle x unit normal)."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    normals = F.transform(edges(vectors), lambda e: F.struct(
        cross(e["a"], e["b"]).alias("n"), dot(e["a"], e["b"]).alias("d")))
    scaled = F.transform(normals, lambda e: F.struct(e["n"].alias("n"), F.coalesce(
        F.try_divide(F.atan2(norm(e["n"]), e["d"]), norm(e["n"])), F.lit(0.0)).alias("s")))
    return F.aggregate(scaled, zero, lambda acc, e: F.struct(
        *[(acc[c] + e["n"][c] * e["s"]).alias(c) for c in ("x", "y", "z")]))


def part_sphere_moment(part: Column) -> Column:
    """Area moment of a polygon on the sphere; each ring's moment is turned to the side on which the ring lies."""
    def turned(ring: Column) -> Column:
        v = ring_vectors(ring)
        moment = sphere_moment(v)
        side = F.when(dot(moment, v[0]) < 0, -1.0).otherwise(1.0)
        return F.struct(*[(moment[c] * side).alias(c) for c in ("x", "y", "z")])

    return F.aggregate(F.transform(holes_of(part), turned), turned(part["ring"]), lambda m, h: F.struct(
        *[(m[c] - h[c]).alias(c) for c in ("x", "y", "z")]))


def direction(v: Column) -> Column:
    """Longitude and latitude of a vector."""
    return F.struct(F.degrees(F.atan2(v["y"], v["x"])).alias("lon"),
                    F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))).alias("lat"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting in lon/lat, half-open in latitude so a vertex counts once."""
    at = lon + F.lit(360.0) * F.round((ring[0]["lon"] - lon) / 360)

    def flips(inside: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        where = a["lon"] + F.try_divide((lat - a["lat"]) * (b["lon"] - a["lon"]),
                                        b["lat"] - a["lat"])
        return F.when(spans & (at < where), ~inside).otherwise(inside)

    return F.aggregate(edges(unwrapped(ring)), F.lit(False), flips)


def point_in_part(point: Column, part: Column) -> Column:
    """Inside the outer ring and in none of the holes: an odd number of the rings hold the point."""
    return F.aggregate(rings_of(part), F.lit(False), lambda inside, r: inside != point_in_ring(point["lon"], point["lat"], r))


def cell_side(level: Column) -> Column:
    return F.pow(F.lit(2.0), -level)


def cell_level(radius: Column, finest: int = 20) -> Column:
    """The finest level of the grid whose cells are no smaller than ``radius``."""
    return F.least(F.lit(finest), F.floor(-F.log2(F.greatest(radius, F.lit(2.0 ** -finest))))).cast("int")


def cell_of(v: Column, level: Column) -> Column:
    """The cell of a point in the cubic grid around the unit sphere; no seam at the poles or the antimeridian."""
    side = cell_side(level)
    return F.struct(level.alias("level"), *[F.floor(v[c] / side).cast("int").alias(c) for c in ("x", "y", "z")])


def cells_of(v: Column, radius: Column, level: Column) -> Column:
    """All cells that a ball may touch: at most three an axis while ``radius`` is no larger than a cell."""
    side = cell_side(level)

    def along(c: str) -> Column:
        return F.sequence(F.floor((v[c] - radius) / side).cast("int"), F.floor((v[c] + radius) / side).cast("int"))

    return F.flatten(F.flatten(F.transform(along("x"), lambda x: F.transform(along("y"), lambda y: F.transform(
        along("z"), lambda z: F.struct(level.alias("level"), x.alias("x"), y.alias("y"), z.alias("z")))))))


def chord(reach: Column) -> Column:
    """Straight distance across an angle; whatever reaches further than half a turn reaches everything."""
    return 2 * F.sin(F.least(reach, F.lit(3.141592653589793)) / 2)
