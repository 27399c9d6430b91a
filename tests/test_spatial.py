import math

from pyspark.sql import functions as F

from wardfield.functions.geometry import EARTH_RADIUS_M
from wardfield.operators import spatial
from wardfield.sources.tables import PARTS, keep_countries


def square(lon, lat, w, h=None):
    h = w if h is None else h
    return [(float(a), float(b)) for a, b in
            [(lon, lat), (lon + w, lat), (lon + w, lat + h), (lon, lat + h), (lon, lat)]]


def areas(spark, shapes):
    """Units by name: rings, or pairs of a ring and its holes."""
    rows = [(u, [(i, *(x if isinstance(x, tuple) else (x, None))) for i, x in enumerate(rings)]) for u, rings in shapes.items()]
    return spark.createDataFrame(rows, f"unit string, parts {PARTS.simpleString()}")


def distances(spark, shapes):
    return {(r["i"], r["j"]): r["d1"] for r in spatial.boundary_distance(areas(spark, shapes)).collect()}


def test_touching_crossing_nesting_are_zero(spark):
    got = distances(spark, {
        "a": [square(0, 0, 10)], "b": [square(10, 0, 10)], "c": [square(5, 5, 10)], "d": [square(2, 2, 1)],
        "e": [square(40, 0, 5)], "f": [square(0, -60, 10)], "g": [square(0, 50, 10)]})
    for pair in [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")]:
        assert got[pair] == 0.0, pair
    assert got["b", "d"] > 0 and got["a", "e"] > 0 and got["f", "g"] > 5e6


def test_distance_along_a_meridian(spark):
    got = distances(spark, {"a": [square(0, 0, 5)], "b": [square(0, 20, 5)]})
    # The southern edge of b bulges north, so its corners are nearest to a's corners.
    assert math.isclose(got["a", "b"], math.radians(15) * EARTH_RADIUS_M, rel_tol=1e-3)


def test_long_boundaries_prune_to_the_same_answer(spark, monkeypatch):
    def ring(lon, lat, r, n=90):
        pts = [(lon + r * math.cos(2 * math.pi * t / n), lat + r * math.sin(2 * math.pi * t / n)) for t in range(n)]
        return pts + pts[:1]
    shapes = {"a": [ring(0, 0, 5)], "b": [ring(30, 10, 4)], "c": [ring(-150, 40, 3), ring(60, 0, 2)]}
    whole = distances(spark, shapes)
    monkeypatch.setattr(spatial, "CHUNK", 7)
    assert all(math.isclose(whole[k], v, rel_tol=1e-12) for k, v in distances(spark, shapes).items())


def test_centroid_uses_the_largest_part_and_unwraps(spark):
    df = areas(spark, {"a": [square(0, 0, 1), square(10, 10, 4)], "b": [square(178, 0, 4)]})
    west = df.withColumn("parts", F.transform("parts", lambda p: F.struct(p["part_id"], F.transform(
        p["ring"], lambda q: F.struct(F.when(q["lon"] > 180, q["lon"] - 360).otherwise(q["lon"]).alias("lon"),
                                      q["lat"].alias("lat"))).alias("ring"), p["holes"].alias("holes"))))
    got = {r["unit"]: (r["lon"], r["lat"]) for r in spatial.centroid(west, "unit").collect()}
    assert got["a"] == (12.0, 12.0)
    assert math.isclose(got["b"][0], 180.0) and math.isclose(got["b"][1], 2.0)


def test_spherical_centroid_of_a_small_square(spark):
    got = spatial.centroid(areas(spark, {"a": [square(20, 0, 0.2)]}), "unit", spherical=True).first()
    assert abs(got["lon"] - 20.1) < 1e-4 and abs(got["lat"] - 0.1) < 1e-4


def test_dependencies_are_filtered(spark):
    raw = spark.createDataFrame([("A", "Country", None), ("B", "Dependency", None), ("C", "Sovereignty", None)],
                                f"iso_a3_eh string, type string, parts {PARTS.simpleString()}")
    assert {r["code"] for r in keep_countries(raw).collect()} == {"A", "C"}


def test_holes_change_the_largest_part_and_its_centroid(spark):
    df = areas(spark, {"a": [(square(0, 0, 10), [square(1, 1, 8)]), square(20, 0, 7)], "b": [(square(178, 0, 6), [square(178.5, 1, 4)])]})
    parts = {r["unit"]: (r["part_id"], r["area"]) for r in spatial.largest_part(df, "unit").collect()}
    assert parts == {"a": (1, 49.0), "b": (0, 20.0)}
    got = {r["unit"]: (r["lon"], r["lat"]) for r in spatial.centroid(df, "unit").collect()}
    assert got["a"] == (23.5, 3.5)
    assert math.isclose(got["b"][0], (36 * 181 - 16 * 180.5) / 20) and math.isclose(got["b"][1], 3.0)
    # On a small square the sphere's centroid is the plane's.
    tiny = areas(spark, {"c": [(square(10, 0, 0.4), [square(10.02, 0.02, 0.2)])]})
    plane, sphere = (spatial.centroid(tiny, "unit", spherical=s).first() for s in (False, True))
    assert abs(plane["lon"] - sphere["lon"]) < 1e-5 and abs(plane["lat"] - sphere["lat"]) < 1e-5


def test_a_unit_in_a_hole_is_apart(spark):
    frame = (square(0, 0, 20), [square(1, 1, 18)])
    shapes = {"frame": [frame], "lake": [square(5, 5, 4)], "solid": [square(4, 4, 6)], "edge": [square(0.2, 3, 0.5)], "far": [square(100, 0, 3)]}
    got = distances(spark, shapes)
    assert got["frame", "lake"] > 4e5 and got["frame", "solid"] > 3e5
    assert got["lake", "solid"] == got["edge", "frame"] == 0.0
    near = {(r["i"], r["j"]): r["d1"] for r in spatial.boundaries_within(areas(spark, shapes), 4.2e5).collect()}
    assert near == {k: v for k, v in got.items() if v <= 4.2e5}


def test_distance_over_the_antimeridian_and_at_a_pole(spark):
    got = distances(spark, {"w": [square(175, 0, 3)], "e": [[(p if p <= 180 else p - 360, q) for p, q in square(181, 0, 3)]],
                            "n": [[(float(a), 80.0) for a in (0, 90, 180, -90, 0)]], "in": [square(40, 86, 2)]})
    assert math.isclose(got["e", "w"], math.radians(3) * EARTH_RADIUS_M, rel_tol=1e-3)
    assert got["in", "n"] > 0 and got["e", "n"] > 8e6


def test_units_without_shape_are_in_no_pair(spark):
    got = distances(spark, {"a": [square(0, 0, 1)], "b": [], "c": [square(5, 0, 1)]})
    assert set(got) == {("a", "c")}
    assert spatial.boundary_distance(areas(spark, {"a": [], "b": []})).count() == 0
    assert spatial.boundaries_within(areas(spark, {"a": [], "b": []}), 1e5).count() == 0
