"""Queries on real shapes: polygons with holes, boundary cases, and the analysis with boundary distance and shape centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial
from ..plans import study
from ..sources import views
from . import sqltext as S
from .clustering import AT_STARS, CHOSEN, FINAL, GAIN, MERGES, SCORED, SETS, SIDE, _merges, r
from .registry import TARGETS, Workspace, query, rounded

# Squares as (code, unit, part_id, hole, lon, lat, side).
SCATTERED = """placed AS (
  SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS code, n_nationkey::BIGINT AS unit,
         -100.0::DOUBLE + 40 * (n_nationkey % 5) + 4 * ((n_nationkey * 0.6180339::DOUBLE) % 1) AS lon,
         -50.0::DOUBLE + 20 * (n_nationkey // 5) + 3 * ((n_nationkey * 0.7548777::DOUBLE) % 1) AS lat,
         8.0::DOUBLE + 2 * (n_nationkey % 3) + 0.5 * ((n_nationkey * 0.5698403::DOUBLE) % 1) AS side
  FROM nation),
rects AS MATERIALIZED (
  SELECT code, unit, 0 AS part_id, false AS hole, lon, lat, side FROM placed
  UNION ALL SELECT code, unit, 0, true, lon + 0.5, lat + 1, side - 2 FROM placed WHERE unit % 3 = 0
  UNION ALL SELECT code, unit, 1, false, lon + 20, lat + 2, 6.0 FROM placed WHERE unit % 2 = 0)"""
CASES = """placed AS (
  SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS code, n_nationkey::BIGINT AS unit, n_nationkey // 5 AS c, (n_nationkey % 5)::DOUBLE AS m FROM nation),
sited AS (
  SELECT code, unit, c, CASE c WHEN 0 THEN -100 + 10 * m WHEN 1 THEN -100 + 6 * m WHEN 2 THEN -10 + 2 * m WHEN 3 THEN 60 + 3 * m ELSE 167.25 + 6 * m END AS lon,
         CASE c WHEN 0 THEN -50 WHEN 1 THEN -20 + 3 * m WHEN 2 THEN 5 + 2 * m WHEN 3 THEN -40 + 3 * m ELSE 20 + m END AS lat,
         CASE c WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 20 - 4 * m WHEN 3 THEN 30 - 6 * m ELSE 4 END AS side FROM placed),
rects AS MATERIALIZED (
  SELECT code, unit, 0 AS part_id, false AS hole, lon, lat, side FROM sited
  UNION ALL SELECT code, unit, 0, true, lon + 0.5, lat + 1, side - 2 FROM sited WHERE c = 3)"""
SIZED = """sized AS (
  SELECT code, unit, part_id, sum(CASE WHEN hole THEN -1 ELSE 1 END * side * side) AS area,
         sum(CASE WHEN hole THEN -1 ELSE 1 END * side * side * (lon + side / 2)) AS x, sum(CASE WHEN hole THEN -1 ELSE 1 END * side * side * (lat + side / 2)) AS y
  FROM rects GROUP BY ALL),
largest AS MATERIALIZED (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY code ORDER BY area DESC, part_id) = 1)"""


def _turned(a: str, b: str) -> str:
    return f"atan2(sqrt(pow({a}y * {b}z - {a}z * {b}y, 2) + pow({a}z * {b}x - {a}x * {b}z, 2) + pow({a}x * {b}y - {a}y * {b}x, 2)), " \
           f"{a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


def _side(normal: str, point: str) -> str:
    return f"({normal}.nx * {point}x + {normal}.ny * {point}y + {normal}.nz * {point}z)"


#: Every corner against every arc, every arc against every arc, every first corner against every square.
MEASURED = f"""corner AS (
  SELECT unit, part_id * 2 + hole::INT AS ring, n, radians(lon + (CASE WHEN n IN (1, 2) THEN side ELSE 0 END)) AS lo,
         radians(lat + (CASE WHEN n IN (2, 3) THEN side ELSE 0 END)) AS la
  FROM rects, (SELECT unnest([0, 1, 2, 3]) AS n)),
vec AS (SELECT unit, ring, n, cos(la) * cos(lo) AS x, cos(la) * sin(lo) AS y, sin(la) AS z FROM corner),
arc AS MATERIALIZED (
  SELECT a.unit, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.y AS by, b.z AS bz, a.x + b.x AS mx, a.y + b.y AS my, a.z + b.z AS mz,
         a.y * b.z - a.z * b.y AS nx, a.z * b.x - a.x * b.z AS ny, a.x * b.y - a.y * b.x AS nz
  FROM vec a JOIN vec b ON a.unit = b.unit AND a.ring = b.ring AND b.n = (a.n + 1) % 4),
near AS (
  SELECT least(v.unit, a.unit) AS i, greatest(v.unit, a.unit) AS j, min(
    CASE WHEN (ny * az - nz * ay) * x + (nz * ax - nx * az) * y + (nx * ay - ny * ax) * z >= 0
          AND (ny * bz - nz * by_) * x + (nz * bx - nx * bz) * y + (nx * by_ - ny * bx) * z <= 0
         THEN asin(least(1.0, abs(nx * x + ny * y + nz * z) / sqrt(nx * nx + ny * ny + nz * nz)))
         ELSE least(2 * asin(least(1.0, sqrt(pow(x - ax, 2) + pow(y - ay, 2) + pow(z - az, 2)) / 2)),
                    2 * asin(least(1.0, sqrt(pow(x - bx, 2) + pow(y - by_, 2) + pow(z - bz, 2)) / 2))) END) AS d
  FROM vec v JOIN arc a ON a.unit <> v.unit GROUP BY ALL),
zero AS (
  SELECT p.unit AS i, q.unit AS j FROM arc p JOIN arc q ON p.unit < q.unit
  WHERE {_side("p", "q.a")} * {_side("p", "q.b")} < 0 AND {_side("q", "p.a")} * {_side("q", "p.b")} < 0
    AND {_side("p", "q.a")} * {_side("q", "p.b")} > 0
    AND {_turned("p.m", "q.m")} <= ({_turned("p.a", "p.b")} + {_turned("q.a", "q.b")}) / 2 + 1e-9
  UNION SELECT least(o.unit, t.unit), greatest(o.unit, t.unit) FROM rects o JOIN rects t ON o.unit <> t.unit AND NOT t.hole AND NOT o.hole
  LEFT JOIN rects h ON h.unit = o.unit AND h.part_id = o.part_id AND h.hole
  WHERE ((t.lon - o.lon + 720) % 360) < o.side AND ((t.lon - o.lon + 720) % 360) > 0 AND t.lat > o.lat AND t.lat < o.lat + o.side
    AND NOT coalesce(((t.lon - h.lon + 720) % 360) < h.side AND t.lat > h.lat AND t.lat < h.lat + h.side, false)),
distances AS MATERIALIZED (
  SELECT i, j, CASE WHEN zero.i IS NULL THEN d * 6371010.0 ELSE 0.0 END AS d1 FROM near LEFT JOIN zero USING (i, j))"""


def mapped_pairs(sets: dict[str, list[str]]) -> list[str]:
    """The blocks of :func:`sqltext.nation_pairs` with boundary distances, and centroids of the largest polygons as points."""
    columns = sorted({c for names in sets.values() for c in names})
    return [S.PANEL, S.WIDE, SCATTERED, SIZED, MEASURED, "points AS (SELECT unit, code, x / area AS lon, y / area AS lat FROM largest)",
            S.scaled(columns), S.features(sets), S.RAW_PAIRS.split("d1 AS (")[0] +
            "raw_pairs AS MATERIALIZED (SELECT scenario, i, j, d0, d1 FROM d0 JOIN distances USING (i, j))", S.PAIRS, S.UNITS]


MAPPED = mapped_pairs(TARGETS)


@query("largest_part_holes", S.query(SCATTERED, SIZED, select=f"SELECT code, part_id, {r('area')} AS area FROM largest"))
def _(ws: Workspace):
    return rounded(spatial.largest_part(views.scattered_boundaries(ws.spark, ws.folder)).select("code", "part_id", "area"), "area")


@query("centroid_holes", S.query(SCATTERED, SIZED, select=f"SELECT code, {r('x / area', 9)} AS lon, {r('y / area', 9)} AS lat FROM largest"))
def _(ws: Workspace):
    return rounded(spatial.centroid(views.scattered_boundaries(ws.spark, ws.folder)), "lon", "lat", digits=9)


def _areas(ws: Workspace, boundaries):
    """Shapes by the integer unit of their code."""
    return boundaries.select(F.substring("code", 2, 9).cast("bigint").alias("unit"), "parts")


@query("boundary_distance_cases", S.query(CASES, MEASURED, select=f"SELECT i, j, {r('d1', 3)} AS d1 FROM distances"))
def _(ws: Workspace):
    areas = _areas(ws, views.boundary_cases(ws.spark, ws.folder))
    return rounded(spatial.boundary_distance(areas), "d1", digits=3)


@query("boundary_distance_touching", S.query("""rects AS MATERIALIZED (
  SELECT n_nationkey::BIGINT AS unit, 0 AS part_id, false AS hole, -100.0::DOUBLE + 40 * (n_nationkey % 5) AS lon,
         -50.0::DOUBLE + 20 * (n_nationkey // 5) AS lat FROM nation),
apart AS (SELECT a.unit AS i, b.unit AS j FROM rects a JOIN rects b ON a.unit < b.unit AND abs(a.lon - b.lon) <= 40 AND abs(a.lat - b.lat) <= 20)""",
                                             select="SELECT i, j, 0.0::DOUBLE AS d1 FROM apart"))
def _(ws: Workspace):
    touching = views.raw_boundaries(ws.spark, ws.folder, touching=True).where("iso_a3_eh LIKE 'N%'")
    areas = _areas(ws, touching.select(F.col("iso_a3_eh").alias("code"), "parts"))
    return rounded(spatial.boundary_distance(areas).where("d1 = 0"), "d1", digits=3)


@query("boundaries_within", S.query(SCATTERED, MEASURED, select=f"SELECT i, j, {r('d1', 3)} AS d1 FROM distances WHERE d1 <= 1500000"))
def _(ws: Workspace):
    areas = _areas(ws, views.scattered_boundaries(ws.spark, ws.folder))
    return rounded(spatial.boundaries_within(areas, 1_500_000.0), "d1", digits=3)


@query("range_normalise_boundary", S.query(MAPPED, select=f"SELECT scenario, i, j, {r('d0')} AS d0, {r('d1')} AS d1 FROM pairs"))
def _(ws: Workspace):
    return rounded(ws.mapped.pairs, "d0", "d1")


@query("ward_tree_boundary", S.query(MAPPED, S.ALL_ALPHAS, S.tree(), select=MERGES))
def _(ws: Workspace):
    return _merges(ws.mapped.tree)


@query("choose_alpha_boundary", S.query(MAPPED, *CHOSEN, select="SELECT scenario, criterion, k, alpha_step FROM stars"))
def _(ws: Workspace):
    return ws.mapped.stars


@query("index_table_boundary", S.query(MAPPED, *SCORED, select=SIDE))
def _(ws: Workspace):
    return rounded(ws.mapped.index_table(), "index_ch", "index_max")


@query("index_baseline_boundary", S.query(MAPPED, *SCORED, select=f"SELECT scenario, k, index, {r('value')} AS value FROM scored WHERE alpha_step = 0"))
def _(ws: Workspace):
    return rounded(ws.mapped.index_baseline(), "value")


@query("gain_loss_boundary", S.query(MAPPED, *SCORED, GAIN.replace(
    "nullif(index_val0, 0)", "(CASE WHEN abs(index_val0) > 1e-12 THEN index_val0 END)"), select=f"SELECT scenario, index, k, criterion, {r('diff_index0', 4)} AS diff_index0 FROM gains"))
def _(ws: Workspace):
    return rounded(ws.mapped.gain_loss(study.GAIN_KS).drop("part"), "diff_index0", digits=4)


@query("cluster_units_boundary", S.query(MAPPED, *FINAL, select=f"SELECT scenario, unit, {S.COMBO_COLUMN} AS name, cluster FROM final"))
def _(ws: Workspace):
    named = study.named_combos(ws.mapped.cluster_units(), "column")
    return named.select("scenario", "unit", F.col("key").alias("name"), "cluster")


SETS_MAPPED = [mapped_pairs(SETS), *FINAL]


@query("scenario_run_boundary", S.query(*SETS_MAPPED, select="SELECT scenario, k, alpha_step, unit, cluster FROM final"))
def _(ws: Workspace):
    return ws.mapped_scenario_labels.select("scenario", "k", "alpha_step", "unit", "cluster")


@query("scenario_coherence_boundary", S.query(
    *SETS_MAPPED, f"keyed AS MATERIALIZED (SELECT scenario || ' - ' || {S.COMBO_KEY} AS key, unit, cluster FROM final)", S.ari("keyed"), select=f"""
SELECT left_key AS reg1, right_key AS reg2, 'AdjRanIndex' AS name, {r('ari')} AS value,
       {r('(ari - avg(ari) OVER ()) / nullif(stddev_samp(ari) OVER (), 0)')} AS value_std FROM agreement"""))
def _(ws: Workspace):
    return rounded(study.scenario_coherence(ws.mapped_scenario_labels), "value", "value_std")


# ---- the sweep without a table of pairs --------------------------------------

#: Places as points of the unit sphere, their distance as the straight line.
STRAIGHT = [S.PANEL, S.WIDE, S.POINTS, S.scaled(sorted(TARGETS)), S.features(TARGETS), S.RAW_PAIRS.replace(S.HAVERSINE, """sqrt(
    pow(cos(radians(a.lat)) * cos(radians(a.lon)) - cos(radians(b.lat)) * cos(radians(b.lon)), 2)
    + pow(cos(radians(a.lat)) * sin(radians(a.lon)) - cos(radians(b.lat)) * sin(radians(b.lon)), 2)
    + pow(sin(radians(a.lat)) - sin(radians(b.lat)), 2))"""), S.PAIRS, S.UNITS]


@query("choose_alpha_vectors", S.query(STRAIGHT, *CHOSEN, select="SELECT scenario, criterion, k, alpha_step FROM stars"))
def _(ws: Workspace):
    return ws.straight.stars


@query("inertia_at_alpha_star_vectors", S.query(STRAIGHT, *CHOSEN, select=AT_STARS))
def _(ws: Workspace):
    return rounded(ws.straight.inertia_at_stars(), "q0", "q1", "tot")


@query("cluster_units_vectors", S.query(STRAIGHT, *FINAL, select=f"SELECT scenario, unit, {S.COMBO_COLUMN} AS name, cluster FROM final"))
def _(ws: Workspace):
    named = study.named_combos(ws.straight.cluster_units(), "column")
    return named.select("scenario", "unit", F.col("key").alias("name"), "cluster")
