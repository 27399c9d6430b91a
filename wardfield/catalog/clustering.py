"""Spatial, dissimilarity, tree, weight, index and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import compare, cut, graph_tree, indices, inertia, pairs, reshape, spatial, stats, tiles, ward
from ..plans import scenarios, study
from ..sources import sinks, views
from ..state import new_folder, written
from . import sqltext as S
from .basic import GIVEN, SQUARES
from .registry import TARGETS, Workspace, query, rounded

SETS = {
    "AwareClimateSocio": ["R12", "HDI", "rgdpna", "TradeOpenness", "cdd", "tas"],
    "AwareClimate": ["R12", "cdd", "tas"],
    "AwareSocio": ["R12", "HDI", "rgdpna", "TradeOpenness"],
    scenarios.MAIN: ["R12"],
}
BASE = S.nation_pairs(TARGETS)


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def b(select: str, *blocks) -> str:
    return S.query(BASE, *blocks, select=select)


# ---- spatial ---------------------------------------------------------------

@query("largest_part", S.query(SQUARES, select=f"""
SELECT code, arg_max(part_id, side)::INT AS part_id, {r('max(side * side)')} AS area FROM kept GROUP BY code"""))
def _(ws: Workspace):
    return rounded(spatial.largest_part(ws.boundaries).select("code", "part_id", "area"), "area")


@query("centroid", S.query(SQUARES, select=f"""
SELECT code, {r('arg_max(lon + side / 2, side)')} AS lon, {r('arg_max(lat + side / 2, side)')} AS lat FROM kept GROUP BY code"""))
def _(ws: Workspace):
    return rounded(spatial.centroid(ws.boundaries), "lon", "lat")


# Direction of the sphere centroid of a lon/lat square whose sides are great circles.
SPHERICAL = f"""{SQUARES},
big AS (SELECT code, arg_max({{'lon': lon, 'lat': lat, 'side': side}}, side) AS s FROM kept GROUP BY code),
corners AS (
  SELECT code, n, radians(s.lon + (CASE WHEN n IN (1, 2) THEN s.side ELSE 0 END)) AS lo,
         radians(s.lat + (CASE WHEN n IN (2, 3) THEN s.side ELSE 0 END)) AS la
  FROM big, (SELECT unnest([0, 1, 2, 3]) AS n)),
vecs AS (SELECT code, n, cos(la) * cos(lo) AS x, cos(la) * sin(lo) AS y, sin(la) AS z FROM corners),
sides AS (
  SELECT a.code, a.y * b.z - a.z * b.y AS x, a.z * b.x - a.x * b.z AS y, a.x * b.y - a.y * b.x AS z,
         a.x * b.x + a.y * b.y + a.z * b.z AS d
  FROM vecs a JOIN vecs b ON a.code = b.code AND b.n = (a.n + 1) % 4),
sized AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM sides),
mids AS (SELECT code, sum(x * atan2(l, d) / l) AS x, sum(y * atan2(l, d) / l) AS y, sum(z * atan2(l, d) / l) AS z
  FROM sized GROUP BY code)"""


@query("centroid_spherical", S.query(SPHERICAL, select=f"""
SELECT code, {r('degrees(atan2(y, x))')} AS lon, {r('degrees(atan2(z, sqrt(x * x + y * y)))')} AS lat FROM mids"""))
def _(ws: Workspace):
    return rounded(spatial.centroid(ws.boundaries, spherical=True), "lon", "lat")


@query("geo_distance", S.query(S.POINTS, select=f"""
SELECT a.unit AS i, b.unit AS j, {r(S.HAVERSINE, 3)} AS d1 FROM points a JOIN points b ON a.unit < b.unit"""))
def _(ws: Workspace):
    met = pairs.geo_distance(pairs.unit_pairs(ws.points, ["lon", "lat"], by=[]))
    return rounded(met.select("i", "j", "d1"), "d1", digits=3)


# Every vertex against every arc, in plain vector arithmetic; the squares lie apart.
BOUNDARY = f"""{SQUARES},
corner AS (
  SELECT code, part_id, n, radians(lon + (CASE WHEN n IN (1, 2) THEN side ELSE 0 END)) AS lo,
         radians(lat + (CASE WHEN n IN (2, 3) THEN side ELSE 0 END)) AS la
  FROM kept, (SELECT unnest([0, 1, 2, 3]) AS n)),
vec AS (SELECT code, part_id, n, cos(la) * cos(lo) AS x, cos(la) * sin(lo) AS y, sin(la) AS z FROM corner),
arc AS (
  SELECT a.code, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz,
         a.y * b.z - a.z * b.y AS nx, a.z * b.x - a.x * b.z AS ny, a.x * b.y - a.y * b.x AS nz
  FROM vec a JOIN vec b ON a.code = b.code AND a.part_id = b.part_id AND b.n = (a.n + 1) % 4),
near AS (
  SELECT v.code AS c1, a.code AS c2,
    CASE WHEN (ny * az - nz * ay) * x + (nz * ax - nx * az) * y + (nx * ay - ny * ax) * z >= 0
          AND (ny * bz - nz * by_) * x + (nz * bx - nx * bz) * y + (nx * by_ - ny * bx) * z <= 0
         THEN asin(least(1.0, abs(nx * x + ny * y + nz * z) / sqrt(nx * nx + ny * ny + nz * nz)))
         ELSE least(2 * asin(least(1.0, sqrt(pow(x - ax, 2) + pow(y - ay, 2) + pow(z - az, 2)) / 2)),
                    2 * asin(least(1.0, sqrt(pow(x - bx, 2) + pow(y - by_, 2) + pow(z - bz, 2)) / 2))) END AS d
  FROM vec v JOIN arc a ON a.code <> v.code)"""


@query("boundary_distance", S.query(BOUNDARY, select=f"""
SELECT least(c1, c2) AS i, greatest(c1, c2) AS j, {r('min(d) * 6371010.0', 3)} AS d1 FROM near GROUP BY ALL"""))
def _(ws: Workspace):
    areas = ws.boundaries.select(F.col("code").alias("unit"), "parts")
    return rounded(spatial.boundary_distance(areas), "d1", digits=3)


@query("range_normalise", b(f"SELECT scenario, i, j, {r('d0')} AS d0, {r('d1')} AS d1 FROM pairs"))
def _(ws: Workspace):
    return rounded(study.centroid_pairs(ws.units(TARGETS)), "d0", "d1")


# ---- dissimilarities -------------------------------------------------------

@query("global_max", b(f"SELECT scenario, {r('max(d0)')} AS max_value FROM raw_pairs GROUP BY scenario"))
def _(ws: Workspace):
    met = pairs.feature_distance(pairs.unit_pairs(ws.units(TARGETS), ["x"]))
    return rounded(stats.global_max(met, "d0"), "max_value")


SUPPLIERS = """raw_units AS MATERIALIZED (
  SELECT s_suppkey AS unit, s_nationkey AS nation, s_acctbal AS acctbal, avg(l_quantity) AS avg_qty,
         sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*)::DOUBLE AS n_lines,
         ((s_suppkey * 137.507764::DOUBLE) % 360) - 180 AS lon, ((s_suppkey * 77.319::DOUBLE) % 140) - 70 AS lat
  FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)"""
SUPPLIER_X = ["acctbal", "avg_qty", "revenue", "n_lines"]


def _scaled_suppliers() -> str:
    def one(c: str) -> str:
        return (f"({c} - (SELECT quantile_cont({c}, 0.5) FROM raw_units)) / nullif((SELECT quantile_cont({c}, 0.75)"
                f" - quantile_cont({c}, 0.25) FROM raw_units), 0) AS {c}")
    return "scaled_units AS MATERIALIZED (SELECT unit, nation, lon, lat, " + ", ".join(map(one, SUPPLIER_X)) + \
        " FROM raw_units)"


def _suppliers(ws: Workspace):
    return stats.robust_scale(written(views.supplier_units(ws.spark, ws.folder), "suppliers"), SUPPLIER_X)


@query("robust_scale", S.query(SUPPLIERS, _scaled_suppliers(), select="SELECT unit, " + ", ".join(
    f"{r(c)} AS {c}" for c in SUPPLIER_X) + " FROM scaled_units"))
def _(ws: Workspace):
    return rounded(_suppliers(ws).select("unit", *SUPPLIER_X), *SUPPLIER_X)


@query("feature_distance", S.query(S.nation_pairs(SETS), select=f"SELECT scenario, i, j, {r('d0')} AS d0 FROM raw_pairs"))
def _(ws: Workspace):
    units = ws.units(scenarios.scenario_columns(ws.wide))
    met = pairs.feature_distance(pairs.unit_pairs(units, ["x"]))
    return rounded(met.select("scenario", "i", "j", "d0"), "d0")


GRID = S.ALL_ALPHAS
ALPHA = "(alpha_step / 100.0)"


@query("blend_linear", b(f"SELECT scenario, i, j, alpha_step, {r(f'(1 - {ALPHA}) * d0 + {ALPHA} * d1')} AS d FROM pairs, alphas", GRID))
def _(ws: Workspace):
    d = pairs.blend_linear(pairs.with_alphas(ws.main.pairs, study.ALPHA_STEPS))
    return rounded(d.select("scenario", "i", "j", "alpha_step", "d"), "d")


@query("blend_rescale", b(f"""SELECT scenario, i, j, alpha_step, {r('d / max(d) OVER (PARTITION BY scenario, alpha_step)')} AS d
FROM (SELECT scenario, i, j, alpha_step, (1 - {ALPHA}) * d0 + {ALPHA} * d1 AS d FROM pairs, alphas)""", GRID))
def _(ws: Workspace):
    d = pairs.blend_rescale(pairs.blend_linear(pairs.with_alphas(ws.main.pairs, study.ALPHA_STEPS)))
    return rounded(d.select("scenario", "i", "j", "alpha_step", "d"), "d")


@query("blend_squared", b(f"SELECT scenario, i, j, alpha_step, {r(f'(1 - {ALPHA}) * d0 * d0 + {ALPHA} * d1 * d1')} AS d2 FROM pairs, alphas", GRID))
def _(ws: Workspace):
    d = pairs.blend_squared(pairs.with_alphas(ws.main.pairs, study.ALPHA_STEPS))
    return rounded(d.select("scenario", "i", "j", "alpha_step", "d2"), "d2")


# ---- trees and cuts --------------------------------------------------------

def tree_sql(mix: str) -> list[str]:
    return [GRID, S.tree(mix)]


MERGES = f"""SELECT DISTINCT cur.scenario, cur.alpha_step, cur.cid AS "left", prev.cid AS "right", {r('cur.h')} AS height
FROM tree cur JOIN tree prev ON prev.scenario = cur.scenario AND prev.alpha_step = cur.alpha_step
  AND prev.unit = cur.unit AND prev.step = cur.step - 1 WHERE prev.cid <> cur.cid"""


def _merges(tree):
    return rounded(tree.merges.select("scenario", "alpha_step", "left", "right", "height"), "height")


@query("ward_tree", b(MERGES, S.ALL_ALPHAS, S.tree()))
def _(ws: Workspace):
    return _merges(ws.main.tree)


@query("ward_tree_linear", b(MERGES, *tree_sql("linear")))
def _(ws: Workspace):
    return _merges(ward.ward_tree(ws.main.units, ws.main.pairs, study.ALPHA_STEPS, "linear"))


@query("ward_tree_sequential", b(MERGES, *tree_sql("squared")))
def _(ws: Workspace):
    return _merges(ward.ward_tree(ws.main.units, ws.main.pairs, study.ALPHA_STEPS, order="sequential"))


# Distances on the sphere as straight lines between unit vectors.
SUPPLIER_PAIRS = [SUPPLIERS, _scaled_suppliers(), "units AS MATERIALIZED (SELECT 'all' AS scenario, unit FROM scaled_units)",
                  """placed AS (SELECT unit, acctbal, avg_qty, revenue, n_lines,
  cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z
  FROM scaled_units),
raw_pairs AS MATERIALIZED (
  SELECT 'all' AS scenario, a.unit AS i, b.unit AS j,
         sqrt(pow(a.acctbal - b.acctbal, 2) + pow(a.avg_qty - b.avg_qty, 2) + pow(a.revenue - b.revenue, 2)
              + pow(a.n_lines - b.n_lines, 2)) AS d0,
         sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d1
  FROM placed a JOIN placed b ON a.unit < b.unit)""", S.PAIRS]
SUPPLIER_ALPHAS = [0, 60]


def _supplier_labels(alphas: str) -> str:
    return S.query(*SUPPLIER_PAIRS, S.alphas(alphas), S.tree(), S.labels(), select="SELECT alpha_step, k, unit, cluster FROM labels")


def _supplier_vectors(ws: Workspace):
    return _suppliers(ws).select(F.lit("all").alias("scenario"), "unit", F.array(*SUPPLIER_X).alias("x"), tiles.unit_point().alias("g"))


# Exact at any size: every round looks at all pairs of clusters.
@query("ward_tree_vectors", _supplier_labels(str(SUPPLIER_ALPHAS)))
def _(ws: Workspace):
    tree = tiles.ward_tree_vectors(_supplier_vectors(ws).drop("scenario"), SUPPLIER_ALPHAS)
    return cut.cut_tree(tree, list(range(2, study.K_MAX + 1))).drop("scenario")


# On a neighbour graph; exact up to graph_tree.DENSE units, as at the size where the SQL can follow.
@query("ward_tree_sparse", _supplier_labels("range(0, 101)"))
def _(ws: Workspace):
    tree = graph_tree.ward_tree_graph(_supplier_vectors(ws), study.ALPHA_STEPS)
    return cut.cut_tree(tree, list(range(2, study.K_MAX + 1))).drop("scenario")


LABELS = [S.ALL_ALPHAS, S.tree(), S.labels()]


@query("cut_tree", b("SELECT scenario, alpha_step, k, unit, cluster FROM labels", *LABELS))
def _(ws: Workspace):
    return cut.cut_tree(ws.main.tree, ws.main.ks)


@query("number_clusters", """SELECT c_nationkey, c_mktsegment, c_custkey,
  dense_rank() OVER (PARTITION BY c_nationkey ORDER BY cid)::INT AS cluster
FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS cid FROM customer)""")
def _(ws: Workspace):
    people = ws.star("customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    first = people.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("cid"))
    return stats.number_clusters(people.join(first, ["c_nationkey", "c_mktsegment"]), ["c_nationkey"])


COMBO_FILTER = "(k, alpha_step) IN ((4, 60), (5, 62), (4, 0), (5, 0))"
FINAL_ALPHAS = S.alphas("[0, 60, 62]")
FINAL = [FINAL_ALPHAS, S.tree(), S.labels(), f"final AS MATERIALIZED (SELECT * FROM labels WHERE {COMBO_FILTER})"]


@query("cluster_units", b(f"SELECT scenario, unit, {S.COMBO_COLUMN} AS name, cluster FROM final", *FINAL))
def _(ws: Workspace):
    return study.named_combos(ws.final, "column").select("scenario", "unit", F.col("key").alias("name"), "cluster")


@query("compose_key", b(f"SELECT DISTINCT scenario || ' - ' || {S.COMBO_KEY} AS key FROM final", *FINAL))
def _(ws: Workspace):
    keyed = study.named_combos(ws.final)
    return keyed.select(C.scenario_key(F.col("scenario"), F.col("key")).alias("key")).distinct()


@query("combo_rows", b("SELECT scenario, k, alpha_step, count(*) AS n_units FROM final GROUP BY ALL", *FINAL))
def _(ws: Workspace):
    combos = study.combo_rows(ws.spark)
    return stats.count_groups(reshape.filter_points(ws.final, combos), "scenario", "k", "alpha_step").withColumnRenamed("n", "n_units")


@query("join_labels", b(f"""SELECT scenario, unit, round(CASE scenario WHEN 'R12' THEN R12 ELSE R34 END, 4) AS value, k, alpha_step, cluster
FROM final JOIN points USING (unit) JOIN wide USING (code)""", *FINAL))
def _(ws: Workspace):
    joined = ws.target_values.join(ws.final, ["scenario", "unit"])
    return rounded(joined.select("scenario", "unit", "value", "k", "alpha_step", "cluster"), "value", digits=4)


@query("cluster_map_layer", S.query(BASE, *FINAL, SQUARES, select="""
SELECT scenario, k, alpha_step, code, count(DISTINCT part_id)::INT AS n_parts, max(cluster) AS cluster
FROM final JOIN points USING (unit) JOIN kept USING (code) GROUP BY ALL"""))
def _(ws: Workspace):
    layer = study.cluster_map_layer(ws.boundaries, ws.final.join(ws.points.select("unit", "code"), "unit"))
    path = new_folder(ws.spark, "cluster-maps")
    sinks.write_cluster_maps(layer, path)
    back = ws.spark.read.schema(layer.schema).parquet(path)
    return back.select("scenario", "k", "alpha_step", "code", F.size("parts").alias("n_parts"), "cluster")


# ---- inertia and the weight ------------------------------------------------

@query("total_inertia", b(f"SELECT scenario, {r('t0', 9)} AS t0, {r('t1', 9)} AS t1 FROM totals", S.TOTALS))
def _(ws: Workspace):
    return rounded(pairs.total_inertia(ws.main.pairs), "t0", "t1", digits=9)


@query("vector_inertia", """SELECT label, round(sum(s), 9) AS inertia FROM (
  SELECT label, pos, var_pop(v) AS s FROM (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
  GROUP BY ALL) GROUP BY label""")
def _(ws: Workspace):
    return rounded(tiles.vector_inertia(views.vec_units(ws.spark, ws.folder), by=["label"]), "inertia", digits=9)


QUALITY = [*LABELS, S.TOTALS, *S.quality()]


@query("explained_inertia", b(f"SELECT scenario, alpha_step, k, {r('q0')} AS q0, {r('q1')} AS q1 FROM explained", *QUALITY))
def _(ws: Workspace):
    q = inertia.explained_inertia(ws.main.tree, ws.main.totals, study.K_MAX)
    return rounded(q.select("scenario", "alpha_step", "k", "q0", "q1"), "q0", "q1")


@query("explained_inertia_direct", b(f"SELECT scenario, alpha_step, k, {r('q0')} AS q0, {r('q1')} AS q1 FROM explained", *QUALITY))
def _(ws: Workspace):
    labels = written(cut.cut_tree(ws.main.tree, ws.main.ks), "labels")
    q = inertia.explained_inertia_direct(labels, ws.main.pairs, ws.main.totals, ["alpha_step", "k"])
    return rounded(q.select("scenario", "alpha_step", "k", "q0", "q1"), "q0", "q1")


@query("normalised_inertia", b(f"SELECT scenario, alpha_step, k, {r('q0norm')} AS q0norm, {r('q1norm')} AS q1norm FROM q", *QUALITY))
def _(ws: Workspace):
    return rounded(ws.main.quality.select("scenario", "alpha_step", "k", "q0norm", "q1norm"), "q0norm", "q1norm")


@query("weighted_inertia", b(f"SELECT scenario, alpha_step, k, {r('tot')} AS tot FROM q", *QUALITY))
def _(ws: Workspace):
    return rounded(ws.main.quality.select("scenario", "alpha_step", "k", "tot"), "tot")


CHOSEN = [*QUALITY, S.STARS]


@query("alpha_star_balance", b("SELECT scenario, k, alpha_step FROM stars WHERE criterion = 'ch'", *CHOSEN))
def _(ws: Workspace):
    return inertia.alpha_star_balance(ws.main.quality)


@query("alpha_star_max", b("SELECT scenario, k, alpha_step FROM stars WHERE criterion = 'max'", *CHOSEN))
def _(ws: Workspace):
    return inertia.alpha_star_max(ws.main.quality)


def _extreme(goal: str, name: str) -> str:
    return b(S.smallest(goal, name=name), *QUALITY)


@query("argmin_alpha", _extreme("q0", "alpha_step"))
def _(ws: Workspace):
    return inertia.argmin_alpha(ws.main.quality, F.col("q0"))


@query("argmax_alpha", _extreme("-q0", "alpha_step"))
def _(ws: Workspace):
    return inertia.argmax_alpha(ws.main.quality, F.col("q0"))


@query("choose_alpha", b("SELECT scenario, criterion, k, alpha_step FROM stars", *CHOSEN))
def _(ws: Workspace):
    return ws.main.stars


@query("distinct_alphas", b("SELECT DISTINCT scenario, alpha_step FROM stars", *CHOSEN))
def _(ws: Workspace):
    return inertia.distinct_alphas(ws.main.stars)


@query("sort_alphas", b("""SELECT scenario, alpha_step, row_number() OVER (PARTITION BY scenario ORDER BY alpha_step)::INT AS position
FROM (SELECT DISTINCT scenario, alpha_step FROM stars)""", *CHOSEN))
def _(ws: Workspace):
    return inertia.sort_alphas(ws.main.stars)


@query("distinct_combos", b("SELECT DISTINCT scenario, k, alpha_step FROM stars WHERE k IN (2, 3, 4, 5, 8, 14)", *CHOSEN))
def _(ws: Workspace):
    return inertia.distinct_combos(ws.main.stars, study.GAIN_KS["R12"])


AT_STARS = f"""SELECT scenario, criterion, 1 AS k, NULL::INT AS alpha_step, 0.0::DOUBLE AS q0, 0.0::DOUBLE AS q1, 0.0::DOUBLE AS tot
FROM stars GROUP BY scenario, criterion
UNION ALL SELECT scenario, criterion, k, alpha_step, {r('q0')}, {r('q1')}, {r('tot')}
FROM stars JOIN q USING (scenario, k, alpha_step)"""


@query("inertia_at_alpha_star", b(AT_STARS, *CHOSEN))
def _(ws: Workspace):
    return rounded(ws.main.inertia_at_stars(), "q0", "q1", "tot")


@query("lookup_alpha", b(f"""SELECT scenario, criterion, k, alpha_step, {r('q0norm')} AS q0norm, {r('q1norm')} AS q1norm
FROM stars JOIN q USING (scenario, k, alpha_step)""", *CHOSEN))
def _(ws: Workspace):
    found = inertia.lookup_alpha(ws.main.quality, ws.main.stars)
    return rounded(found.select("scenario", "criterion", "k", "alpha_step", "q0norm", "q1norm"), "q0norm", "q1norm")


# ---- indices ---------------------------------------------------------------

def vec_sql(index: str) -> str:
    """One index of two given partitions of the embedding vectors."""
    return S.query("""raw_v AS (SELECT vec_id AS unit, label, (vec_id % 7)::INT AS mod7, unnest(range(1, 65)) AS pos,
  unnest(embedding)::DOUBLE AS v FROM embeddings),
columns AS MATERIALIZED (SELECT 'v' AS scenario, unit, pos, v FROM raw_v),
pairs AS MATERIALIZED (
  SELECT 'v' AS scenario, a.vec_id AS i, b.vec_id AS j,
         sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[])])) AS d0, 0.0 AS d1
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
parts AS MATERIALIZED (
  SELECT 'v' AS scenario, 0 AS alpha_step, 'label' AS key, vec_id AS unit, label AS cluster FROM embeddings
  UNION ALL SELECT 'v', 0, 'mod7', vec_id, (vec_id % 7)::INT FROM embeddings)""",
                   S.indices("parts", "alpha_step, key"),
                   select=f"SELECT key, {r('value')} AS value FROM scored WHERE index = '{index}'")


def _vector_index(ws: Workspace, index: str):
    found = tiles.vector_indices(views.vec_units(ws.spark, ws.folder), {"label": 0, "mod7": 0}, [index])
    return rounded(found.select("key", "value"), "value")


@query("silhouette", vec_sql("Sil"))
def _(ws: Workspace):
    return _vector_index(ws, "Sil")


@query("dunn", vec_sql("Dunn"))
def _(ws: Workspace):
    return _vector_index(ws, "Dunn")


@query("c_index", vec_sql("Cindex"))
def _(ws: Workspace):
    return _vector_index(ws, "Cindex")


@query("mcclain_rao", vec_sql("McClain"))
def _(ws: Workspace):
    return _vector_index(ws, "McClain")


@query("calinski_harabasz", vec_sql("CH"))
def _(ws: Workspace):
    units = views.vec_units(ws.spark, ws.folder).withColumn("scenario", F.lit("v"))
    labels = units.select("scenario", "unit", F.explode(F.array(
        F.struct(F.lit("label").alias("key"), F.col("label").alias("cluster")),
        F.struct(F.lit("mod7").alias("key"), F.col("mod7").alias("cluster")))).alias("p")).select(
        "scenario", "unit", "p.key", "p.cluster")
    found = indices.calinski_harabasz(units, labels, combos=["key"])
    return rounded(found.select("key", "value"), "value")


@query("indices_given_partition", b(f"SELECT scenario, alpha_step, k, index, {r('value')} AS value FROM scored",
                                    """regions AS MATERIALIZED (
  SELECT scenario, alpha_step, k, unit, cluster FROM (
    SELECT 5 AS k, n_nationkey::BIGINT AS unit, n_regionkey + 1 AS cluster FROM nation
    UNION ALL SELECT 4, n_nationkey::BIGINT, n_nationkey % 4 + 1 FROM nation),
  (SELECT DISTINCT scenario FROM units), (SELECT unnest(range(0, 101))::INT AS alpha_step))""",
                                    S.COLUMNS, *S.indices("regions")))
def _(ws: Workspace):
    given = pairs.with_alphas(ws.given_labels, study.ALPHA_STEPS)
    both = F.explode(F.array(*[F.lit(t) for t in TARGETS])).alias("scenario")
    clusters = F.when(F.col("key") == "region", 5).otherwise(4).alias("k")
    labels = given.select(both, "alpha_step", clusters, "unit", (F.col("cluster") + 1).alias("cluster"))
    return rounded(indices.five_indices(ws.main.pairs, ws.main.features, written(labels, "regions")), "value")


NEEDED = """linear_grid AS (SELECT DISTINCT alpha_step FROM stars UNION SELECT 0),
needed AS (SELECT DISTINCT scenario, k, alpha_step FROM stars UNION SELECT DISTINCT scenario, k, 0 FROM stars)"""
SCORED = [*CHOSEN, NEEDED, S.tree("linear", "lin", "linear_grid"), S.labels("lin", "lin_labels"),
          "chosen_labels AS MATERIALIZED (SELECT * FROM lin_labels SEMI JOIN needed USING (scenario, k, alpha_step))",
          S.COLUMNS, *S.indices("chosen_labels"),
          "by_criterion AS MATERIALIZED (SELECT scenario, criterion, k, alpha_step, index, value FROM stars JOIN scored USING (scenario, k, alpha_step))",
          """side_by_side AS MATERIALIZED (
  SELECT scenario, index, k, max(alpha_step) FILTER (WHERE criterion = 'ch') AS alpha_star_ch,
         max(value) FILTER (WHERE criterion = 'ch') AS index_ch,
         max(alpha_step) FILTER (WHERE criterion = 'max') AS alpha_star_max,
         max(value) FILTER (WHERE criterion = 'max') AS index_max
  FROM by_criterion GROUP BY ALL)"""]
SIDE = f"""SELECT scenario, index, k, alpha_star_ch, {r('index_ch')} AS index_ch, alpha_star_max, {r('index_max')} AS index_max
FROM side_by_side"""


@query("index_table", b(SIDE, *SCORED))
def _(ws: Workspace):
    return rounded(ws.main.index_table(), "index_ch", "index_max")


@query("union_indices", b(SIDE, *SCORED))
def _(ws: Workspace):
    table = ws.main.index_table()
    stacked = reshape.stacked(*[table.where(F.col("index") == i) for i in C.INDEX_LABELS])
    return rounded(stacked, "index_ch", "index_max")


@query("index_baseline", b(f"SELECT scenario, k, index, {r('value')} AS value FROM scored WHERE alpha_step = 0", *SCORED))
def _(ws: Workspace):
    return rounded(ws.main.index_baseline(), "value")


@query("unpivot_indices", b(f"SELECT scenario, k, index, {r('value')} AS value FROM scored WHERE alpha_step = 0", *SCORED))
def _(ws: Workspace):
    names = list(C.INDEX_LABELS)
    wide = ws.main.index_baseline().groupBy("scenario", "k").agg(
        *[F.max(F.when(F.col("index") == n, F.col("value"))).alias(n) for n in names])
    return rounded(reshape.unpivot(wide, ["scenario", "k"], names, "index", "value"), "value")


def _unpivot_sql(paired: bool) -> str:
    pairs_ = [("ch", "ch"), ("max", "max")] if paired else [(x, y) for x in ("ch", "max") for y in ("ch", "max")]
    return b("\nUNION ALL ".join(
        f"""SELECT scenario, index, k, 'Index_{v}' AS criterion, {r(f'index_{v}')} AS index_val, 'alpha_star_{a}' AS alpha,
  alpha_star_{a} AS alpha_val FROM side_by_side""" for v, a in pairs_), *SCORED)


def _each_target(table, make):
    """``make`` of the rows of each target, one table with the target as ``scenario``."""
    return reshape.stacked(*[make(table.where(F.col("scenario") == t)).withColumn("scenario", F.lit(t)) for t in ("R12", "R34")])


@query("unpivot_criteria", _unpivot_sql(True))
def _(ws: Workspace):
    return rounded(_each_target(ws.main.index_table(), reshape.unpivot_criteria), "index_val")


@query("unpivot_criteria_crossed", _unpivot_sql(False))
def _(ws: Workspace):
    return rounded(_each_target(ws.main.index_table(), lambda t: reshape.unpivot_criteria(t, paired=False)), "index_val")


GAIN = """joined AS (
  SELECT scenario, k, index, c.criterion, c.value AS index_val, s.value AS index_val0
  FROM by_criterion c FULL JOIN (SELECT scenario, k, index, value FROM scored WHERE alpha_step = 0) s USING (scenario, k, index)),
gains AS (
  SELECT scenario, index, k, criterion, (index_val - index_val0) / nullif(index_val0, 0) * 100 AS diff_index0 FROM joined
  WHERE (scenario = 'R12' AND k IN (2, 3, 4, 5, 8, 14)) OR (scenario = 'R34' AND k IN (2, 3, 4, 5, 15)))"""


@query("join_baseline", b(f"SELECT scenario, k, index, criterion, {r('index_val')} AS index_val, {r('index_val0')} AS index_val0 FROM joined", *SCORED, GAIN))
def _(ws: Workspace):
    chosen = ws.main.index_by_criterion.select("scenario", "k", "index", "criterion", F.col("value").alias("index_val"))
    base = ws.main.index_baseline().withColumnRenamed("value", "index_val0")
    return rounded(study.join_baseline(chosen, base), "index_val", "index_val0")


# The sign of a change that rounds to nothing is noise: it counts as no loss.
@query("gain_loss", b(f"""SELECT scenario, index, k, criterion, {r('diff_index0', 4)} AS diff_index0,
  CASE WHEN round(diff_index0, 4) >= 0 THEN 'up' WHEN diff_index0 < 0 THEN 'down' END AS part FROM gains""", *SCORED, GAIN))
def _(ws: Workspace):
    gains = rounded(ws.main.gain_loss(study.GAIN_KS).drop("part"), "diff_index0", digits=4)
    return gains.withColumn("part", C.sign_part(F.col("diff_index0")))


@query("best_k", b(f"""SELECT scenario, index, criterion, e.k AS k, {r('e.v')} AS value FROM (
  SELECT scenario, index, criterion, min(struct_pack(g := CASE WHEN index IN ('Cindex', 'McClain') THEN value ELSE -value END,
         k := k, v := value)) AS e FROM by_criterion WHERE value IS NOT NULL GROUP BY ALL)""", *SCORED))
def _(ws: Workspace):
    return rounded(ws.main.best_k(), "value")


# ---- Fixed values: the points the analysis marks, per target ------------
MARKED = [("R12", "Cindex", "ch", 4), ("R12", "Cindex", "max", 4), ("R12", "CH", "ch", 4), ("R12", "CH", "max", 5),
          ("R12", "Dunn", "max", 14), ("R12", "Dunn", "ch", 8), ("R12", "McClain", "ch", 2), ("R12", "McClain", "max", 2),
          ("R12", "Sil", "ch", 3), ("R12", "Sil", "max", 5),
          ("R34", "Cindex", "max", 5), ("R34", "Cindex", "ch", 15), ("R34", "CH", "ch", 3), ("R34", "CH", "max", 4),
          ("R34", "Dunn", "max", 3), ("R34", "Dunn", "ch", 4), ("R34", "McClain", "ch", 2), ("R34", "McClain", "max", 2),
          ("R34", "Sil", "ch", 3), ("R34", "Sil", "max", 4)]
# -------------------------------------------------------------------------
MARKED_SQL = b(f"""SELECT scenario, index, criterion, k, {r('value')} AS value FROM by_criterion
WHERE (scenario, index, criterion, k) IN ({', '.join(map(str, MARKED))})""", *SCORED)


@query("filter_points", MARKED_SQL)
@query("marked_points", MARKED_SQL)
def _(ws: Workspace):
    marks = ws.spark.createDataFrame(MARKED, "scenario string, index string, criterion string, k int")
    hit = reshape.filter_points(ws.main.index_by_criterion, marks)
    return rounded(hit.select("scenario", "index", "criterion", "k", "value"), "value")


@query("index_plot_table", b("\nUNION ALL ".join(
    f"SELECT scenario, {S.LABEL_CASE} AS index, k, {S.criterion_case(f'''{chr(39)}Index_{v}{chr(39)}''')} AS criterion, {r(f'index_{v}')} AS index_val FROM side_by_side"
    for v in ("ch", "max")), *SCORED))
def _(ws: Workspace):
    return rounded(_each_target(ws.main.index_table(), study.index_plot_table), "index_val")


@query("alpha_plot_table", b("\nUNION ".join(
    f"SELECT scenario, k, {S.criterion_case(f'''{chr(39)}alpha_star_{v}{chr(39)}''')} AS criterion, alpha_star_{v} / 100.0 AS alpha_star FROM side_by_side"
    for v in ("ch", "max")), *SCORED))
def _(ws: Workspace):
    return _each_target(ws.main.index_table(), study.alpha_plot_table)


# ---- comparison and profiles -----------------------------------------------

def _profile_sql(source: str, keys: str) -> str:
    """Moments from deviations, so that large values lose no digits."""
    return f"""centred AS (SELECT *, v - avg(v) OVER (PARTITION BY {keys}) AS e, avg(v) OVER (PARTITION BY {keys}) AS m FROM {source}),
profiled AS (
  SELECT {keys}, max(m) AS mean, stddev_samp(v) AS sd,
         CASE WHEN max(abs(e)) > 0 THEN avg(e * e * e) / pow(avg(e * e), 1.5) END AS skew,
         CASE WHEN max(abs(e)) > 0 THEN avg(e * e * e * e) / (avg(e * e) * avg(e * e)) END AS kurt
  FROM centred GROUP BY {keys})"""


@query("cluster_profile", S.query("people AS (SELECT c_mktsegment AS scenario, c_nationkey AS cluster, c_acctbal AS v FROM customer)",
                                  _profile_sql("people", "scenario, cluster"), select=f"""
SELECT scenario, cluster, {r('mean')} AS mean, {r('sd')} AS sd, {r('skew')} AS skew, {r('kurt')} AS kurt FROM profiled"""))
def _(ws: Workspace):
    people = ws.star("customer").select(F.col("c_custkey").alias("unit"), "c_acctbal")
    labels = ws.star("customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("scenario"),
                                        F.col("c_nationkey").alias("cluster"))
    out = stats.cluster_profile(people, labels, "c_acctbal", ["scenario"])
    return rounded(out, "mean", "sd", "skew", "kurt")


def _final_profiles(ws: Workspace):
    return study.profiles(ws.target_values, ws.final, "value")


PROFILE = [*FINAL, """valued AS (
  SELECT scenario, k, alpha_step, cluster, CASE scenario WHEN 'R12' THEN R12 ELSE R34 END AS v
  FROM final JOIN points USING (unit) JOIN wide USING (code))""",
           _profile_sql("valued", "scenario, k, alpha_step, cluster")]


@query("write_cluster_profiles", b(f"""SELECT scenario, {S.COMBO_COLUMN} AS sheet, cluster, {r('mean', 4)} AS mean, {r('sd', 4)} AS sd,
  {r('skew', 4)} AS skew, {r('kurt', 4)} AS kurt FROM profiled""", *PROFILE))
def _(ws: Workspace):
    path = new_folder(ws.spark, "profiles")
    sinks.write_cluster_profiles(_final_profiles(ws).select(
        "scenario", "sheet", "cluster", "mean", "sd", "skew", "kurt"), path)
    back = ws.spark.read.schema("scenario string, cluster int, mean double, sd double, skew double, kurt double, "
                                "sheet string").parquet(path)
    return rounded(back, "mean", "sd", "skew", "kurt", digits=4)


@query("contingency", """SELECT 'label' AS left_key, 'mod7' AS right_key, label AS "left", (vec_id % 7)::INT AS "right", count(*) AS n
FROM embeddings GROUP BY ALL
UNION ALL SELECT 'label', 'label', label, label, count(*) FROM embeddings GROUP BY ALL
UNION ALL SELECT 'mod7', 'mod7', (vec_id % 7)::INT, (vec_id % 7)::INT, count(*) FROM embeddings GROUP BY ALL""")
def _(ws: Workspace):
    return compare.contingency(_vec_partitions(ws))


def _vec_partitions(ws: Workspace):
    both = F.explode(F.array(F.struct(F.lit("label").alias("key"), F.col("label").alias("cluster")),
                             F.struct(F.lit("mod7").alias("key"), F.col("mod7").alias("cluster")))).alias("p")
    return views.vec_units(ws.spark, ws.folder).select("unit", both).select("p.key", "unit", "p.cluster")


@query("adjusted_rand", S.query("""given AS (SELECT 'label' AS key, vec_id AS unit, label AS cluster FROM embeddings
  UNION ALL SELECT 'mod7', vec_id, (vec_id % 7)::INT FROM embeddings)""", S.ari("given"),
                                select=f"SELECT left_key, right_key, {r('ari')} AS ari FROM agreement"))
def _(ws: Workspace):
    return rounded(compare.adjusted_rand(_vec_partitions(ws)), "ari")


@query("adjusted_rand_given", S.query(GIVEN, S.ari("given"), select=f"SELECT left_key, right_key, {r('ari')} AS ari FROM agreement"))
def _(ws: Workspace):
    return rounded(compare.adjusted_rand(ws.given_labels), "ari")


KEYED = [*FINAL, f"keyed AS MATERIALIZED (SELECT scenario || '|' || {S.COMBO_KEY} AS key, unit, cluster FROM final)", S.ari("keyed"),
         """within AS (SELECT split_part(left_key, '|', 1) AS scenario, split_part(left_key, '|', 2) AS left_key,
  split_part(right_key, '|', 2) AS right_key, ari FROM agreement WHERE split_part(left_key, '|', 1) = split_part(right_key, '|', 1))"""]
COMBO_NAMES = ["K=4 & Alpha=0.6", "K=5 & Alpha=0.62", "K=4 & Alpha=0", "K=5 & Alpha=0"]


@query("ari_matrix", b(f"SELECT scenario, left_key, right_key, {r('ari')} AS ari FROM within", *KEYED))
def _(ws: Workspace):
    return rounded(_each_target(ws.final, study.ari_matrix), "ari")


@query("write_ari", b("SELECT scenario, left_key, " + ", ".join(
    f"""{r(f"max(ari) FILTER (WHERE right_key = '{n}')")} AS "{n}" """ for n in COMBO_NAMES)
    + " FROM within GROUP BY scenario, left_key", *KEYED))
def _(ws: Workspace):
    def wrote(labels):
        path = new_folder(ws.spark, "ari")
        sinks.write_ari(study.ari_matrix(labels), COMBO_NAMES, path)
        return ws.spark.read.parquet(path)
    return rounded(_each_target(ws.final, wrote), *COMBO_NAMES)


# ---- scenarios -------------------------------------------------------------

SETS_FINAL = [S.nation_pairs(SETS), *FINAL]


@query("scenario_run", S.query(*SETS_FINAL, select="SELECT scenario, k, alpha_step, unit, cluster FROM final"))
def _(ws: Workspace):
    return ws.scenario_labels.select("scenario", "k", "alpha_step", "unit", "cluster")


@query("union_scenarios", S.query(*SETS_FINAL, select="""
SELECT scenario, k, alpha_step, count(*) AS n_units, max(cluster) AS clusters FROM final GROUP BY ALL"""))
def _(ws: Workspace):
    names = [r_[0] for r_ in ws.scenario_labels.select("scenario").distinct().collect()]
    each = [ws.scenario_labels.where(F.col("scenario") == n) for n in names]
    return reshape.stacked(*each).groupBy("scenario", "k", "alpha_step").agg(
        F.count(F.lit(1)).alias("n_units"), F.max("cluster").alias("clusters"))


@query("scenario_coherence", S.query(*SETS_FINAL,
                                     f"keyed AS MATERIALIZED (SELECT scenario || ' - ' || {S.COMBO_KEY} AS key, unit, cluster FROM final)",
                                     S.ari("keyed"), select=f"""
SELECT left_key AS reg1, right_key AS reg2, 'AdjRanIndex' AS name, {r('ari')} AS value,
       {r('(ari - avg(ari) OVER ()) / nullif(stddev_samp(ari) OVER (), 0)')} AS value_std FROM agreement"""))
def _(ws: Workspace):
    return rounded(study.scenario_coherence(ws.scenario_labels), "value", "value_std")


# ---- the flagship ----------------------------------------------------------

FLAG_ALPHA = 60


def flagship(spark, folder: str):
    """Profile of the four clusters of nations at K = 4 and weight 0.6, from the raw tables."""
    ws = Workspace(spark, folder)
    units = written(ws.units({"R12": ["R12"]}), "units")
    labels = study.final_study(units, written(study.centroid_pairs(units), "pairs"), [(4, FLAG_ALPHA)])
    values = ws.target_values.where("scenario = 'R12'").drop("scenario")
    return rounded(study.profiles(values, labels, "value").drop("sheet"), "mean", "sd", "skew", "kurt", digits=4)


@query("minimum_slice", S.query(S.nation_pairs({"R12": ["R12"]}), S.alphas("[60]"), S.tree(), S.labels(), """valued AS (
  SELECT scenario, k, alpha_step, cluster, R12 AS v FROM labels JOIN points USING (unit) JOIN wide USING (code) WHERE k = 4)""",
                                _profile_sql("valued", "scenario, k, alpha_step, cluster"), select=f"""
SELECT scenario, k, alpha_step, cluster, {r('mean', 4)} AS mean, {r('sd', 4)} AS sd, {r('skew', 4)} AS skew, {r('kurt', 4)} AS kurt
FROM profiled"""))
def _(ws: Workspace):
    return flagship(ws.spark, ws.folder)
