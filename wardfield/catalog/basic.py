"""Sources, sinks, projections, joins and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import compare, pairs, reshape, stats
from ..plans import scenarios, study
from ..sources import sinks, tables, views
from ..state import new_folder
from . import sqltext as S
from .registry import Workspace, by_size, by_size_sql, query, rounded

FULL, EARLY = views.FULL, views.EARLY
PANEL_ROUNDED = f"{by_size_sql(EARLY)} AS {EARLY}, {by_size_sql(FULL)} AS {FULL}"
HIGH = "Medium-high and high climate awareness"
LOW = "Medium-low and low climate awareness"

# Squares of the synthetic boundaries: one row per part.
SQUARES = """squares AS MATERIALIZED (
  SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS code, 'Country' AS type, 0 AS part_id,
         -100.0::DOUBLE + 40 * (n_nationkey % 5) AS lon, -50.0::DOUBLE + 20 * (n_nationkey // 5) AS lat,
         8.0::DOUBLE + 2 * (n_nationkey % 3) AS side
  FROM nation
  UNION ALL
  SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0'), 'Country', 1, -100.0 + 40 * (n_nationkey % 5) + 14,
         -50.0 + 20 * (n_nationkey // 5) + 14, 1.0
  FROM nation WHERE n_nationkey % 4 = 0
  UNION ALL SELECT 'X98', 'Country', 0, 150.0, -20.0, 5.0 FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT 'X99', 'Dependency', 0, 165.0, -20.0, 5.0 FROM nation WHERE n_nationkey = 0),
kept AS MATERIALIZED (SELECT * FROM squares WHERE type IN ('Sovereign country', 'Country', 'Sovereignty'))"""


def p(select: str) -> str:
    return S.query(S.PANEL, select=select)


def w(select: str) -> str:
    return S.query(S.PANEL, S.WIDE, select=select)


# ---- sources and sinks -----------------------------------------------------

@query("load_panel", p(f"SELECT code, entity, variable, {PANEL_ROUNDED} FROM panel"))
def _(ws: Workspace):
    return by_size(tables.load_panel(ws.spark, ws.panel_path, views.PERIODS), EARLY, FULL)


@query("load_boundaries", S.query(SQUARES, select="""
SELECT code, part_id::INT AS part_id, 5 AS n_points, lon AS west, lon + side AS east, lat AS south, lat + side AS north
FROM kept"""))
def _(ws: Workspace):
    rings = tables.load_boundaries(ws.spark, ws.boundaries_path).select("code", F.explode("parts").alias("p"))
    return rings.select("code", "p.part_id", F.size("p.ring").alias("n_points"),
                        F.array_min("p.ring.lon").alias("west"), F.array_max("p.ring.lon").alias("east"),
                        F.array_min("p.ring.lat").alias("south"), F.array_max("p.ring.lat").alias("north"))


@query("panel_summary", p("\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1,
  round(quantile_cont({c}, 0.5), 4) AS median, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.75), 4) AS q3,
  round(max({c}), 4) AS max, count(*) - count({c}) AS n_missing FROM panel""" for c in (EARLY, FULL))))
def _(ws: Workspace):
    return rounded(stats.panel_summary(ws.panel, views.PERIODS), "min", "q1", "median", "mean", "q3", "max", digits=4)


@query("obs_per_unit", p("SELECT code, entity, count(*) AS n FROM panel GROUP BY code, entity"))
def _(ws: Workspace):
    return stats.count_groups(ws.panel, "code", "entity")


@query("obs_per_variable", p("SELECT variable, count(*) AS n FROM panel GROUP BY variable"))
def _(ws: Workspace):
    return stats.count_groups(ws.panel, "variable")


@query("map_layer", S.query(S.PANEL, SQUARES, select=f"""
SELECT code, max(entity) AS entity, count(DISTINCT part_id)::INT AS n_parts, {by_size_sql(f"max({EARLY})")} AS fill
FROM kept LEFT JOIN (SELECT * FROM panel WHERE variable = 'R34') USING (code) GROUP BY code"""))
def _(ws: Workspace):
    layer = study.map_layer(ws.boundaries, ws.panel, "R34", EARLY)
    return by_size(layer.select("code", "entity", F.size("parts").alias("n_parts"), "fill"), "fill")


# ---- projections, filters, scalar functions --------------------------------

@query("select_rename", w('SELECT code AS "Code", entity, round(R12, 6) AS "R" FROM wide'))
def _(ws: Workspace):
    return rounded(reshape.pick(ws.wide, {"Code": "code", "entity": "entity", "R": "R12"}), "R")


@query("select_period", p(f"""SELECT code, variable, {by_size_sql(EARLY)} AS period, FALSE AS missing_period_kept FROM panel"""))
def _(ws: Workspace):
    chosen = reshape.with_period(ws.panel, EARLY, ["code", "variable"])
    absent = reshape.with_period(ws.panel, "avg_1900_1901", ["code", "variable"])
    return by_size(chosen, "period").withColumn(
        "missing_period_kept", F.lit("period" in absent.columns))


@query("drop_columns", w("""SELECT code, entity, round(R12, 6) AS "R12", round(HDI, 6) AS "HDI",
  round(rgdpna, 2) AS rgdpna, round(TradeOpenness, 6) AS "TradeOpenness", round(cdd, 4) AS cdd,
  round(tas, 4) AS tas, round(UrgentShare, 6) AS "UrgentShare" FROM wide"""))
def _(ws: Workspace):
    kept = reshape.drop_columns(ws.wide, scenarios.ALWAYS_DROPPED + scenarios.OTHER_TARGET)
    return rounded(rounded(rounded(kept, "R12", "HDI", "TradeOpenness", "UrgentShare"), "cdd", "tas", digits=4),
                   "rgdpna", digits=2)


UNMATCHED = [v for v in views.VARIABLES if scenarios.DROPPED_PATTERN.lower() not in v.lower()]


def _sized(names: list[str]) -> str:
    return ", ".join(f'{by_size_sql(v)} AS "{v}"' for v in names)


@query("drop_matching", w(f"SELECT code, entity, {_sized(UNMATCHED)} FROM wide"))
def _(ws: Workspace):
    return by_size(reshape.drop_matching(ws.wide, scenarios.DROPPED_PATTERN), *UNMATCHED)


@query("select_numeric_except", S.query(S.PANEL, S.WIDE, S.POINTS, select=f"""
SELECT {_sized(views.VARIABLES)}, unit FROM wide JOIN points USING (code)"""))
def _(ws: Workspace):
    table = ws.wide.join(ws.points, "code")
    return by_size(table.select(*reshape.numeric_columns(table)), *views.VARIABLES)


@query("drop_geometry", S.query(S.PANEL, SQUARES, select=f"""
SELECT code, entity, variable, {by_size_sql(FULL)} AS {FULL}
FROM (SELECT DISTINCT code FROM kept) JOIN panel USING (code)"""))
def _(ws: Workspace):
    joined = reshape.known_units(reshape.join_geometry(ws.boundaries, ws.panel))
    return by_size(reshape.drop_geometry(joined).drop(EARLY), FULL)


@query("filter_not_null", S.query(S.PANEL, SQUARES, select="""
SELECT code, count(*) AS n FROM (SELECT DISTINCT code FROM kept) LEFT JOIN panel USING (code)
WHERE entity IS NOT NULL GROUP BY code"""))
def _(ws: Workspace):
    return stats.count_groups(reshape.known_units(reshape.join_geometry(ws.boundaries, ws.panel)), "code")


@query("filter_in", p(f"SELECT code, variable, {by_size_sql(FULL)} AS value FROM panel WHERE variable IN ('R12', 'R34')"))
def _(ws: Workspace):
    hit = ws.panel.where(C.in_list(F.col("variable"), ["R12", "R34"]))
    return by_size(hit.select("code", "variable", F.col(FULL).alias("value")), "value")


@query("filter_not_in", p(f"SELECT code, variable, {by_size_sql(FULL)} AS value FROM panel WHERE variable NOT IN ('R12', 'R34')"))
def _(ws: Workspace):
    hit = ws.panel.where(C.not_in_list(F.col("variable"), ["R12", "R34"]))
    return by_size(hit.select("code", "variable", F.col(FULL).alias("value")), "value")


@query("split_by_sign", w("""SELECT code, CASE WHEN R34 - avg_all >= 0 THEN 'up' ELSE 'down' END AS part
FROM wide, (SELECT avg(R34) AS avg_all FROM wide)"""))
def _(ws: Workspace):
    middle = ws.wide.agg(F.avg("R34")).first()[0]
    return ws.wide.select("code", C.sign_part(F.col("R34") - F.lit(middle)).alias("part"))


@query("recode", p(f"""SELECT code, CASE variable WHEN 'R12' THEN '{LOW}' WHEN 'R34' THEN '{HIGH}' ELSE variable END AS label,
  count(*) AS n FROM panel GROUP BY ALL"""))
def _(ws: Workspace):
    return stats.count_groups(ws.panel.select(
        "code", C.recode(F.col("variable"), {"R12": LOW, "R34": HIGH}).alias("label")), "code", "label")


@query("match_pattern", p("""SELECT variable, CASE WHEN variable LIKE '%Share%' THEN 'share' WHEN variable LIKE '%d%' THEN 'has d'
  ELSE variable END AS label, count(*) AS n FROM panel GROUP BY ALL"""))
def _(ws: Workspace):
    rules = [("Share", "share"), ("d", "has d")]
    return stats.count_groups(ws.panel.select(
        "variable", C.recode_matching(F.col("variable"), rules).alias("label")), "variable", "label")


@query("cast_numeric", """SELECT o_orderkey, try_cast(trim(split_part(o_orderpriority, '-', 1)) AS DOUBLE) AS rank,
  try_cast(trim(o_orderpriority) AS DOUBLE) AS bad FROM orders""")
def _(ws: Workspace):
    return ws.star("orders").select(
        "o_orderkey", C.cast_numeric(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("rank"),
        C.cast_numeric(F.col("o_orderpriority")).alias("bad"))


@query("cast_label", """SELECT trim(l_linenumber::VARCHAR) AS line, count(*) AS n FROM lineitem GROUP BY ALL""")
def _(ws: Workspace):
    return stats.count_groups(ws.star("lineitem").select(C.cast_label(F.col("l_linenumber")).alias("line")), "line")


@query("scale_units", w("SELECT code, round(TradeOpenness * 1000, 6) AS value FROM wide"))
def _(ws: Workspace):
    return rounded(ws.wide.select("code", (F.col("TradeOpenness") * 1000).alias("value")), "value")


@query("pct_change", p(f"""SELECT code, variable, round(({FULL} - {EARLY}) / nullif({EARLY}, 0) * 100, 6) + 0.0 AS change FROM panel"""))
def _(ws: Workspace):
    change = C.pct_change(F.col(FULL), F.col(EARLY))
    return rounded(ws.panel.select("code", "variable", change.alias("change")), "change")


@query("alpha_grid", S.query(S.POINTS, S.ALL_ALPHAS, select="""
SELECT unit, alpha_step, alpha_step / 100.0 AS alpha FROM points, alphas"""))
def _(ws: Workspace):
    grid = pairs.with_alphas(ws.points.select("unit"), study.ALPHA_STEPS)
    return grid.withColumn("alpha", C.alpha_of(F.col("alpha_step")))


@query("grid_cross", S.query(S.POINTS, S.ALL_ALPHAS, select="""
SELECT unit, k, alpha_step FROM points, alphas, (SELECT unnest(range(2, 16))::INT AS k)"""))
def _(ws: Workspace):
    return pairs.grid_cross(ws.points.select("unit"), list(range(2, study.K_MAX + 1)), study.ALPHA_STEPS)


@query("row_index", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS idx FROM customer")
def _(ws: Workspace):
    return reshape.row_index(ws.star("customer").select("c_custkey"), "c_custkey")


@query("bulk_rename", w("SELECT code, entity, " + ", ".join(
    f'{by_size_sql(v)} AS "{ {"R12": LOW, "R34": HIGH}.get(v, v) }"' for v in views.VARIABLES) + " FROM wide"))
def _(ws: Workspace):
    return reshape.bulk_rename(by_size(ws.wide, *views.VARIABLES), {"R12": LOW, "R34": HIGH})


# ---- joins -----------------------------------------------------------------

@query("join_geometry", S.query(S.PANEL, SQUARES, select=f"""
SELECT code, entity, variable, {by_size_sql(FULL)} AS value
FROM (SELECT DISTINCT code FROM kept) LEFT JOIN panel USING (code)"""))
def _(ws: Workspace):
    joined = reshape.join_geometry(ws.boundaries, ws.panel)
    return by_size(joined.select("code", "entity", "variable", F.col(FULL).alias("value")), "value")


@query("join_features_centroids", S.query(S.PANEL, S.WIDE, S.POINTS, S.scaled(views.VARIABLES), select="SELECT unit, " + ", ".join(
    f"round({v}, 6) + 0.0 AS {v}" for v in views.VARIABLES) + """, round(lon, 6) AS lon, round(lat, 6) AS lat
FROM scaled JOIN points USING (code)"""))
def _(ws: Workspace):
    both = stats.robust_scale(ws.wide, views.VARIABLES).join(ws.points, "code")
    return rounded(both.select("unit", *views.VARIABLES, "lon", "lat"), *views.VARIABLES, "lon", "lat")


@query("unit_pairs", S.query(S.POINTS, select="""
SELECT a.unit AS i, b.unit AS j FROM points a JOIN points b ON a.unit < b.unit"""))
def _(ws: Workspace):
    return pairs.unit_pairs(ws.points.select("unit"), [], by=[])


GIVEN = """given AS (
  SELECT 'region' AS key, n_nationkey::BIGINT AS unit, n_regionkey AS cluster FROM nation
  UNION ALL SELECT 'mod4', n_nationkey, n_nationkey % 4 FROM nation)"""


@query("partition_pairs", S.query(GIVEN, select="""
SELECT a.key AS left_key, b.key AS right_key, unit, a.cluster AS "left", b.cluster AS "right"
FROM given a JOIN given b USING (unit) WHERE a.key <= b.key"""))
def _(ws: Workspace):
    return compare.partition_pairs(ws.given_labels)


# ---- reshape ---------------------------------------------------------------

@query("pivot_variables", w("SELECT code, entity, " + ", ".join(
    f'{by_size_sql(v)} AS "{v}"' for v in views.VARIABLES) + " FROM wide"))
def _(ws: Workspace):
    wide = reshape.pivot_variables(ws.panel, views.VARIABLES, FULL)
    return by_size(wide, *views.VARIABLES)


@query("unpivot_rest", w(f"""SELECT code, entity, name, {by_size_sql("value")} AS value
FROM (SELECT code, entity, {", ".join(f'{v} AS "{v}"' for v in views.VARIABLES)} FROM wide)
UNPIVOT INCLUDE NULLS (value FOR name IN ({", ".join(f'"{v}"' for v in views.VARIABLES)}))"""))
def _(ws: Workspace):
    return by_size(reshape.unpivot_rest(ws.wide.select("code", "entity", *views.VARIABLES)), "value")


@query("pivot_partitions", "SELECT n_nationkey::BIGINT AS unit, n_regionkey AS region, n_nationkey % 4 AS mod4 FROM nation")
def _(ws: Workspace):
    return compare.pivot_partitions(ws.given_labels, ["region", "mod4"])


# ---- counts, quantiles, correlation ----------------------------------------

@query("count_groups", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def _(ws: Workspace):
    return stats.count_groups(ws.star("lineitem"), "l_suppkey", "l_returnflag")


def _robust_sql(columns, table):
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS variable, round(quantile_cont({c}, 0.5), 6) AS median,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM {table}""" for c in columns)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("robust_stats", _robust_sql(MEASURES, "lineitem"))
def _(ws: Workspace):
    return rounded(stats.robust_stats(ws.star("lineitem"), MEASURES), "median", "iqr")


CORR_COLUMNS = ["R12", "R34", "HDI", "rgdpna", "TradeOpenness", "cdd", "tas", "UrgentShare"]
NAMED = {**{c: c for c in CORR_COLUMNS}, "R34": HIGH, "R12": LOW}
CORR = S.query(S.PANEL, S.WIDE, "corr_cells AS (" + "\nUNION ALL ".join(
    f"SELECT '{NAMED[a]}' AS reg1, '{NAMED[b]}' AS reg2, corr({a}, {b}) AS value FROM wide"
    for a in CORR_COLUMNS for b in CORR_COLUMNS) + ")", select="")
ZSCORED = """SELECT reg1, reg2, 'Corr2021' AS name, value,
  (value - avg(value) OVER ()) / nullif(stddev_samp(value) OVER (), 0) AS value_std FROM corr_cells"""


def _correlations(ws: Workspace):
    named = reshape.bulk_rename(ws.wide, {"R34": HIGH, "R12": LOW})
    return stats.correlation_matrix(named, [NAMED[c] for c in CORR_COLUMNS])


@query("correlation_matrix", CORR + "SELECT reg1, reg2, round(value, 6) + 0.0 AS value FROM corr_cells")
def _(ws: Workspace):
    return rounded(_correlations(ws), "value")


# The labels written on the cells of the correlation chart.
@query("round_label", CORR + "SELECT reg1, reg2, round(value, 2) + 0.0 AS label FROM corr_cells")
def _(ws: Workspace):
    return _correlations(ws).select("reg1", "reg2", C.round_label(F.col("value")).alias("label"))


@query("melt_matrix", CORR + "SELECT reg1, reg2, round(value, 6) + 0.0 AS value FROM corr_cells WHERE NOT isnan(value)")
def _(ws: Workspace):
    return rounded(stats.melt_matrix(_correlations(ws)), "value")


@query("zscore_by_group", """SELECT l_orderkey, l_linenumber, l_returnflag, round((l_quantity - m) / nullif(s, 0), 6) + 0.0 AS value_std
FROM lineitem JOIN (SELECT l_returnflag, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY ALL)
USING (l_returnflag)""")
def _(ws: Workspace):
    lines = ws.star("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rounded(stats.zscore_by_group(lines, "l_quantity", "l_returnflag").drop("l_quantity"), "value_std")


@query("heatmap_table", CORR + f"""SELECT reg1, reg2, name, round(value, 6) + 0.0 AS value, round(value_std, 6) + 0.0 AS value_std
FROM ({ZSCORED}) WHERE reg1 IN ('{HIGH}', '{LOW}')""")
def _(ws: Workspace):
    return rounded(stats.heatmap_table(_correlations(ws), "Corr2021", [HIGH, LOW]), "value", "value_std")


@query("heatmap_table_full", CORR + f"""SELECT reg1, reg2, name, round(value, 6) + 0.0 AS value, round(value_std, 6) + 0.0 AS value_std
FROM ({ZSCORED})""")
def _(ws: Workspace):
    return rounded(stats.heatmap_table(_correlations(ws), "Corr2021"), "value", "value_std")
