"""SQL building blocks: the same inputs and steps stated as common table expressions.

Each constant is one or more CTEs without the leading WITH; :func:`query` puts
them together in order.
"""

from __future__ import annotations

from ..functions.columns import CRITERION_LABELS, INDEX_LABELS

FULL, EARLY = "avg_1995_2001", "avg_1995_1998"
VARIABLES = ["R12", "R34", "hd40", "HDI", "rgdpna", "TradeOpenness", "cdd", "tas", "UrgentShare"]

_MEASURES = {
    "R34": "avg(o_totalprice)",
    "hd40": "avg(l_tax)",
    "HDI": "avg(l_quantity)",
    "rgdpna": "sum(l_extendedprice)",
    "TradeOpenness": "avg(l_discount)",
    "cdd": "avg(l_extendedprice * (1 - l_discount))",
    "tas": "stddev_samp(o_totalprice)",
    "UrgentShare": "avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END)",
}


def _panel() -> str:
    cols = ",\n  ".join(
        f"{m} AS {v}_f, {m} FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') AS {v}_e"
        for v, m in _MEASURES.items())
    rows = "\n  UNION ALL ".join(
        f"SELECT nk, '{v}' AS variable, {v}_e::DOUBLE AS {EARLY}, {v}_f::DOUBLE AS {FULL} FROM measured"
        for v in _MEASURES)
    return f"""f AS (
  SELECT n_nationkey AS nk, o_totalprice, o_orderdate, o_orderpriority, l_tax, l_quantity,
         l_extendedprice, l_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
measured AS (SELECT nk, {cols} FROM f GROUP BY nk),
cells AS (
  SELECT c_nationkey AS nk, 'R12' AS variable, avg(c_acctbal) AS {EARLY}, avg(c_acctbal) AS {FULL}
  FROM customer GROUP BY c_nationkey
  UNION ALL {rows}),
panel AS MATERIALIZED (
  SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS code, n_name AS entity, variable, {EARLY}, {FULL}
  FROM cells JOIN nation ON nk = n_nationkey)"""


PANEL = _panel()

WIDE = "wide AS MATERIALIZED (SELECT code, entity, " + ", ".join(
    f"max({FULL}) FILTER (WHERE variable = '{v}') AS {v}" for v in VARIABLES) + \
    " FROM panel GROUP BY code, entity)"

POINTS = """points AS (
  SELECT n_nationkey::BIGINT AS unit, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS code,
         ((n_nationkey * 137.507764::DOUBLE) % 360) - 180 AS lon,
         ((n_nationkey * 77.319::DOUBLE) % 140) - 70 AS lat
  FROM nation)"""

HAVERSINE = """2 * 6371010.0 * asin(sqrt(least(1.0,
    pow(sin(radians(b.lat - a.lat) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"""


def scaled(columns: list[str], table: str = "wide") -> str:
    def one(c: str) -> str:
        return (f"({c} - (SELECT quantile_cont({c}, 0.5) FROM {table})) / nullif((SELECT quantile_cont({c}, 0.75)"
                f" - quantile_cont({c}, 0.25) FROM {table}), 0) AS {c}")
    return f"scaled AS MATERIALIZED (SELECT code, entity, {', '.join(one(c) for c in columns)} FROM {table})"


def features(scenarios: dict[str, list[str]]) -> str:
    """feat(scenario, unit, variable, v) from the scaled columns."""
    rows = "\n  UNION ALL ".join(
        f"SELECT '{s}' AS scenario, unit, '{c}' AS variable, {c} AS v FROM scaled JOIN points USING (code)"
        for s, names in scenarios.items() for c in names)
    return f"feat AS MATERIALIZED ({rows})"


RAW_PAIRS = f"""d0 AS (
  SELECT a.scenario, a.unit AS i, b.unit AS j, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d0
  FROM feat a JOIN feat b ON a.scenario = b.scenario AND a.variable = b.variable AND a.unit < b.unit
  GROUP BY ALL),
d1 AS (SELECT a.unit AS i, b.unit AS j, {HAVERSINE} AS d1 FROM points a JOIN points b ON a.unit < b.unit),
raw_pairs AS MATERIALIZED (SELECT scenario, i, j, d0, d1 FROM d0 JOIN d1 USING (i, j))"""

PAIRS = """pairs AS MATERIALIZED (
  SELECT scenario, i, j, d0 / max(d0) OVER (PARTITION BY scenario) AS d0,
         d1 / max(d1) OVER (PARTITION BY scenario) AS d1
  FROM raw_pairs)"""

UNITS = "units AS MATERIALIZED (SELECT DISTINCT scenario, unit FROM feat)"


def nation_pairs(scenarios: dict[str, list[str]]) -> list[str]:
    columns = sorted({c for names in scenarios.values() for c in names})
    return [PANEL, WIDE, POINTS, scaled(columns), features(scenarios), RAW_PAIRS, PAIRS, UNITS]


def alphas(values: str) -> str:
    return f"alphas AS (SELECT unnest({values})::INT AS alpha_step)"


ALL_ALPHAS = alphas("range(0, 101)")


def tree(mix: str = "squared", name: str = "tree", grid: str = "alphas") -> str:
    """{name}(scenario, alpha_step, step, unit, cid): one merge per step, every step kept."""
    a = "(x.alpha_step / 100.0)"
    m = {"squared": f"((1 - {a}) * p.d0 * p.d0 + {a} * p.d1 * p.d1) / (z.n * z.n)",
         "linear": f"2 * ((1 - {a}) * p.d0 + {a} * p.d1)"}[mix]
    w = {"squared": "1.0 / max(n)", "linear": "1.0"}[mix]
    return f"""{name}_size AS MATERIALIZED (SELECT scenario, count(*)::DOUBLE AS n FROM units GROUP BY scenario),
{name} AS (
  SELECT u.scenario, g.alpha_step, 0 AS step, u.unit, u.unit AS cid, 0.0::DOUBLE AS h
  FROM units u, (SELECT DISTINCT alpha_step FROM {grid}) g
  UNION ALL
  SELECT t.scenario, t.alpha_step, t.step + 1, t.unit, CASE WHEN t.cid = m.e.b THEN m.e.a ELSE t.cid END, m.e.h
  FROM {name} t JOIN (
    WITH s AS MATERIALIZED (
      SELECT x.scenario, x.alpha_step, least(x.cid, y.cid) AS a, greatest(x.cid, y.cid) AS b, sum({m}) AS s
      FROM {name} x JOIN {name}_size z ON z.scenario = x.scenario
      JOIN pairs p ON p.scenario = x.scenario AND p.i = x.unit
      JOIN {name} y ON y.scenario = x.scenario AND y.alpha_step = x.alpha_step AND y.unit = p.j
      GROUP BY ALL),
    c AS MATERIALIZED (
      SELECT t.scenario, t.alpha_step, t.cid, count(*) * {w} AS w, coalesce(max(s.s), 0.0) AS t
      FROM {name} t JOIN {name}_size USING (scenario)
      LEFT JOIN s ON s.scenario = t.scenario AND s.alpha_step = t.alpha_step AND s.a = t.cid AND s.b = t.cid
      GROUP BY t.scenario, t.alpha_step, t.cid)
    SELECT s.scenario, s.alpha_step, min(struct_pack(
             h := (ca.t + cb.t + s.s) / (ca.w + cb.w) - ca.t / ca.w - cb.t / cb.w, a := s.a, b := s.b)) AS e
    FROM s JOIN c ca ON ca.scenario = s.scenario AND ca.alpha_step = s.alpha_step AND ca.cid = s.a
    JOIN c cb ON cb.scenario = s.scenario AND cb.alpha_step = s.alpha_step AND cb.cid = s.b
    WHERE s.a < s.b GROUP BY s.scenario, s.alpha_step) m
  ON m.scenario = t.scenario AND m.alpha_step = t.alpha_step)"""


def labels(source: str = "tree", name: str = "labels", k_max: int = 15) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT scenario, alpha_step, (n - step)::INT AS k, unit,
         dense_rank() OVER (PARTITION BY scenario, alpha_step, step ORDER BY cid)::INT AS cluster
  FROM {source} JOIN {source}_size USING (scenario) WHERE n - step BETWEEN 2 AND {k_max})"""


TOTALS = """totals AS MATERIALIZED (
  SELECT scenario, sum(d0 * d0) / (max(n) * max(n)) AS t0, sum(d1 * d1) / (max(n) * max(n)) AS t1
  FROM pairs JOIN (SELECT scenario, count(*) AS n FROM units GROUP BY scenario) USING (scenario)
  GROUP BY scenario)"""


def quality(source: str = "labels") -> list[str]:
    """q(scenario, alpha_step, k, q0, q1, q0norm, q1norm, tot, t0, t1) from the partitions."""
    return [f"""inner_sums AS (
  SELECT a.scenario, a.alpha_step, a.k, a.cluster, sum(p.d0 * p.d0) AS s0, sum(p.d1 * p.d1) AS s1
  FROM pairs p JOIN {source} a ON a.scenario = p.scenario AND a.unit = p.i
  JOIN {source} b ON b.scenario = p.scenario AND b.unit = p.j AND b.alpha_step = a.alpha_step AND b.k = a.k
       AND b.cluster = a.cluster
  GROUP BY ALL),
cluster_sizes AS (
  SELECT scenario, alpha_step, k, cluster, count(*) AS n_c FROM {source} GROUP BY ALL),
explained AS MATERIALIZED (
  SELECT scenario, alpha_step, k,
         1 - coalesce(sum(s0 / n_c), 0) / max(n) / max(t0) AS q0,
         1 - coalesce(sum(s1 / n_c), 0) / max(n) / max(t1) AS q1, max(t0) AS t0, max(t1) AS t1
  FROM cluster_sizes LEFT JOIN inner_sums USING (scenario, alpha_step, k, cluster)
  JOIN totals USING (scenario)
  JOIN (SELECT scenario, count(*) AS n FROM units GROUP BY scenario) USING (scenario)
  GROUP BY scenario, alpha_step, k)""",
            """q AS MATERIALIZED (
  SELECT *, q0 / max(CASE WHEN alpha_step = 0 THEN q0 END) OVER (PARTITION BY scenario, k) AS q0norm,
         q1 / max(CASE WHEN alpha_step = 100 THEN q1 END) OVER (PARTITION BY scenario, k) AS q1norm,
         (q0 * t0 + q1 * t1) / (t0 + t1) AS tot
  FROM explained)"""]


def smallest(goal: str, columns: str = "scenario, k", name: str = "alpha_step") -> str:
    """Per scenario and K the smallest weight whose ``goal`` is within 1e-9 of the least."""
    return (f"SELECT {columns}, min(alpha_step) AS {name} FROM (SELECT scenario, k, alpha_step, {goal} AS goal, "
            f"min({goal}) OVER (PARTITION BY scenario, k) AS least FROM q) WHERE goal <= least + 1e-9 GROUP BY scenario, k")


STARS = f"""stars AS MATERIALIZED (
  {smallest("abs(q0norm - q1norm)", "scenario, 'ch' AS criterion, k")}
  UNION ALL
  {smallest("-tot", "scenario, 'max', k")})"""


def indices(source: str, combos: str = "alpha_step, k", name: str = "scored") -> list[str]:
    """{name}(scenario, combos, index, value) over labels ``source`` and pairs; CH needs columns(scenario, unit, pos, v)."""
    c = [x.strip() for x in combos.split(",")]
    same = " AND ".join(f"b.{x} = a.{x}" for x in c)
    own = ", ".join(f"a.{x}" for x in c)
    using = f"(scenario, {combos})"
    return [f"""lp AS MATERIALIZED (
  SELECT a.scenario, {own}, p.i, p.j, a.cluster AS ci, b.cluster AS cj,
         (1 - a.alpha_step / 100.0) * p.d0 + a.alpha_step / 100.0 * p.d1 AS d
  FROM pairs p JOIN {source} a ON a.scenario = p.scenario AND a.unit = p.i
  JOIN {source} b ON b.scenario = p.scenario AND b.unit = p.j AND {same}),
psums AS MATERIALIZED (
  SELECT scenario, {combos}, sum(d) FILTER (WHERE ci = cj) AS s_w, count(*) FILTER (WHERE ci = cj) AS n_w,
         max(d) FILTER (WHERE ci = cj) AS max_w, sum(d) FILTER (WHERE ci <> cj) AS s_b,
         count(*) FILTER (WHERE ci <> cj) AS n_b, min(d) FILTER (WHERE ci <> cj) AS min_b
  FROM lp GROUP BY scenario, {combos}),
ends AS (
  SELECT scenario, {combos}, i AS unit, ci AS own, cj AS other, d FROM lp
  UNION ALL SELECT scenario, {combos}, j, cj, ci, d FROM lp),
means AS (SELECT scenario, {combos}, unit, own, other, avg(d) AS m FROM ends GROUP BY ALL),
widths AS (
  SELECT scenario, {combos}, unit, max(m) FILTER (WHERE own = other) AS a, min(m) FILTER (WHERE own <> other) AS b
  FROM means GROUP BY ALL),
sil AS (
  SELECT scenario, {combos}, avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS value
  FROM widths GROUP BY ALL),
ranked AS (
  SELECT scenario, {combos}, d, row_number() OVER (PARTITION BY scenario, {combos} ORDER BY d) AS up,
         row_number() OVER (PARTITION BY scenario, {combos} ORDER BY d DESC) AS down FROM lp),
cbounds AS (
  SELECT r.scenario, {', '.join(f'r.{x}' for x in c)}, sum(d) FILTER (WHERE up <= n_w) AS small,
         sum(d) FILTER (WHERE down <= n_w) AS large
  FROM ranked r JOIN psums USING {using} GROUP BY ALL)""",
            f"""by_cluster AS (
  SELECT l.scenario, {', '.join(f'l.{x}' for x in c)}, l.cluster, f.pos, count(*) AS n, avg(f.v) AS m, var_pop(f.v) * count(*) AS w
  FROM {source} l JOIN columns f ON f.scenario = l.scenario AND f.unit = l.unit GROUP BY ALL),
grand AS (SELECT scenario, pos, avg(v) AS g, count(*) AS n FROM columns GROUP BY ALL),
ch AS (
  SELECT scenario, {combos}, (sum(c.n * (m - g) * (m - g)) / (count(DISTINCT cluster) - 1))
         / (sum(w) / (max(grand.n) - count(DISTINCT cluster))) AS value
  FROM by_cluster c JOIN grand USING (scenario, pos) GROUP BY scenario, {combos}),
{name} AS MATERIALIZED (
  SELECT scenario, {combos}, 'Sil' AS index, value FROM sil
  UNION ALL SELECT scenario, {combos}, 'Dunn', min_b / nullif(max_w, 0) FROM psums
  UNION ALL SELECT scenario, {combos}, 'McClain', (s_w / n_w) / nullif(s_b / n_b, 0) FROM psums
  UNION ALL SELECT scenario, {combos}, 'Cindex', (s_w - small) / nullif(large - small, 0) FROM psums JOIN cbounds USING {using}
  UNION ALL SELECT scenario, {combos}, 'CH', value FROM ch)"""]


COLUMNS = """columns AS MATERIALIZED (
  SELECT scenario, unit, variable AS pos, v FROM feat
  UNION ALL SELECT u.scenario, u.unit, 'lon', p.lon FROM units u JOIN points p USING (unit)
  UNION ALL SELECT u.scenario, u.unit, 'lat', p.lat FROM units u JOIN points p USING (unit))"""


def ari(source: str, name: str = "agreement") -> str:
    """{name}(left_key, right_key, ari) over {source}(key, unit, cluster)."""
    return f"""tab AS (
  SELECT a.key AS lk, b.key AS rk, a.cluster AS l, b.cluster AS r, count(*)::DOUBLE AS n
  FROM {source} a JOIN {source} b USING (unit) GROUP BY ALL),
rowm AS (SELECT lk, rk, sum(n * (n - 1) / 2) AS a FROM (SELECT lk, rk, l, sum(n) AS n FROM tab GROUP BY ALL) GROUP BY ALL),
colm AS (SELECT lk, rk, sum(n * (n - 1) / 2) AS b FROM (SELECT lk, rk, r, sum(n) AS n FROM tab GROUP BY ALL) GROUP BY ALL),
both_ AS (SELECT lk, rk, sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM tab GROUP BY ALL),
parts AS (SELECT lk, rk, a, b, c, a * b / (n * (n - 1) / 2) AS e FROM both_ JOIN rowm USING (lk, rk) JOIN colm USING (lk, rk)),
{name} AS MATERIALIZED (
  SELECT lk AS left_key, rk AS right_key, coalesce((c - e) / nullif((a + b) / 2 - e, 0), 1.0) AS ari FROM parts)"""


def alpha_text(c: str = "alpha_step") -> str:
    return (f"(CASE WHEN {c} % 100 = 0 THEN ({c} // 100)::VARCHAR WHEN {c} % 10 = 0 THEN "
            f"({c} // 100)::VARCHAR || '.' || (({c} % 100) // 10)::VARCHAR "
            f"ELSE ({c} // 100)::VARCHAR || '.' || lpad(({c} % 100)::VARCHAR, 2, '0') END)")


COMBO_KEY = f"('K=' || k::VARCHAR || ' & Alpha=' || {alpha_text()})"
COMBO_COLUMN = f"('Cluster_K=' || k::VARCHAR || 'Alpha=' || {alpha_text()})"

LABEL_CASE = "CASE index " + " ".join(f"WHEN '{code}' THEN '{label}'" for code, label in INDEX_LABELS.items()) + " ELSE index END"


def criterion_case(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} LIKE '%{part}%' THEN '{label}'" for part, label in CRITERION_LABELS) + f" ELSE {c} END"


def query(*blocks, select: str) -> str:
    flat: list[str] = []
    for b in blocks:
        flat += b if isinstance(b, list) else [b]
    return "WITH RECURSIVE " + ",\n".join(flat) + "\n" + select if flat else select
