"""Ward trees for many mixing weights at once, as rounds of grouped sums.

For cluster weight w, T(A) = sum over pairs inside A of w_i w_j m_ij and
S(A, B) = sum over pairs across of w_i w_j m_ij. The Ward value is

    (T(A) + T(B) + S(A, B)) / (w_A + w_B) - T(A) / w_A - T(B) / w_B

and w, T, S add up under merging. So a merge is a relabel and a groupBy().sum():
the state is one table of cluster pairs whose diagonal rows carry w and T.
Ward linkage is reducible, hence all reciprocal nearest neighbours of a round
may merge together; every weight and scenario advances in the same round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..state import BROADCAST_ROWS, Rounds
from . import small_trees

GROUP = ["scenario", "alpha_step"]


Steps = list[int] | dict[str, list[int]]


def steps_in(alpha_steps: Steps, scenario: str) -> list[int]:
    return alpha_steps.get(scenario, []) if isinstance(alpha_steps, dict) else alpha_steps


def steps_column(alpha_steps: Steps):
    """The weights of a row's scenario as an array."""
    def array(steps):
        return F.array(*[F.lit(int(a)) for a in steps]).cast("array<int>")

    if not isinstance(alpha_steps, dict):
        return array(alpha_steps)
    cells = [x for s, steps in alpha_steps.items() for x in (F.lit(s), array(steps))]
    return F.coalesce(F.create_map(*cells)[F.col("scenario")], array([])) if cells else array([])


@dataclass
class Tree:
    """``merges``: one row per merge, ``left`` keeps its id and ``right`` disappears.

    A cluster's id is its smallest unit. ``dw0`` and ``dw1`` are the growth of the
    within-cluster inertia of the two tables. ``sizes`` maps scenario to unit count, ``alpha_steps``
    lists the weights, or maps scenario to its own.
    """
    units: DataFrame
    merges: DataFrame
    alpha_steps: Steps
    sizes: dict[str, int]
    rounds: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def trees(self) -> int:
        return sum(len(steps_in(self.alpha_steps, s)) for s in self.sizes)

    @property
    def cluster_rows(self) -> int:
        return sum(n * len(steps_in(self.alpha_steps, s)) for s, n in self.sizes.items())

    def only(self, combos: list[tuple[int, int]]) -> Tree:
        """The trees at the weights of ``combos(k, alpha_step)``: nothing else is read from the merges."""
        wanted = sorted({a for _, a in combos})
        return Tree(self.units, self.merges.where(F.col("alpha_step").isin(wanted)), wanted, self.sizes)


def unit_counts(units: DataFrame) -> dict[str, int]:
    """Units per scenario; the scenarios are the few names the caller made."""
    return {r["scenario"]: r["count"] for r in units.groupBy("scenario").count().collect()}


def by_scenario(values: dict[str, float]):
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.create_map(*pairs)[F.col("scenario")]


def _given(c: str):
    missing = F.raise_error(F.lit(f"a pair of units has no {c}: drop the unit or impute")).cast("double")
    return F.coalesce(F.col(c), missing)


MERGES = ("scenario string, alpha_step int, round int, left bigint, right bigint, height double, "
          "dw0 double, dw1 double")


def _start(units: DataFrame, pairs: DataFrame, alpha_steps: Steps, mix: str,
           sizes: dict[str, int]) -> DataFrame:
    if mix == "squared":
        w = by_scenario({s: 1.0 / n for s, n in sizes.items()})
        m = {c: w * w * _given(c) * _given(c) for c in ("d0", "d1")}
    elif mix == "linear":
        w = F.lit(1.0)
        m = {c: 2 * _given(c) for c in ("d0", "d1")}
    else:
        raise ValueError(f"mix must be 'squared' or 'linear', not {mix!r}")
    zero = F.lit(0.0)

    def rows(df: DataFrame, a: str, b: str, own, s0, s1, alive: bool) -> DataFrame:
        return df.select("scenario", F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"),
                         own.alias("w"), s0.alias("s0"), s1.alias("s1"), zero.alias("h"),
                         F.lit(alive).alias("alive"))

    clusters = rows(units, "unit", "unit", w, zero, zero, True)
    edges = rows(pairs, "i", "j", zero, m["d0"], m["d1"], False)
    return clusters.unionByName(edges).withColumn("alpha_step", F.explode(steps_column(alpha_steps)))


# Edges with their Ward value; the rounding of a value must not put a merge below
# the merges it contains, hence the greatest().
_EDGES = """
clusters AS (SELECT scenario, alpha_step, a AS id, w, s0, s1, h FROM {state} WHERE alive),
sums AS (
  SELECT {hint_clusters} e.scenario, e.alpha_step, e.a, e.b, x.w AS wx, y.w AS wy,
         x.s0 AS px, y.s0 AS py, x.s1 AS qx, y.s1 AS qy, e.s0 + x.s0 + y.s0 AS p, e.s1 + x.s1 + y.s1 AS q,
         greatest(x.h, y.h) AS h
  FROM {state} e
  JOIN clusters x ON x.scenario = e.scenario AND x.alpha_step = e.alpha_step AND x.id = e.a
  JOIN clusters y ON y.scenario = e.scenario AND y.alpha_step = e.alpha_step AND y.id = e.b
  WHERE NOT e.alive),
growths AS (
  SELECT scenario, alpha_step, a, b, h, alpha_step / 100D AS alpha,
         p / (wx + wy) - px / wx - py / wy AS dw0, q / (wx + wy) - qx / wx - qy / wy AS dw1
  FROM sums),
edges AS (
  SELECT scenario, alpha_step, a, b, dw0, dw1, (1 - alpha) * dw0 + alpha * dw1 AS ward,
         greatest((1 - alpha) * dw0 + alpha * dw1, h) AS height
  FROM growths)"""

# Pairs that are each other's nearest neighbour; equal values go to the smallest id,
# so the smallest pair of all is always among them.
_RECIPROCAL = """
seen AS (
  SELECT scenario, alpha_step, explode(array(
           struct(a AS node, struct(ward, b AS nbr, height, dw0, dw1) AS best),
           struct(b AS node, struct(ward, a AS nbr, height, dw0, dw1) AS best))) AS v
  FROM edges),
nearest AS (
  SELECT scenario, alpha_step, v.node AS node, min(v.best) AS best
  FROM seen GROUP BY scenario, alpha_step, v.node),
merges AS (
  SELECT scenario, alpha_step, least(node, best.nbr) AS l, greatest(node, best.nbr) AS r,
         max(best.height) AS height, max(best.dw0) AS dw0, max(best.dw1) AS dw1
  FROM nearest GROUP BY scenario, alpha_step, least(node, best.nbr), greatest(node, best.nbr)
  HAVING count(*) = 2)"""

# The one best pair per tree: smallest (value, left, right).
_SINGLE = """
best AS (
  SELECT scenario, alpha_step, min(struct(ward, a AS l, b AS r, height, dw0, dw1)) AS m
  FROM edges GROUP BY scenario, alpha_step),
merges AS (SELECT scenario, alpha_step, m.l, m.r, m.height, m.dw0, m.dw1 FROM best)"""

_MERGES = """
SELECT scenario, alpha_step, {step} AS round, l AS left, r AS right, height, dw0, dw1 FROM merges"""

# Relabel the vanished id on both ends and add up.
_RELABEL = """
WITH moved AS (
  SELECT {hint_merges} s.scenario, s.alpha_step, s.alive, s.w, s.s0, s.s1, s.h, mb.height AS mh,
         coalesce(ma.left, s.a) AS na, coalesce(mb.left, s.b) AS nb
  FROM {state} s
  LEFT JOIN {merges} ma ON ma.scenario = s.scenario AND ma.alpha_step = s.alpha_step AND ma.right = s.a
  LEFT JOIN {merges} mb ON mb.scenario = s.scenario AND mb.alpha_step = s.alpha_step AND mb.right = s.b)
SELECT scenario, alpha_step, least(na, nb) AS a, greatest(na, nb) AS b, sum(w) AS w, sum(s0) AS s0, sum(s1) AS s1,
       max(CASE WHEN NOT alive AND na = nb THEN mh ELSE h END) AS h, least(na, nb) = greatest(na, nb) AS alive
FROM moved GROUP BY scenario, alpha_step, least(na, nb), greatest(na, nb)"""


def _linkage_sql(order: str, clusters: int, step: int) -> str:
    # Cluster and merge rows are under 100 bytes, and their number is known.
    hint = "/*+ BROADCAST(x, y) */" if clusters <= BROADCAST_ROWS else ""
    pick = {"batched": _RECIPROCAL, "sequential": _SINGLE}[order]
    return f"WITH {_EDGES},{pick} {_MERGES}".replace("{hint_clusters}", hint).replace("{step}", str(step))


def _relabel_sql(merges: int) -> str:
    return _RELABEL.replace("{hint_merges}", "/*+ BROADCAST(ma, mb) */" if merges <= BROADCAST_ROWS else "")


def ward_tree(units: DataFrame, pairs: DataFrame, alpha_steps: Steps, mix: str = "squared",
              order: str = "batched") -> Tree:
    """Ward trees of the blended dissimilarity, for every scenario and weight.

    ``units(scenario, unit)``, ``pairs(scenario, i, j, d0, d1)`` with i < j and integer
    units. ``mix='squared'`` blends d0^2 and d1^2 with unit weights 1/n; ``mix='linear'``
    blends d0 and d1 and starts from the plain distance. ``order='batched'`` merges all
    reciprocal neighbours per round; ``'sequential'`` one pair per tree and round (needed
    only to reproduce a fixed choice among ties). When no tree has more than ``small_trees.FEW``
    clusters left, each is finished by one task, smallest pair first.

    A round keeps its merges and then the next state in shared storage; nothing but row
    counts comes back to the driver.
    """
    spark = units.sparkSession
    if not isinstance(units.schema["unit"].dataType, T.IntegralType):
        raise TypeError("units must be integers; number them with row_index")
    sizes = unit_counts(units)
    per = {s: len(steps_in(alpha_steps, s)) for s in sizes}
    trees = sum(per.values())
    clusters = sum(n * per[s] for s, n in sizes.items())
    rows = sum(n * (n + 1) // 2 * per[s] for s, n in sizes.items())
    left = {(s, int(a)): n for s, n in sizes.items() for a in steps_in(alpha_steps, s)}
    rounds, done = Rounds(spark, f"ward-{mix}"), []
    state = rounds.keep(_start(units, pairs, alpha_steps, mix, sizes), "state-0")
    while clusters > trees:
        rounds.fit(rows)
        step = len(done) + 1
        if max(left.values()) <= small_trees.FEW:
            rest, merged = rounds.keep_counted(small_trees.finish_pairs(state, step), f"merges-{step}")
            if merged < clusters - trees:
                raise ValueError("the pair table does not connect all units")
            done.append(rest)
            break
        linked = rounds.session.sql(_linkage_sql(order, clusters, step), state=state)
        merges, merged = rounds.keep_counted(linked, f"merges-{step}")
        if merged == 0:
            raise ValueError("the pair table does not connect all units")
        done.append(merges)
        for r in merges.groupBy(*GROUP).count().collect():  # one row per tree
            left[r["scenario"], r["alpha_step"]] -= r["count"]
        # Pairs shrink with the square of the clusters; an estimate is enough to size the next step.
        rows = int(rows * ((clusters - merged) / clusters) ** 2) + 1
        clusters -= merged
        if clusters > trees:
            moved = rounds.session.sql(_relabel_sql(merged), state=state, merges=merges)
            state = rounds.keep(moved, f"state-{step}")
        rounds.drop(f"state-{step - 1}")
    return Tree(units.select("scenario", "unit"), all_merges(rounds, done, spark), alpha_steps, sizes)


def all_merges(rounds: Rounds, done: list[DataFrame], spark) -> DataFrame:
    """The merges of all rounds; a tree of one unit has none."""
    if not done:
        return spark.createDataFrame([], MERGES)
    return rounds.give(done, spark)
