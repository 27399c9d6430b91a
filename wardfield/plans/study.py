"""The whole analysis of one target or variable set, as named steps that share tables.

A :class:`Study` takes scaled units and their pair table and derives trees, weights,
partitions, indices and profiles from them. Each step is computed once, when it is
first asked for, and kept as a table in shared storage.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (CRITERION_LABELS, INDEX_LABELS, MIN_IS_BEST, combo_column, combo_key,
                                 pct_change, recode, recode_matching, scenario_key, sign_part)
from ..operators import compare, cut, graph_tree, indices, inertia, reshape, stats
from ..operators.pairs import feature_distance, geo_distance, range_normalise, total_inertia, unit_pairs
from ..operators.tiles import unit_point
from ..operators.ward import Tree, ward_tree
from ..state import written

# ---- Fixed values: the sweep and the final choices -------------------------
K_MAX = 15
ALPHA_STEPS = list(range(0, 101))
COMBOS = [(4, 60), (5, 62), (4, 0), (5, 0)]
GAIN_KS = {"R12": [2, 3, 4, 5, 8, 14], "R34": [2, 3, 4, 5, 15]}
# ----------------------------------------------------------------------------


def combo_rows(spark, combos: list[tuple[int, int]] | None = None) -> DataFrame:
    return spark.createDataFrame(COMBOS if combos is None else combos, "k int, alpha_step int")


def study_pairs(units: DataFrame, geography: DataFrame | None = None) -> DataFrame:
    """units(scenario, unit, x, lon, lat) to normalised pairs(scenario, i, j, d0, d1).

    Geography is the same for all scenarios, so a pair of units is made once and measured once: by ``geography(i, j, d1)``
    if given (boundaries, travel times, ...), else by the great circle between the units' points. Each scenario's feature distance
    is added in place.
    """
    sets = F.sort_array(F.collect_list(F.struct("scenario", "x"))).alias("sets")  # a row a scenario
    once = units.groupBy("unit").agg(sets, F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    met = unit_pairs(once, ["sets", "lon", "lat"], by=[])
    met = geo_distance(met) if geography is None else met.join(geography.select("i", "j", "d1"), ["i", "j"], "left")
    both = F.filter(F.flatten(F.transform("sets_i", lambda a: F.transform("sets_j", lambda b: F.struct(
        a["scenario"].alias("scenario"), a["x"].alias("x_i"), b["x"].alias("x_j"), (a["scenario"] == b["scenario"]).alias("same"))))),
        lambda s: s["same"])
    rows = feature_distance(met.select("i", "j", "d1", F.explode(both).alias("s")).select("s.scenario", "i", "j", "s.x_i", "s.x_j", "d1"))
    return range_normalise(written(rows.select("scenario", "i", "j", "d0", "d1"), "raw-pairs"))


centroid_pairs = study_pairs


def scenario_units(wide: DataFrame, points: DataFrame, scenarios: dict[str, list[str]],
                   on: str = "code") -> DataFrame:
    """One row per scenario and unit: its robust-scaled features as array ``x``, and its place.

    All columns of all scenarios are scaled in one pass; a row then becomes one row per
    scenario in place. ``unit`` must be an integer column of ``points``.
    """
    columns = sorted({c for names in scenarios.values() for c in names})
    scaled = stats.robust_scale(wide, columns)
    sets = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.array(*names).alias("x"))
                               for s, names in scenarios.items()])).alias("s")
    return scaled.join(points, on).select(sets, "unit", "lon", "lat").select(
        "s.scenario", "unit", "s.x", "lon", "lat")


class Study:
    """Steps over ``units(scenario, unit, x, lon, lat)`` and ``pairs(scenario, i, j, d0, d1)``."""

    def __init__(self, units: DataFrame, pairs: DataFrame | None = None, k_max: int = K_MAX,
                 alpha_steps: list[int] | None = None, order: str = "batched"):
        self.units = written(units, "units")
        self.pairs = written(centroid_pairs(self.units) if pairs is None else pairs, "pairs")
        self.k_max, self.order = k_max, order
        self.alpha_steps = ALPHA_STEPS if alpha_steps is None else alpha_steps
        self.ks = list(range(2, k_max + 1))

    # -- the weight --------------------------------------------------------
    @cached_property
    def totals(self) -> DataFrame:
        return written(total_inertia(self.pairs), "totals")

    @cached_property
    def tree(self) -> Tree:
        """Trees of the squared blend for the whole grid: one per weight serves every K."""
        return ward_tree(self.units, self.pairs, self.alpha_steps, "squared", self.order)

    @cached_property
    def quality(self) -> DataFrame:
        """q0, q1, q0norm, q1norm, tot for every weight and K."""
        q = inertia.explained_inertia(self.tree, self.totals, self.k_max)
        return written(inertia.weighted_inertia(inertia.normalised_inertia(q)), "quality")

    @cached_property
    def stars(self) -> DataFrame:
        return written(inertia.alpha_stars(self.quality), "stars")

    def inertia_at_stars(self) -> DataFrame:
        return inertia.inertia_at_alpha_star(self.quality, self.stars)

    # -- the indices -------------------------------------------------------
    @cached_property
    def features(self) -> DataFrame:
        """Scaled features with the raw centroid columns beside them."""
        return self.units.select("scenario", "unit", F.concat("x", F.array("lon", "lat")).alias("x"))

    @cached_property
    def index_labels(self) -> DataFrame:
        """Cuts of the linear-blend trees at the chosen weights and at weight 0."""
        chosen = {r[0]: r[1] for r in self.stars.groupBy("scenario").agg(F.collect_set("alpha_step")).collect()}  # at most 2 per K
        tree = ward_tree(self.units, self.pairs, {s: sorted({0, *steps}) for s, steps in chosen.items()}, "linear", self.order)
        labels = cut.cut_tree(tree, self.ks)
        zero = self.stars.select("scenario", "k", F.lit(0).alias("alpha_step"))
        needed = self.stars.select("scenario", "k", "alpha_step").unionByName(zero).distinct()
        return written(labels.join(F.broadcast(needed), ["scenario", "k", "alpha_step"], "left_semi"), "index-labels")

    @cached_property
    def index_long(self) -> DataFrame:
        """(scenario, alpha_step, k, index, value) for every scored partition."""
        return written(indices.five_indices(self.pairs, self.features, self.index_labels), "index-long")

    @cached_property
    def index_by_criterion(self) -> DataFrame:
        """(scenario, criterion, k, alpha_step, index, value) at the chosen weights."""
        return written(self.stars.join(self.index_long, ["scenario", "k", "alpha_step"]).select(
            "scenario", "criterion", "k", "alpha_step", "index", "value"), "index-by-criterion")

    def index_table(self) -> DataFrame:
        """One row per index and K with both criteria side by side."""
        def at(criterion: str, column: str):
            return F.max(F.when(F.col("criterion") == criterion, F.col(column)))
        return self.index_by_criterion.groupBy("scenario", "index", "k").agg(
            at("ch", "alpha_step").alias("alpha_star_ch"), at("ch", "value").alias("index_ch"),
            at("max", "alpha_step").alias("alpha_star_max"), at("max", "value").alias("index_max"))

    def index_baseline(self) -> DataFrame:
        """The five indices at weight 0, one row per index and K."""
        return self.index_long.where("alpha_step = 0").select("scenario", "k", "index", "value")

    def gain_loss(self, ks: dict[str, list[int]]) -> DataFrame:
        """Percent change of each index against weight 0 at each scenario's K, split by sign."""
        chosen = self.index_by_criterion.select("scenario", "k", "index", "criterion",
                                                F.col("value").alias("index_val"))
        base = self.index_baseline().withColumnRenamed("value", "index_val0")
        joined = join_baseline(chosen, base)
        # A baseline that is zero but for rounding has no percent change.
        change = pct_change(F.col("index_val"), F.when(F.abs("index_val0") > 1e-12, F.col("index_val0")))
        wanted = F.lit(False)
        for scenario, values in ks.items():
            wanted = wanted | ((F.col("scenario") == scenario) & F.col("k").isin(values))
        return (joined.where(wanted).withColumn("diff_index0", change)
                .select("scenario", "index", "k", "criterion", "diff_index0",
                        sign_part(F.col("diff_index0")).alias("part")))

    def best_k(self) -> DataFrame:
        return best_k(self.index_by_criterion)

    def index_plot_table(self) -> DataFrame:
        return index_plot_table(self.index_table())

    def alpha_plot_table(self) -> DataFrame:
        return alpha_plot_table(self.index_table())

    # -- the final partitions ---------------------------------------------
    def cluster_units(self, combos: list[tuple[int, int]] | None = None) -> DataFrame:
        """(scenario, k, alpha_step, unit, cluster) for the chosen combinations.

        Trees that the sweep has grown are read at these weights only; without a sweep only these trees grow.
        """
        combos = COMBOS if combos is None else combos
        if "tree" in self.__dict__:
            return cluster_units(self.tree, combos)
        return final_study(self.units, self.pairs, combos, self.order)


class VectorStudy(Study):
    """The sweep over ``units(scenario, unit, x, lon, lat)`` without a table of pairs.

    Places are points of the unit sphere and their distance the straight line, so clusters are sums of vectors: the state
    is units x weights, and inertia comes from the sums. ``dense`` as in :func:`ward_tree_graph`. The indices need distances
    themselves: :func:`wardfield.operators.tiles.vector_indices` scores partitions of vectors.
    """

    def __init__(self, units: DataFrame, k_max: int = K_MAX, alpha_steps: list[int] | None = None, dense: int = graph_tree.DENSE):
        placed = units.select("scenario", "unit", "x", unit_point().alias("g"))
        self.units, self.dense, self.k_max = written(placed, "vector-units"), dense, k_max
        self.alpha_steps = ALPHA_STEPS if alpha_steps is None else alpha_steps
        self.ks = list(range(2, k_max + 1))

    @property
    def pairs(self) -> DataFrame:
        raise ValueError("a study on vectors has no table of pairs")

    @cached_property
    def scales(self) -> graph_tree.Scales:
        return graph_tree.scales_of(self.units, self.units.select(F.max(F.size("x"))).first()[0] or 0)

    @cached_property
    def totals(self) -> DataFrame:
        return written(graph_tree.vector_totals(self.units, self.scales), "vector-totals")

    @cached_property
    def tree(self) -> Tree:
        return graph_tree.ward_tree_graph(self.units, self.alpha_steps, self.scales, self.dense)

    def cluster_units(self, combos: list[tuple[int, int]] | None = None) -> DataFrame:
        combos = COMBOS if combos is None else combos
        if "tree" in self.__dict__:
            return cluster_units(self.tree, combos)
        steps = sorted({a for _, a in combos})
        return cluster_units(graph_tree.ward_tree_graph(self.units, steps, self.scales, self.dense), combos)


def cluster_units(tree: Tree, combos: list[tuple[int, int]]) -> DataFrame:
    labels = cut.cut_tree(tree.only(combos), sorted({k for k, _ in combos}))
    wanted = None
    for k, step in combos:
        hit = (F.col("k") == k) & (F.col("alpha_step") == step)
        wanted = hit if wanted is None else wanted | hit
    return labels.where(wanted)


def final_study(units: DataFrame, pairs: DataFrame, combos: list[tuple[int, int]] | None = None,
                order: str = "batched") -> DataFrame:
    """Partitions of every scenario at the final combinations, from trees at their weights only."""
    combos = COMBOS if combos is None else combos
    return cluster_units(ward_tree(units, pairs, sorted({a for _, a in combos}), order=order), combos)


def join_baseline(chosen: DataFrame, base: DataFrame) -> DataFrame:
    """Full outer join on (scenario, K, index): neither side loses a row."""
    return chosen.join(base, ["scenario", "k", "index"], "full")


def best_k(index_values: DataFrame) -> DataFrame:
    """Best K per index and criterion: largest value, or smallest for some; ties to the smallest K."""
    goal = F.when(F.col("index").isin(MIN_IS_BEST), F.col("value")).otherwise(-F.col("value"))
    best = F.min(F.struct(goal.alias("goal"), "k", "value")).alias("b")
    return (index_values.where(F.col("value").isNotNull()).groupBy("scenario", "index", "criterion")
            .agg(best).select("scenario", "index", "criterion", "b.k", "b.value"))


def index_plot_table(table: DataFrame) -> DataFrame:
    """Chart rows: label of the index, K, criterion and value."""
    long = reshape.unpivot_criteria(table)
    return long.select(recode(F.col("index"), INDEX_LABELS).alias("index"), "k",
                       recode_matching(F.col("criterion"), CRITERION_LABELS).alias("criterion"), "index_val")


def alpha_plot_table(table: DataFrame) -> DataFrame:
    """Chart rows: K, criterion and chosen weight."""
    long = reshape.unpivot_criteria(table)
    return long.select("k", recode_matching(F.col("alpha"), CRITERION_LABELS).alias("criterion"),
                       (F.col("alpha_val") / 100.0).alias("alpha_star")).distinct()


def named_combos(labels: DataFrame, style: str = "cell") -> DataFrame:
    """Partitions keyed by text: 'K=4 & Alpha=0.6' cells or 'Cluster_K=4Alpha=0.6' columns."""
    name = combo_key if style == "cell" else combo_column
    return labels.withColumn("key", name(F.col("k"), F.col("alpha_step")))


def profiles(units: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    """Moments of ``value`` per cluster; ``sheet`` names the partition's own table."""
    on = ["scenario", "unit"] if "scenario" in units.columns else ["unit"]
    out = stats.cluster_profile(units, labels, value, ["scenario", "k", "alpha_step"], on)
    return out.withColumn("sheet", combo_column(F.col("k"), F.col("alpha_step")))


def ari_matrix(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index between the partitions of one scenario."""
    return compare.adjusted_rand(named_combos(labels).select("key", "unit", "cluster"))


def scenario_coherence(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index between all partitions of all scenarios, with its z-score."""
    keyed = named_combos(labels).select(scenario_key(F.col("scenario"), F.col("key")).alias("key"),
                                        "unit", "cluster")
    ari = compare.adjusted_rand(keyed)
    return stats.heatmap_table(ari.select(F.col("left_key").alias("reg1"), F.col("right_key").alias("reg2"),
                                          F.col("ari").alias("value")), "AdjRanIndex")


def map_layer(boundaries: DataFrame, panel: DataFrame, variable: str, period: str) -> DataFrame:
    """Every boundary with the fill value of one variable."""
    value = panel.where(F.col("variable") == variable)
    wide = reshape.pivot_variables(value, [variable], period)
    return boundaries.join(wide, "code", "left").select(
        "code", "entity", "parts", F.col(variable).alias("fill"))


def cluster_map_layer(boundaries: DataFrame, labels: DataFrame) -> DataFrame:
    """Boundaries with the cluster of each partition; labels carry ``code``."""
    return labels.join(boundaries, "code").select("scenario", "k", "alpha_step", "code", "parts", "cluster")
