"""Explained inertia along the tree, and the two rules that choose the weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from .cut import top_merges
from .ward import GROUP, Tree


def explained_inertia(tree: Tree, totals: DataFrame, k_max: int) -> DataFrame:
    """q0, q1 for K = 1..k_max: a cut at K undoes the last K - 1 merges, so the
    explained part is the running sum of their inertia growth over the total."""
    top = top_merges(tree, k_max - 1)
    last_first = Window.partitionBy(*GROUP).orderBy("top").rowsBetween(Window.unboundedPreceding, 0)
    cuts = top.select(*GROUP, (F.col("top") + 1).alias("k"),
                      F.sum("dw0").over(last_first).alias("b0"), F.sum("dw1").over(last_first).alias("b1"))
    return (cuts.join(totals, "scenario")
            .select(*GROUP, "k", safe_div(F.col("b0"), F.col("t0")).alias("q0"),
                    safe_div(F.col("b1"), F.col("t1")).alias("q1"), "t0", "t1"))


def explained_inertia_direct(labels: DataFrame, pairs: DataFrame, totals: DataFrame,
                             keys: list[str]) -> DataFrame:
    """q0, q1 of given partitions from their definition: 1 - within / total."""
    size = labels.groupBy("scenario", *keys, "cluster").agg(F.count(F.lit(1)).alias("n_c"))
    units = labels.groupBy("scenario", *keys).agg(F.count(F.lit(1)).alias("n"))
    # One array of cluster ids per unit: the pair table is joined twice, whatever the number of partitions.
    own = labels.groupBy("scenario", "unit").agg(
        F.sort_array(F.collect_list(F.struct(*keys, "cluster"))).alias("p"))
    met = (pairs.join(own.select("scenario", F.col("unit").alias("i"), F.col("p").alias("pi")), ["scenario", "i"])
           .join(own.select("scenario", F.col("unit").alias("j"), F.col("p").alias("pj")), ["scenario", "j"]))
    inside = F.filter(F.arrays_zip("pi", "pj"), lambda z: z["pi"] == z["pj"])
    same = met.select("scenario", "d0", "d1", F.explode(inside).alias("z")).select(
        "scenario", "d0", "d1", "z.pi.*")
    part = same.groupBy("scenario", *keys, "cluster").agg(
        F.sum(F.col("d0") * F.col("d0")).alias("s0"), F.sum(F.col("d1") * F.col("d1")).alias("s1"))
    grouped = (size.join(part, ["scenario", *keys, "cluster"], "left")
               .join(units, ["scenario", *keys])
               .groupBy("scenario", *keys)
               .agg(F.sum(F.coalesce("s0", F.lit(0.0)) / (F.col("n") * F.col("n_c"))).alias("w0"),
                    F.sum(F.coalesce("s1", F.lit(0.0)) / (F.col("n") * F.col("n_c"))).alias("w1")))
    return grouped.join(totals, "scenario").select(
        "scenario", *keys, (1 - safe_div(F.col("w0"), F.col("t0"))).alias("q0"),
        (1 - safe_div(F.col("w1"), F.col("t1"))).alias("q1"), "t0", "t1")


def normalised_inertia(q: DataFrame) -> DataFrame:
    """q0 relative to its value at weight 0, q1 relative to its value at weight 1, per K."""
    per_k = Window.partitionBy("scenario", "k")
    at0 = F.max(F.when(F.col("alpha_step") == 0, F.col("q0"))).over(per_k)
    at1 = F.max(F.when(F.col("alpha_step") == 100, F.col("q1"))).over(per_k)
    return q.withColumns({"q0norm": safe_div(F.col("q0"), at0), "q1norm": safe_div(F.col("q1"), at1)})


def weighted_inertia(q: DataFrame) -> DataFrame:
    """Explained inertia of both tables, weighted by their total inertia."""
    return q.withColumn("tot", safe_div(F.col("q0") * F.col("t0") + F.col("q1") * F.col("t1"),
                                        F.col("t0") + F.col("t1")))


# Weights that give the same partition must tie, though their sums were added in
# different orders; a value this close to the smallest one counts as equal to it.
TIE = 1e-9


def argmin_alpha(q: DataFrame, value) -> DataFrame:
    """Per scenario and K the weight of the smallest value; ties go to the smallest weight."""
    least = F.min("goal").over(Window.partitionBy("scenario", "k"))
    goals = q.select("scenario", "k", "alpha_step", value.alias("goal")).where("goal is not null")
    return goals.withColumn("least", least).where(F.col("goal") <= F.col("least") + TIE).groupBy("scenario", "k").agg(
        F.min("alpha_step").alias("alpha_step"))


def argmax_alpha(q: DataFrame, value) -> DataFrame:
    return argmin_alpha(q, -value)


def alpha_star_balance(q: DataFrame) -> DataFrame:
    """Per K the weight at which the two normalised inertias are closest."""
    return argmin_alpha(q, F.abs(F.col("q0norm") - F.col("q1norm")))


def alpha_star_max(q: DataFrame) -> DataFrame:
    """Per K the weight with the largest weighted explained inertia."""
    return argmax_alpha(q, F.col("tot"))


def alpha_stars(q: DataFrame) -> DataFrame:
    """Both rules in one table: criterion 'ch' balances, 'max' maximises."""
    return (alpha_star_balance(q).withColumn("criterion", F.lit("ch"))
            .unionByName(alpha_star_max(q).withColumn("criterion", F.lit("max")))
            .select("scenario", "criterion", "k", "alpha_step"))


def distinct_alphas(stars: DataFrame) -> DataFrame:
    """Distinct weights chosen by either rule."""
    return stars.select("scenario", "alpha_step").distinct()


def sort_alphas(stars: DataFrame) -> DataFrame:
    """Distinct chosen weights, ascending, with their position (at most two per K)."""
    position = F.row_number().over(Window.partitionBy("scenario").orderBy("alpha_step"))
    return distinct_alphas(stars).withColumn("position", position).orderBy("scenario", "alpha_step")


def distinct_combos(stars: DataFrame, ks: list[int]) -> DataFrame:
    """Distinct (K, weight) for the chosen numbers of clusters."""
    return stars.where(F.col("k").isin(ks)).select("scenario", "k", "alpha_step").distinct()


def lookup_alpha(q: DataFrame, stars: DataFrame) -> DataFrame:
    """The rows of the sweep at the chosen weights; weights are integers, so this is an equi-join."""
    return stars.join(q, ["scenario", "k", "alpha_step"])


def inertia_at_alpha_star(q: DataFrame, stars: DataFrame) -> DataFrame:
    """q0, q1 and their weighted total at the chosen weights; nothing is explained at K = 1."""
    chosen = lookup_alpha(q, stars).select("scenario", "criterion", "k", "alpha_step", "q0", "q1", "tot")
    one = stars.select("scenario", "criterion").distinct().select(
        "scenario", "criterion", F.lit(1).alias("k"), F.lit(None).cast("int").alias("alpha_step"),
        *[F.lit(0.0).alias(c) for c in ("q0", "q1", "tot")])
    return one.unionByName(chosen)
