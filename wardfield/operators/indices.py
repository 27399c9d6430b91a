"""Validity indices of partitions over a pair table, and of features for one of them.

Every function scores all partitions in one pass. A partition is a row of
``combos`` columns (weight, number of clusters, ...); a unit carries its cluster
in each of them as one short array, so pairs are joined twice however many
partitions there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..state import written
from .pairs import blend_linear
from .ranks import frame_bins, rank_sums

COMBO = ["alpha_step", "k"]


def labelled_pairs(pairs: DataFrame, labels: DataFrame, combos: list[str] | None = None) -> DataFrame:
    """(scenario, combos, i, j, ci, cj, d): each pair with both clusters and the blend."""
    combos = COMBO if combos is None else combos
    own = labels.groupBy("scenario", "unit").agg(
        F.sort_array(F.collect_list(F.struct(*combos, "cluster"))).alias("p"))

    def side(unit: str) -> DataFrame:
        return own.select("scenario", F.col("unit").alias(unit), F.col("p").alias(f"p{unit}"))

    met = pairs.join(side("i"), ["scenario", "i"]).join(side("j"), ["scenario", "j"])
    rows = met.select("scenario", "i", "j", "d0", "d1", F.explode(F.arrays_zip("pi", "pj")).alias("z"))
    flat = rows.select("scenario", "i", "j", "d0", "d1", *[F.col(f"z.pi.{c}").alias(c) for c in combos],
                       F.col("z.pi.cluster").alias("ci"), F.col("z.pj.cluster").alias("cj"))
    return blend_linear(flat)


def pair_sums(lp: DataFrame, combos: list[str] | None = None) -> DataFrame:
    """Within and between sums, counts and extremes per partition."""
    combos = COMBO if combos is None else combos
    same = F.col("ci") == F.col("cj")
    inside, across = F.when(same, F.col("d")), F.when(~same, F.col("d"))
    return lp.groupBy("scenario", *combos).agg(
        F.sum(inside).alias("s_w"), F.count(inside).alias("n_w"), F.max(inside).alias("max_w"),
        F.sum(across).alias("s_b"), F.count(across).alias("n_b"), F.min(across).alias("min_b"))


def silhouette_from_sums(sums: DataFrame, keys: list[str], singleton: float = 0.0) -> DataFrame:
    """Mean silhouette from (keys, unit, own, other, s, n): a unit's distance sum to each cluster."""
    mean = safe_div(F.col("s"), F.col("n"))
    home = F.col("own") == F.col("other")
    per_unit = sums.groupBy(*keys, "unit").agg(
        F.max(F.when(home, mean)).alias("a"), F.min(F.when(~home, mean)).alias("b"))
    score = F.when(F.col("a").isNull(), F.lit(float(singleton))).otherwise(
        F.coalesce(safe_div(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per_unit.groupBy(*keys).agg(F.avg(score).alias("value"))


def silhouette(lp: DataFrame, combos: list[str] | None = None, singleton: float = 0.0) -> DataFrame:
    combos = COMBO if combos is None else combos
    ends = F.explode(F.array(
        F.struct(F.col("i").alias("unit"), F.col("ci").alias("own"), F.col("cj").alias("other")),
        F.struct(F.col("j").alias("unit"), F.col("cj").alias("own"), F.col("ci").alias("other"))))
    keys = ["scenario", *combos]
    sums = lp.select(*keys, "d", ends.alias("e")).groupBy(*keys, "e.unit", "e.own", "e.other").agg(
        F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"))
    return silhouette_from_sums(sums, keys, singleton)


def dunn(sums: DataFrame) -> DataFrame:
    """Smallest distance between clusters over the largest inside one."""
    return sums.withColumn("value", safe_div(F.col("min_b"), F.col("max_w")))


def mcclain_rao(sums: DataFrame) -> DataFrame:
    """Mean distance inside clusters over the mean between them."""
    return sums.withColumn("value", safe_div(safe_div(F.col("s_w"), F.col("n_w")),
                                             safe_div(F.col("s_b"), F.col("n_b"))))


def c_index_values(sums: DataFrame, bounds: DataFrame, bins, variant: str = "sums") -> DataFrame:
    """``sums(key, s_w, n_w, s_b, n_b, ...)`` with the C-index as ``value``; all keys in the same passes.

    ``variant='sums'``: against the sums of the n_w smallest and largest distances;
    ``'extremes'``: against n_w times the smallest and the largest distance.
    """
    if variant == "sums":
        ranks = sums.select("key", F.col("n_w").alias("rank")).unionByName(sums.select("key", F.col("n_b").alias("rank")))
        found = rank_sums(bounds, ranks, bins)
        lower = found.select("key", F.col("rank").alias("n_w"), F.col("total").alias("small"))
        upper = found.select("key", F.col("rank").alias("n_b"), F.col("total").alias("less"))
        # The sum of the n_w largest is the total less the n_b smallest.
        both = sums.join(lower, ["key", "n_w"], "left").join(upper, ["key", "n_b"], "left")
        small = F.coalesce("small", F.lit(0.0))
        large = F.coalesce("s_w", F.lit(0.0)) + F.coalesce("s_b", F.lit(0.0)) - F.coalesce("less", F.lit(0.0))
    else:
        both = sums.join(bounds.select("key", "lo", "hi"), "key")
        small, large = F.col("n_w") * F.col("lo"), F.col("n_w") * F.col("hi")
    return both.withColumn("value", safe_div(F.col("s_w") - small, large - small)).drop("small", "less", "lo", "hi")


def c_index(pairs: DataFrame, sums: DataFrame, combos: list[str] | None = None,
            variant: str = "sums") -> DataFrame:
    """(S_w - S_min) / (S_max - S_min); the bounds come from rank search, not from a sort."""
    combos = COMBO if combos is None else combos
    key = F.concat_ws("|", "scenario", F.col("alpha_step").cast("string"))
    keyed = written(sums.select("scenario", *combos, "s_w", "n_w", "s_b", "n_b", key.alias("key")), "c-index-sums")
    used = keyed.select("scenario", "alpha_step").distinct()  # one row per scenario and weight
    values = written(blend_linear(pairs.join(F.broadcast(used), "scenario")).select(key.alias("key"), F.col("d").alias("v")), "c-index-values")
    bounds = written(values.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "c-index-bounds")
    return c_index_values(keyed, bounds, frame_bins(values), variant).select("scenario", *combos, "value")


def calinski_harabasz(units: DataFrame, labels: DataFrame, x: str = "x",
                      combos: list[str] | None = None) -> DataFrame:
    """(between / (K - 1)) / (within / (n - K)) on the columns of array ``x``; linear in n."""
    combos = COMBO if combos is None else combos
    keys = ["scenario", *combos]
    cells = (labels.join(units.select("scenario", "unit", x), ["scenario", "unit"])
             .select(*keys, "cluster", F.posexplode(x).alias("pos", "v")))
    by_cluster = cells.groupBy(*keys, "cluster", "pos").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("w"))
    # Total spread from the cluster means and spreads: no second pass over the units.
    by_column = by_cluster.groupBy(*keys, "pos").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k_seen"),
        F.sum(F.col("n") * F.col("m")).alias("nm"))
    means = by_column.select(*keys, "pos", safe_div(F.col("nm"), F.col("n")).alias("grand"))
    between = by_cluster.join(means, [*keys, "pos"]).groupBy(*keys).agg(
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("b"))
    within = by_column.groupBy(*keys).agg(F.sum("w").alias("w"), F.max("n").alias("n"),
                                          F.max("k_seen").alias("k_seen"))
    return between.join(within, keys).select(*keys, safe_div(
        safe_div(F.col("b"), F.col("k_seen") - 1),
        safe_div(F.col("w"), F.col("n") - F.col("k_seen"))).alias("value"))


def five_indices(pairs: DataFrame, units: DataFrame, labels: DataFrame, x: str = "x",
                 combos: list[str] | None = None, round_digits: int | None = None, singleton: float = 0.0,
                 c_index_variant: str = "sums") -> DataFrame:
    """(scenario, combos, index, value) for the five indices of every partition."""
    combos = COMBO if combos is None else combos
    lp = labelled_pairs(pairs, labels, combos)
    sums = pair_sums(lp, combos)
    scored = {
        "Sil": silhouette(lp, combos, singleton),
        "Dunn": dunn(sums),
        "McClain": mcclain_rao(sums),
        "Cindex": c_index(pairs, sums, combos, c_index_variant),
        "CH": calinski_harabasz(units, labels, x, combos),
    }
    value = F.col("value") if round_digits is None else F.round("value", round_digits)
    parts = [df.select("scenario", *combos, F.lit(name).alias("index"), value.alias("value"))
             for name, df in scored.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
