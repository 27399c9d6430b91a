"""Agreement between partitions of the same units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_pairs(labels: DataFrame) -> DataFrame:
    """(left_key, right_key, unit, left, right) for key pairs left <= right.

    ``labels(key, unit, cluster)``. A unit's clusters are gathered into one array, as
    long as the number of compared partitions, and paired inside the row: one shuffle.
    """
    own = labels.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("key", "cluster"))).alias("p"))
    one = own.select("unit", "p", F.posexplode("p").alias("at", "l"))
    met = one.select("unit", "l", F.explode(F.slice("p", F.col("at") + 1, F.size("p") - F.col("at"))).alias("r"))
    return met.select(F.col("l.key").alias("left_key"), F.col("r.key").alias("right_key"), "unit",
                      F.col("l.cluster").alias("left"), F.col("r.cluster").alias("right"))


def contingency(labels: DataFrame) -> DataFrame:
    """Units per pair of clusters, for each pair of partitions."""
    return partition_pairs(labels).groupBy("left_key", "right_key", "left", "right").agg(
        F.count(F.lit(1)).alias("n"))


def _choose2(n):
    return n * (n - 1) / 2


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index for all ordered pairs of partitions; half is computed, half mirrored."""
    keys = ["left_key", "right_key"]
    cells = contingency(labels)
    rows = cells.groupBy(*keys, "left").agg(F.sum("n").alias("m")).groupBy(*keys).agg(
        F.sum(_choose2(F.col("m"))).alias("a"))
    cols = cells.groupBy(*keys, "right").agg(F.sum("n").alias("m")).groupBy(*keys).agg(
        F.sum(_choose2(F.col("m"))).alias("b"))
    both = cells.groupBy(*keys).agg(F.sum(_choose2(F.col("n"))).alias("c"), F.sum("n").alias("n"))
    expected = F.try_divide(F.col("a") * F.col("b"), _choose2(F.col("n")))
    # Two trivial partitions agree fully, though the formula has no value there.
    ari = F.coalesce(F.try_divide(F.col("c") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0))
    half = both.join(rows, keys).join(cols, keys).select(*keys, ari.alias("ari"))
    mirror = F.explode(F.when(F.col("left_key") == F.col("right_key"), F.array(F.struct(*keys))).otherwise(
        F.array(F.struct(*keys), F.struct(F.col("right_key").alias("left_key"),
                                          F.col("left_key").alias("right_key")))))
    return half.select(mirror.alias("k"), "ari").select("k.*", "ari")


def pivot_partitions(labels: DataFrame, keys: list[str]) -> DataFrame:
    """One column of cluster numbers per partition."""
    return labels.groupBy("unit").agg(*[
        F.max(F.when(F.col("key") == k, F.col("cluster"))).alias(k) for k in keys])
