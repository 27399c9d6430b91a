"""Dissimilarity tables: one row per unordered pair of units.

This is the engine for a *given* dissimilarity (any metric, a matrix of n^2 / 2
entries by definition). Units with vectors and positions go through
:mod:`wardfield.operators.tiles`, which never writes a pair down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import euclidean
from ..functions.columns import no_nan, safe_div
from ..functions.geometry import haversine_m
from ..state import maybe_broadcast, written_counted

# Units per block of a pair table: a task holds at most this many against as many.
PAIR_BLOCK = 256


def unit_pairs(units: DataFrame, payload: list[str], by: list[str] | None = None) -> DataFrame:
    """Every unordered pair i < j within a scenario, with both sides' payload columns.

    Units are hashed into blocks and joined by block pair, an equi-join whose
    tasks hold at most one block against another, whatever the unit count.
    The table has n (n - 1) / 2 rows by definition.
    """
    by = ["scenario"] if by is None else by
    sizes = units.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-sizes // PAIR_BLOCK))
    block = F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int")
    base = units.select(*by, "unit", *payload).withColumn("blk", block)
    left = base.withColumn("other", F.explode(F.sequence("blk", F.lit(blocks - 1))))
    right = base.withColumn("own", F.explode(F.sequence(F.lit(0), "blk")))
    a = left.select(*by, F.col("blk").alias("p"), F.col("other").alias("q"), F.col("unit").alias("u"),
                    *[F.col(c).alias(f"{c}_u") for c in payload])
    b = right.select(*by, F.col("own").alias("p"), F.col("blk").alias("q"), F.col("unit").alias("v"),
                     *[F.col(c).alias(f"{c}_v") for c in payload])
    # Shuffled by tile even when small in bytes: the work is the pairs, not the rows read.
    met = a.join(b.hint("shuffle_hash") if blocks > 1 else b, [*by, "p", "q"]).where((F.col("p") < F.col("q")) | (F.col("u") < F.col("v")))
    ordered = F.col("u") < F.col("v")

    def first(x: str, y: str):
        return F.when(ordered, F.col(x)).otherwise(F.col(y))

    return met.select(*by, first("u", "v").alias("i"), first("v", "u").alias("j"),
                      *[first(f"{c}_u", f"{c}_v").alias(f"{c}_i") for c in payload],
                      *[first(f"{c}_v", f"{c}_u").alias(f"{c}_j") for c in payload])


def in_tiles(units: DataFrame, blocks: int) -> DataFrame:
    """Each unit once per tile (p <= q) its block ``blk`` takes part in."""
    block = F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return units.withColumn("blk", block).withColumn("other", other).select(
        "*", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q")).drop("other")


def feature_distance(pairs: DataFrame, x: str = "x") -> DataFrame:
    return pairs.withColumn("d0", euclidean(F.col(f"{x}_i"), F.col(f"{x}_j")))


def geo_distance(pairs: DataFrame) -> DataFrame:
    """Great-circle distance between centroids, in metres."""
    return pairs.withColumn("d1", haversine_m(*[F.col(c) for c in ("lon_i", "lat_i", "lon_j", "lat_j")]))


def range_normalise(pairs: DataFrame, columns: tuple[str, ...] = ("d0", "d1")) -> DataFrame:
    """Divide each distance by its largest value in the scenario.

    All pairs of a scenario share one key, so nothing is joined: the maxima, one row
    per scenario, become literals of a projection.
    """
    tops = pairs.groupBy("scenario").agg(*[F.max(no_nan(F.col(c))).alias(c) for c in columns]).collect()

    def top(c: str):
        cells = [F.lit(v) for r in tops for v in (r["scenario"], r[c])]
        return F.create_map(*cells)[F.col("scenario")] if cells else F.lit(None).cast("double")

    return pairs.withColumns({c: safe_div(F.col(c), top(c)) for c in columns})


def with_alphas(df: DataFrame, alpha_steps: list[int]) -> DataFrame:
    """Each row once per weight, made in place: no join."""
    return df.withColumn("alpha_step", F.explode(F.array(*[F.lit(int(a)) for a in alpha_steps])))


def grid_cross(df: DataFrame, ks: list[int], alpha_steps: list[int]) -> DataFrame:
    """Each row once per number of clusters and weight, made in place: no join."""
    return with_alphas(df.withColumn("k", F.explode(F.array(*[F.lit(int(v)) for v in ks]))), alpha_steps)


def weight():
    return F.col("alpha_step") / F.lit(100.0)


def blend_linear(pairs: DataFrame) -> DataFrame:
    a = weight()
    return pairs.withColumn("d", (1 - a) * F.col("d0") + a * F.col("d1"))


def blend_squared(pairs: DataFrame) -> DataFrame:
    a = weight()
    return pairs.withColumn("d2", (1 - a) * F.col("d0") * F.col("d0") + a * F.col("d1") * F.col("d1"))


def blend_rescale(pairs: DataFrame) -> DataFrame:
    """Divide the linear blend by its largest value per scenario and weight."""
    group = ["scenario", "alpha_step"]
    tops, seen = written_counted(pairs.groupBy(*group).agg(F.max("d").alias("max_d")), "blend-maxima")
    return (pairs.join(maybe_broadcast(tops, seen["rows"]), group)
            .withColumn("d", safe_div(F.col("d"), F.col("max_d"))).drop("max_d"))


def total_inertia(pairs: DataFrame) -> DataFrame:
    """Sum of squared dissimilarities over n^2, with equal weights 1 / n, for both tables."""
    rows = F.count(F.lit(1))
    # n (n - 1) / 2 = rows, so n = (1 + sqrt(1 + 8 rows)) / 2.
    n = F.round((1 + F.sqrt(1 + 8 * rows)) / 2)
    return pairs.groupBy("scenario").agg(
        (F.sum(F.col("d0") * F.col("d0")) / (n * n)).alias("t0"),
        (F.sum(F.col("d1") * F.col("d1")) / (n * n)).alias("t1"))
