"""Counts, quantiles, scaling, moments, correlation and z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import no_nan, safe_div
from ..state import maybe_broadcast, written_counted
from .ranks import quantiles


def count_groups(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().withColumnRenamed("count", "n")


def column_quantiles(df: DataFrame, columns: list[str],
                     probs: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column, read on the driver (a few numbers per column).

    Ranks are found by histogram passes at every size, so no buffer grows with the values.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("key"), no_nan(F.col(c).cast("double")).alias("v")) for c in columns
    ])).alias("r")).select("r.key", "r.v")
    got = quantiles(long, probs)
    return {c: got.get(c, [None] * len(probs)) for c in columns}


def panel_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, q1, median, mean, q3, max and missing count, one row per column."""
    stats = []
    for c in columns:
        v = no_nan(F.col(c).cast("double"))
        stats += [F.min(v).alias(f"{c}|min"), F.avg(v).alias(f"{c}|mean"), F.max(v).alias(f"{c}|max"),
                  F.count_if(v.isNull()).alias(f"{c}|n_missing")]
    base = df.agg(*stats).first()
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = [(c, base[f"{c}|min"], q[c][0], q[c][1], base[f"{c}|mean"], q[c][2], base[f"{c}|max"],
             base[f"{c}|n_missing"]) for c in columns]
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, q1 double, median double, mean double, q3 double, "
              "max double, n_missing bigint")


def robust_stats(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Median and interquartile range per column, missing values ignored."""
    q = column_quantiles(wide, columns, [0.25, 0.5, 0.75])
    rows = [(c, v[1], None if v[0] is None else v[2] - v[0]) for c, v in q.items()]
    return wide.sparkSession.createDataFrame(rows, "variable string, median double, iqr double")


def robust_scale(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR per column, NULL where the IQR is zero.

    The statistics (three numbers per column) become literals, so scaling is a
    plain projection inside the scan stage and needs no join.
    """
    q = column_quantiles(wide, columns, [0.25, 0.5, 0.75])

    def scaled(c: str):
        lo, mid, hi = q[c]
        if mid is None:
            return F.lit(None).cast("double").alias(c)
        return safe_div(F.col(c) - F.lit(mid), F.lit(hi - lo)).alias(c)

    return wide.withColumns({c: scaled(c) for c in columns})


def global_max(pairs: DataFrame, column: str) -> DataFrame:
    return pairs.groupBy("scenario").agg(F.max(no_nan(F.col(column))).alias("max_value"))


def cluster_profile(units: DataFrame, labels: DataFrame, value: str, keys: list[str],
                    on: list[str] | None = None) -> DataFrame:
    """Mean, sd, skewness and raw kurtosis of ``value`` per cluster, for all partitions at once."""
    on = ["unit"] if on is None else on
    v = no_nan(F.col(value))
    return (labels.join(units.select(*on, value), on).groupBy(*keys, "cluster")
            .agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
                 F.skewness(v).alias("skew"), (F.kurtosis(v) + 3).alias("kurt")))


def correlation_matrix(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation for all ordered column pairs, diagonal included.

    One scan: the co-moments of every unordered pair are aggregates of the same
    row, so the row never multiplies. A pair with any missing value, or with a
    constant column, has no correlation and is left out.
    """
    def complete(c: str):
        return F.count(no_nan(F.col(c).cast("double"))) == F.count(F.lit(1))

    spread = [F.stddev_pop(c).alias(f"s|{c}") for c in columns]
    full = [complete(c).alias(f"n|{c}") for c in columns]
    # A constant column gives zero spread; covariances never divide by it.
    shared = [F.covar_pop(a, b).alias(f"c|{i}|{j}") for i, a in enumerate(columns)
              for j, b in enumerate(columns) if i < j]
    one = wide.agg(*spread, *full, *shared)

    def cell(i: int, j: int):
        a, b = columns[i], columns[j]
        sa, sb = F.col(f"s|{a}"), F.col(f"s|{b}")
        usable = F.col(f"n|{a}") & F.col(f"n|{b}") & (sa > 0) & (sb > 0)
        r = F.lit(1.0) if i == j else safe_div(F.col(f"c|{min(i, j)}|{max(i, j)}"), sa * sb)
        return F.struct(F.lit(a).alias("reg1"), F.lit(b).alias("reg2"),
                        F.when(usable, r).alias("value"))

    p = range(len(columns))
    cells = one.select(F.explode(F.array(*[cell(i, j) for i in p for j in p])).alias("r")).select("r.*")
    return melt_matrix(cells)


def melt_matrix(long: DataFrame, value: str = "value") -> DataFrame:
    """Matrix cells in long form without the missing ones."""
    return long.where(F.col(value).isNotNull())


def zscore_by_group(df: DataFrame, value: str = "value", by: str = "name") -> DataFrame:
    """(value - mean) / sd within each group.

    Group means and deviations come from a partial aggregate and are joined back by
    a size-checked broadcast, so a large group is never gathered in one task.
    """
    g, seen = written_counted(df.groupBy(by).agg(
        F.avg(value).alias("g_mean"), F.stddev_samp(value).alias("g_sd")), "group-moments")
    return (df.join(maybe_broadcast(g, seen["rows"]), by)
            .withColumn("value_std", safe_div(F.col(value) - F.col("g_mean"), F.col("g_sd")))
            .drop("g_mean", "g_sd"))


def heatmap_table(matrix: DataFrame, measure: str, keep: list[str] | None = None) -> DataFrame:
    """Matrix cells with their z-score; the row filter comes after the z-score."""
    long = zscore_by_group(matrix.select(
        "reg1", "reg2", F.lit(measure).alias("name"), "value"))
    return long if keep is None else long.where(F.col("reg1").isin(keep))


def number_clusters(labels: DataFrame, keys: list[str], cluster: str = "cid") -> DataFrame:
    """Replace cluster ids (their smallest unit) by 1, 2, ... in the order of first unit.

    Only the distinct ids of a partition are ranked, never its units.
    """
    ids = labels.select(*keys, cluster).distinct()
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(cluster))
    numbered, seen = written_counted(ids.withColumn("cluster", rank.cast("int")), "cluster-numbers")
    return labels.join(maybe_broadcast(numbered, seen["rows"]), [*keys, cluster]).drop(cluster)
