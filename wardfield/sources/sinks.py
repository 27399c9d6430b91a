"""Result tables written out; every write replaces what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cluster_profiles(profiles: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per partition of the units, named by ``sheet``."""
    profiles.write.mode("overwrite").partitionBy("sheet").format(fmt).option(
        "header", True).save(path)


def ari_wide(ari: DataFrame, keys: list[str]) -> DataFrame:
    """Long agreement table to a matrix: one row and one column per partition."""
    cells = [F.max(F.when(F.col("right_key") == k, F.col("ari"))).alias(k) for k in keys]
    return ari.groupBy("left_key").agg(*cells)


def write_ari(ari: DataFrame, keys: list[str], path: str, fmt: str = "parquet") -> None:
    ari_wide(ari, keys).write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_cluster_maps(layer: DataFrame, path: str) -> None:
    """Map layers, one folder per (k, alpha_step): readers prune to the map they draw."""
    layer.write.mode("overwrite").partitionBy("k", "alpha_step").parquet(path)
