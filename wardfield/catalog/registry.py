"""Where queries register themselves, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reshape, spatial
from ..plans import scenarios, study
from ..sources import tables, views
from ..state import new_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES: dict[str, str] = {}
TARGETS = {"R12": ["R12"], "R34": ["R34"]}


def query(name: str, sql: str | None = None):
    """Register ``fn(workspace)`` under ``name``."""
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(workspace(spark, folder))
        MODULES[name] = fn.__module__
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def by_size(df: DataFrame, *columns: str) -> DataFrame:
    """Round panel values for comparison: fewer digits for large sums, and enough for
    averages of cents not to end on a half."""
    def one(c: str):
        v = F.col(f"`{c}`")
        return F.when(F.abs(v) >= 1e6, F.round(v, 2)).when(F.abs(v) >= 1000, F.round(v, 6)).otherwise(F.round(v, 8))
    return df.withColumns({c: one(c) for c in columns})


def by_size_sql(c: str) -> str:
    return f"CASE WHEN abs({c}) >= 1e6 THEN round({c}, 2) WHEN abs({c}) >= 1000 THEN round({c}, 6) ELSE round({c}, 8) END"


class Workspace:
    """Tables of one input folder that several queries start from, each built once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def star(self, name: str) -> DataFrame:
        return tables.star(self.spark, self.folder, name)

    @cached_property
    def panel_path(self) -> str:
        path = new_folder(self.spark, "panel")
        views.panel(self.spark, self.folder).write.parquet(path)
        return path

    @property
    def panel(self) -> DataFrame:
        return tables.load_panel(self.spark, self.panel_path, views.PERIODS)

    @cached_property
    def boundaries_path(self) -> str:
        path = new_folder(self.spark, "boundaries")
        views.raw_boundaries(self.spark, self.folder).write.parquet(path)
        return path

    @property
    def boundaries(self) -> DataFrame:
        return tables.load_boundaries(self.spark, self.boundaries_path)

    @cached_property
    def wide(self) -> DataFrame:
        return written(reshape.pivot_variables(self.panel, views.VARIABLES, views.FULL), "wide")

    @property
    def points(self) -> DataFrame:
        """Nation positions with the integer unit beside the code."""
        return views.nation_points(self.spark, self.folder).withColumn(
            "unit", F.substring("code", 2, 9).cast("bigint"))

    def units(self, sets: dict[str, list[str]]) -> DataFrame:
        return study.scenario_units(self.wide, self.points, sets)

    @cached_property
    def main(self) -> study.Study:
        """Both targets in one study: their trees grow in the same rounds."""
        return study.Study(self.units(TARGETS))

    @cached_property
    def final(self) -> DataFrame:
        """Final partitions of both targets, with the value they were built from."""
        return written(self.main.cluster_units(), "final")

    @cached_property
    def target_values(self) -> DataFrame:
        """(scenario, unit, value): the unscaled target of each scenario."""
        cells = F.explode(F.array(*[F.struct(F.lit(t).alias("scenario"), F.col(t).alias("value"))
                                    for t in TARGETS])).alias("c")
        return written(self.wide.join(self.points, "code").select("unit", cells).select(
            "c.scenario", "unit", "c.value"), "targets")

    @cached_property
    def scenario_labels(self) -> DataFrame:
        sets = scenarios.scenario_columns(self.wide)
        units = written(self.units(sets), "scenario-units")
        pairs = written(study.centroid_pairs(units), "scenario-pairs")
        return written(study.final_study(units, pairs), "scenario-labels")

    @cached_property
    def mapped_points(self) -> DataFrame:
        """Centroids of the largest polygons of the scattered boundaries, with the integer unit beside the code."""
        middle = spatial.centroid(views.scattered_boundaries(self.spark, self.folder))
        return written(middle.withColumn("unit", F.substring("code", 2, 9).cast("bigint")), "mapped-points")

    @cached_property
    def mapped_distances(self) -> DataFrame:
        """(i, j, d1): distances of the scattered boundaries, which every scenario shares."""
        areas = views.scattered_boundaries(self.spark, self.folder).select(
            F.substring("code", 2, 9).cast("bigint").alias("unit"), "parts")
        return written(spatial.boundary_distance(areas), "mapped-distances")

    @cached_property
    def mapped(self) -> study.Study:
        """Both targets on the scattered boundaries: their distance as geography, shape centroids as places."""
        units = written(study.scenario_units(self.wide, self.mapped_points, TARGETS), "mapped-units")
        return study.Study(units, study.study_pairs(units, self.mapped_distances))

    @cached_property
    def straight(self) -> study.VectorStudy:
        """Both targets with places as points of the unit sphere: no table of pairs."""
        return study.VectorStudy(self.units(TARGETS))

    @cached_property
    def mapped_scenario_labels(self) -> DataFrame:
        sets = scenarios.scenario_columns(self.wide)
        units = written(study.scenario_units(self.wide, self.mapped_points, sets), "mapped-scenario-units")
        pairs = written(study.study_pairs(units, self.mapped_distances), "mapped-scenario-pairs")
        return written(study.final_study(units, pairs), "mapped-scenario-labels")

    @cached_property
    def given_labels(self) -> DataFrame:
        """(key, unit, cluster): two partitions of the nations known without a tree."""
        n = self.star("nation")
        both = F.explode(F.array(
            F.struct(F.lit("region").alias("key"), F.col("n_regionkey").alias("cluster")),
            F.struct(F.lit("mod4").alias("key"), (F.col("n_nationkey") % 4).alias("cluster")))).alias("p")
        return n.select(F.col("n_nationkey").cast("bigint").alias("unit"), both).select(
            "p.key", "unit", "p.cluster")


# The input tables; a workspace is built anew when one of them has changed.
TABLES = ("nation", "customer", "supplier", "orders", "lineitem", "embeddings")
_WORKSPACES: dict[tuple, Workspace] = {}


def _written_at(spark: SparkSession, folder: str) -> tuple[int, ...]:
    """When each input table was last written; 0 for one that isn't there."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    times = []
    for t in TABLES:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}.parquet")
        store = place.getFileSystem(conf)
        times.append(store.getFileStatus(place).getModificationTime() if store.exists(place) else 0)
    return tuple(times)


def workspace(spark: SparkSession, folder: str) -> Workspace:
    key = (spark.sparkContext.applicationId, folder, _written_at(spark, folder))
    if key not in _WORKSPACES:
        _WORKSPACES[key] = Workspace(spark, folder)
    return _WORKSPACES[key]


def forget() -> None:
    """Drop all shared tables, so that the next query builds its own."""
    _WORKSPACES.clear()
