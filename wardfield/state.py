"""Tables cut out of a long plan, and the size limits used when choosing a join."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its counted rows stay under this (rows here are < 120 bytes).
BROADCAST_ROWS = 500_000

# One worker's block of units in a pair tile.
BLOCK_ROWS = 2_048

_LOCAL_ROOTS: dict[str, str] = {}


def state_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it.

    Only a local session without the setting gets a folder of its own; on a
    cluster every executor must see the folder, so there it has to be named.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="wardfield-")
    return _LOCAL_ROOTS[app]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    home = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or not home.is_dir():
        return
    bundle = Path(tempfile.mkdtemp(prefix="wardfield-")) / "wardfield.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    spark.sparkContext.addPyFile(str(bundle))
    _SHIPPED.add(app)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{state_root(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each query go when it ends; the caller's setting returns afterwards.

    A table that is written is not computed again, so nothing asks for its shuffles later; without
    this they would stay on the executors' disks until the driver collects garbage.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: later plans start from the table.

    The table lives in shared storage, so a lost executor costs a re-read and
    not the plan that made it.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, label)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`written` or :class:`Rounds` that no later plan reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def written_counted(df: DataFrame, label: str, path: str | None = None,
                    **metrics) -> tuple[DataFrame, dict]:
    """Like :func:`written`, with aggregates gathered during the same write."""
    seen = Observation()
    cols = [F.count(F.lit(1)).alias("rows")]
    cols += [expr.alias(name) for name, expr in metrics.items()]
    table = written(df.observe(seen, *cols), label, path)
    return table, seen.get


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side of counted size; beyond the limit leave it to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# Rows per task of an iteration; its shuffle partitions follow from the table's size.
TASK_ROWS = 500_000


class Rounds:
    """A session for the steps of an iteration, sized to a table that shrinks as it runs.

    The caller's session keeps its settings, and all that can be set at run time holds
    here too; only the number of shuffle tasks follows the table. Every kept table is in
    shared storage, so a lost executor re-reads it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.folder = new_folder(spark, label)
        self.session = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if self.session.conf.isModifiable(key):
                self.session.conf.set(key, value)

    def fit(self, rows: int) -> None:
        self.session.conf.set("spark.sql.shuffle.partitions", str(max(1, -(-rows // TASK_ROWS))))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table, of this session or the caller's, and open it in this one."""
        path = f"{self.folder}/{name}"
        with shuffles_freed(df.sparkSession):
            df.write.parquet(path)
        return self.session.read.schema(df.schema).parquet(path)

    def keep_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Like :meth:`keep`, with the row count gathered during the write."""
        seen = Observation()
        table = self.keep(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        return table, seen.get["rows"]

    def drop(self, name: str) -> None:
        """Delete a kept table once the next one is written from it."""
        discard(self.session, f"{self.folder}/{name}")

    def give(self, tables: list[DataFrame], spark: SparkSession) -> DataFrame:
        """The tables of all steps as one table of the caller's session."""
        path = f"{self.folder}/result"
        for start in range(0, len(tables), 64):
            part = tables[start]
            for t in tables[start + 1:start + 64]:
                part = part.unionByName(t)
            part.write.mode("append").parquet(path)
        return spark.read.schema(tables[0].schema).parquet(path)
