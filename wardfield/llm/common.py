"""Helpers the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..state import ship_package

#: Words everywhere are maximal runs of characters outside this ASCII white space; bytes.split() cuts the same.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows handled at once in a Python worker: long texts take many megabytes otherwise.
BATCH_ROWS = 128
#: Bytes of one Arrow batch between Spark and a Python worker, where the session allows more.
BATCH_BYTES = 16 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: bytes | str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for a null."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).split()


def split_words(text: Column) -> Column:
    """The same words as a column; an empty array for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fold(doc_id: Column, parts: int) -> Column:
    """Fold of a document: CRC-32 of its id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def over_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                 schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers, and batches of a bounded size.

    The bound is a setting of the session, read when the query runs; a caller's own value stays. A worker serves many
    tasks: what one has freed goes back to the system when it ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BYTES_SETTING, None) is None:
        spark.conf.set(_BYTES_SETTING, str(BATCH_BYTES))

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory of this worker to the system, where the platform can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What a Python worker keeps between tasks: one thing at a time, so that the memory of operators that run one
    after the other in one worker doesn't add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def with_columns(df: DataFrame, added: list[T.StructField],
                 make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """All columns of ``df`` plus ``added``, which ``make`` derives from each batch.

    ``added`` names must be new; the columns of ``df`` pass through as they are.
    """
    clash = {f.name.lower() for f in added} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part)], names=schema.names)

    return over_batches(df, run, schema)


def new_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
