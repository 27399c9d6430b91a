"""Pairs of blocks of rows without moving a row once per pair.

A block is one row that holds some thousand units as bytes. The written blocks are crossed with themselves: a task reads one share of
them against another from storage, so nothing is shuffled however many pairs there are, and what a task returns can be added up over all
its pairs before it leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..state import BLOCK_ROWS, ship_package, written


# Files of a block table, so shares of it that tasks cross, and the most blocks of a file; blocks of a small table, and the fewest rows of those.
FILES, FILE_BLOCKS = 16, 32
BLOCKS, LEAST_ROWS = 32, 256


def block_count(units: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, -(-units // block_rows))


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack(column: pa.Array, i: int) -> pa.Table:
    return pa.ipc.open_stream(column[i].as_buffer()).read_all()


def packed(units: DataFrame, count: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(blk, rows): the units by hash in blocks of at most about ``block_rows``, sorted by unit, one row a block; a written table.

    The number of files stays the same up to FILES * FILE_BLOCKS blocks, and with it the number of tasks that a unit takes part in.
    """
    ship_package(units.sparkSession)
    blocks = block_count(count, min(block_rows, max(LEAST_ROWS, -(-count // BLOCKS))))
    block = F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int")

    def one(rows: pa.Table) -> pa.Table:
        return pa.table({"blk": rows["blk"].combine_chunks()[:1], "rows": pa.array([pack(rows.drop_columns("blk").sort_by("unit"))], pa.binary())})

    return written(units.withColumn("blk", block).repartition(max(FILES, -(-blocks // FILE_BLOCKS)), "blk").groupBy("blk").applyInArrow(one, "blk int, rows binary"), "blocks")


def crossed(blocks: DataFrame, name: str = "blk", where: Column | None = None) -> DataFrame:
    """Every unordered pair of blocks once, a block with itself too; columns end in ``_a`` and ``_b``.

    ``name`` is the column of distinct block numbers; ``where`` a further condition on a pair, tested before a pair is put together. Of the two orders of a
    pair the sum of the numbers picks one, so that every task has about half of its pairs.
    """
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns]) for s in "ab")
    p, q = F.col(f"{name}_a"), F.col(f"{name}_b")
    pick = (p == q) | ((p < q) == ((p + q) % 2 == 0))
    # Rows are blocks: their cross product is small, and each task of it re-reads two shares of the table.
    return a.hint("shuffle_replicate_nl").join(b, pick if where is None else pick & where)


def _redone(d2: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, ma: np.ndarray | None = None, mb: np.ndarray | None = None) -> np.ndarray:
    """``d2`` from products, redone directly where the terms nearly cancel: there the product form is inexact.

    ``na`` and ``nb`` are the squared lengths, ``ma`` and ``mb`` tell which coordinates are there.
    """
    bound = 1e-6 * float(na.max(initial=0) + nb.max(initial=0))
    if not d2.size or d2.min() > bound:
        return d2
    i, j = np.nonzero(d2 <= bound)
    close = d2[i, j] <= 1e-6 * (np.broadcast_to(na, d2.shape)[i, j] + np.broadcast_to(nb, d2.shape)[i, j])
    i, j = i[close], j[close]
    for s in range(0, len(i), 100_000):
        ii, jj = i[s:s + 100_000], j[s:s + 100_000]
        gap = a[ii] - b[jj]
        if ma is not None:
            gap = gap * ma[ii] * mb[jj]
        d2[ii, jj] = (gap * gap).sum(1)
    return d2


# Rows of a strip of distances, so that one stays in a processor's cache.
STRIP = 64


def squared_strips(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """:func:`squared` in strips of rows: the first row of each, and its distances, which the next strip overwrites."""
    if np.isnan(a).any() or np.isnan(b).any():
        for s in range(0, len(a), STRIP):
            yield s, squared(a[s:s + STRIP], b)
        return
    na, nb = (a * a).sum(1)[:, None], (b * b).sum(1)[:, None]
    # Lengths are columns of their own, so one product is the whole sum.
    left, right = np.hstack([-2 * a, na, np.ones_like(na)]), np.hstack([b, np.ones_like(nb), nb])
    room = np.empty((min(STRIP, len(a)), len(b)))
    for s in range(0, len(a), STRIP):
        part = left[s:s + STRIP]
        d2 = np.matmul(part, right.T, out=room[:len(part)])
        yield s, _redone(d2, a[s:s + STRIP], b, na[s:s + STRIP], nb.T)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances; missing coordinates are skipped and scaled for."""
    holes = np.isnan(a).any() or np.isnan(b).any()
    if holes:
        ma, mb = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
        a, b = np.nan_to_num(a), np.nan_to_num(b)
        na, nb, shared = (a * a) @ mb.T, ma @ (b * b).T, ma @ mb.T
    else:
        na, nb = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    d2 = a @ b.T
    d2 *= -2
    d2 += na
    d2 += nb
    d2 = _redone(d2, a, b, na, nb, *((ma, mb) if holes else ()))
    if holes:
        with np.errstate(divide="ignore", invalid="ignore"):
            d2 = np.where(shared > 0, d2 * a.shape[1] / shared, np.nan)
    return d2
