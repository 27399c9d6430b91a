"""Embedding whitening from an exact, bit-sliced scatter matrix.

Components become integers. Each dimension is shifted to start at zero and cut into bit planes; the planes of many rows are
packed into 64-bit words, so the product sum of two dimensions is a sum of AND-popcounts weighted by powers of two. These sums
are exact for any number of rows. They are centred as integers, and only then turned into the floating-point covariance whose
eigenvectors whiten the vectors.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..state import written
from .common import over_batches

#: Rows whose bit planes are held at once: 64 words a plane.
ROWS = 4_096
#: Sums travel as limbs of this many bits, so that adding them up in 64-bit columns is exact.
LIMB = 30
#: Integers of this size or more leave no room for differences in 64 bits.
LARGEST = 2.0**61


def integers(vectors: pa.Array, scale: float, shift: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: the rows that take part and the matrix of their ``floor(scale * c) + shift``.

    Vectors that are null or hold a null or non-finite entry take no part. An entry too large for a 64-bit integer
    is an error, since no row can be dropped for it.
    """
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(rows)).flatten()
        whole = np.ones(len(flat), bool) if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False)
        c = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        fine = whole.reshape(-1, size).all(axis=1) & np.isfinite(c).all(axis=1)
        x = np.floor(scale * c[fine])
        if len(x) and np.abs(x).max() >= LARGEST:
            raise ValueError("an entry doesn't fit into a 64-bit integer")
        if fine.any():
            out[size] = rows[fine], x.astype(np.int64) + shift
    return out


def _extent(scale: float, shift: int):
    """Per length of vector and dimension of a partition: rows, smallest and largest integer."""
    def run(batches):
        rows: dict[int, int] = defaultdict(int)
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for b in batches:
            for size, (at, x) in integers(b.column(0), scale, shift).items():
                rows[size] += len(at)
                low[size] = np.minimum(low.get(size, x[0]), x.min(axis=0))
                high[size] = np.maximum(high.get(size, x[0]), x.max(axis=0))
        for size, n in rows.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(np.full(size, n)),
                                              pa.array(low[size]), pa.array(high[size])], names=["size", "dim", "n", "low", "high"])
    return run


class Planes:
    """Sums of products of non-negative integers, by dimension pair, from popcounts of packed bit planes."""

    def __init__(self, bits: list[int]):
        self.size = len(bits)
        self.dim = np.repeat(np.arange(self.size), bits)
        self.bit = np.concatenate([np.arange(n) for n in bits]).astype(np.int64) if self.size else np.zeros(0, np.int64)
        self.first = np.r_[0, np.cumsum(bits)].astype(int)
        limbs = 2 * max(bits, default=0) // LIMB + 4
        self.products = np.zeros((limbs, self.size, self.size), np.int64)
        self.sums = np.zeros((limbs, self.size), np.int64)

    def add(self, u: np.ndarray) -> None:
        """Rows of integers; at most ROWS, so that a count times a power below the limb fits."""
        packed = np.zeros((len(self.dim), -(-len(u) // 64) * 8), np.uint8)
        for d in range(self.size):
            mine = slice(self.first[d], self.first[d + 1])
            planes = np.packbits((u[:, d] >> self.bit[mine, None] & 1).astype(bool), axis=1, bitorder="little")
            packed[mine, :planes.shape[1]] = planes
        packed = packed.view(np.uint64)
        self._spread(self.sums, np.bitwise_count(packed).sum(axis=1, dtype=np.int64), self.bit, (self.dim,))
        for d in range(self.size):
            start, end = self.first[d], self.first[d + 1]
            for p in range(start, end):
                counts = np.bitwise_count(packed[start:] & packed[p]).sum(axis=1, dtype=np.int64)
                self._spread(self.products[:, d], counts, self.bit[start:] + self.bit[p], (self.dim[start:],))
        for acc in (self.products, self.sums):
            for limb in range(len(acc) - 1):
                acc[limb + 1] += acc[limb] >> LIMB
                acc[limb] &= (1 << LIMB) - 1

    @staticmethod
    def _spread(acc: np.ndarray, counts: np.ndarray, power: np.ndarray, at: tuple) -> None:
        np.add.at(acc, (power // LIMB, *at), counts << power % LIMB)


def _scatter(scale: float, shift: int, size: int, low: np.ndarray, bits: list[int]):
    """Of a partition: limbs of the sums (``e`` = -1) and of the product sums of dimensions d <= e."""
    def run(batches):
        planes = Planes(bits)
        for b in batches:
            _, x = integers(b.column(0), scale, shift).get(size, (None, np.zeros((0, size), np.int64)))
            for at in range(0, len(x), ROWS):
                planes.add(x[at:at + ROWS] - low)
        d, e = np.triu_indices(size)
        limbs = np.concatenate([planes.sums.T, planes.products[:, d, e].T])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.arange(size), d]), pa.array(np.r_[np.full(size, -1), e]), *[pa.array(c) for c in limbs.T.copy()]],
            names=["d", "e", *[f"l{i}" for i in range(limbs.shape[1])]])
    return run


class Whitening:
    """What a fit gives: ``n`` rows, exact sums, eigenvalues from the largest down and unit eigenvectors in columns."""

    def __init__(self, n: int, low: list[int], sums: list[int], products: list[list[int]]):
        """``sums`` and ``products`` (Python integers) of the rows less ``low``."""
        size = len(low)
        self.n, self.low, self.sums = n, np.array(low, np.int64), sums
        centred = [[n * products[d][e] - sums[d] * sums[e] for e in range(size)] for d in range(size)]
        cov = np.array([[c / (n * n) for c in row] for row in centred]).reshape(size, size)
        values, vectors = np.linalg.eigh(cov)
        self.values, vectors = values[::-1], vectors[:, ::-1]
        lead = np.abs(vectors).argmax(axis=0)
        self.vectors = vectors * np.where(vectors[lead, np.arange(size)] < 0, -1.0, 1.0)
        self.trace = sum(centred[d][d] for d in range(size)) / (n * n)
        # What lies below is rounding of the decomposition: there is no direction to scale.
        self.rank = int((self.values > size * np.finfo(float).eps * max(float(self.values[0]), 0.0)).sum()) if size else 0

    def explained(self, k: int) -> list[float]:
        return [float(v / self.trace) for v in self.values[:k]]

    def apply(self, x: np.ndarray, k: int) -> tuple[list[int], np.ndarray]:
        """Of each row: sum of squares of ``n * x - S`` as exact integers, and its first ``k`` whitened components."""
        u = x - self.low
        reach = float(u.max(initial=0)) * self.n
        if u.shape[1] * reach * reach < 2.0**62:
            away = self.n * u - np.array(self.sums, np.int64)
            squares = (away * away).sum(axis=1).tolist()
        else:
            away = self.n * u.astype(object) - np.array(self.sums, object)
            squares = (away * away).sum(axis=1).tolist()
        centred = np.array(away / self.n, np.float64)
        return squares, centred @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def fit(vectors: DataFrame, scale: float = 1024.0, shift: int = 100_000) -> Whitening | None:
    """Statistics of a one-column table of vectors; None if no vector takes part.

    The dimension is that of most vectors (the larger one of a tie); vectors of another length take no part. The driver gets
    one row for each dimension and each pair of dimensions, whatever the number of rows.
    """
    extent = over_batches(vectors, _extent(scale, shift), "size long, dim long, n long, low long, high long")
    found = extent.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    most = found.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None
    size, n = most["size"], most["n"]
    dims = found.where(F.col("size") == size).orderBy("dim").collect()
    low = [r["low"] for r in dims]
    bits = [(r["high"] - r["low"]).bit_length() for r in dims]
    limbs = Planes(bits).products.shape[0]
    names = [f"l{i}" for i in range(limbs)]
    schema = ", ".join(f"{c} long" for c in ("d", "e", *names))
    parts = over_batches(vectors, _scatter(scale, shift, size, np.array(low), bits), schema)
    rows = parts.groupBy("d", "e").agg(*[F.sum(c).alias(c) for c in names]).collect()
    sums, products = [0] * size, [[0] * size for _ in range(size)]
    for r in rows:
        value = reduce(lambda total, c: (total << LIMB) + r[c], reversed(names), 0)
        if r["e"] < 0:
            sums[r["d"]] = value
        else:
            products[r["d"]][r["e"]] = products[r["e"]][r["d"]] = value
    return Whitening(n, low, sums, products)


def whiten(vectors: DataFrame, fitted: Whitening, components: int, id_: str = "vec_id", vector: str = "embedding",
           scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """``(id, deviation, whitened)`` of each vector of the fitted length: an exact decimal and an array of components."""
    k, size = min(components, fitted.rank), len(fitted.low)
    kind = dict(vectors.dtypes)[id_]

    def run(batches):
        for b in batches:
            at, x = integers(b.column(1), scale, shift).get(size, (np.zeros(0, int), np.zeros((0, size), np.int64)))
            squares, w = fitted.apply(x, k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array([str(s) for s in squares], pa.string()), pa.array(list(w), pa.list_(pa.float64()))],
                names=["id", "deviation", "whitened"])

    got = over_batches(vectors.select(id_, vector), run, f"id {kind}, deviation string, whitened array<double>")
    return got.withColumnRenamed("id", id_)


def whitened_rows(vectors: DataFrame, components: int = 8, id_: str = "vec_id", vector: str = "embedding",
                  scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """One row for each vector and component: ``(id, component, n, deviation, whitened, explained, identity_error)``.

    All vectors without null or non-finite entries are fitted and returned, also with a null or repeated id; columns
    beside id and vector play no part. ``deviation`` is exact, and null where it is beyond 64 bits. Components whose
    eigenvalue is zero within rounding (constant or repeated vectors, fewer vectors than dimensions) have no scale and are left out, so
    one vector, or none, gives no rows. ``identity_error`` is measured on the returned values.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_]
    schema = f"{id_} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(vectors.select(vector), scale, shift)
    k = min(components, fitted.rank) if fitted else 0
    if not k:
        return spark.createDataFrame([], schema)
    rows = written(whiten(vectors, fitted, k, id_, vector, scale, shift), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    shares = F.array(*[F.lit(v) for v in fitted.explained(k)])
    each = rows.select(F.col(id_), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(id_, (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
                       shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
