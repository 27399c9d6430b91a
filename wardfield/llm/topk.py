"""Exact top-k inner products by retrieval over buckets of similar length.

Vectors are grouped by length into buckets, and buckets cut into blocks. Against a block every query has a local cosine
threshold: what it must reach with the block's longest vector to enter its best k so far. A threshold above one rules the block
out; a low one prunes by length alone; otherwise candidates must lie, in the query's strongest coordinates,
within the range that the threshold leaves. What is left is verified with whole products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..state import ship_package, written
from .common import over_batches

#: Vectors in a block and queries in a block: what one task holds.
BLOCK, QUERIES = 4_096, 1_024
#: Lengths in a bucket differ by this factor at most.
GROWTH = 1.1
#: Coordinates a candidate is checked in, and the local threshold from which that pays.
FOCUS, WORTH = 3, 0.25
SLACK = 1e-9
_SCHEMA = "vec_id long, components binary, length double, bucket int"


def integers(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``(vec_id, components, length, bucket)``: ``floor(scale * x)`` of every component as packed 64-bit integers.

    Vectors that are null or hold a null or non-finite component, and rows without an id, take no part. An
    empty vector and one of zeros have length 0 and bucket ``-2**30``.
    """
    def run(batches):
        for b in batches:
            ids, packed, lengths = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid:
                    continue
                x = v.values
                if x.null_count:
                    continue
                y = x.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(y).all():
                    continue
                y = np.clip(np.floor(scale * y), -2.0**62, 2.0**62)
                ids.append(i)
                packed.append(y.astype(np.int64).tobytes())
                lengths.append(float(np.sqrt((y * y).sum())))
            n = np.array(lengths)
            bucket = np.where(n > 0, np.floor(np.log(np.maximum(n, 1e-300)) / np.log(GROWTH)), -2**30).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()),
                                              pa.array(n, pa.float64()), pa.array(bucket, pa.int32())],
                                             names=["vec_id", "components", "length", "bucket"])

    return over_batches(vectors.select(F.col(id_).cast("long").alias("vec_id"), vector), run, _SCHEMA)


def _matrix(packed) -> np.ndarray:
    rows = [np.frombuffer(p, np.int64) for p in packed]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray,
                 k: int) -> list[tuple[int, int, int]]:
    """``(query row, vec_id, score)`` of the block's best ``k`` of each query with scores of at least ``least``.

    ``least`` is a score that k others are known to reach, or NaN.
    """
    width = max(vectors.shape[1], queries.shape[1])
    vectors, queries = _padded(vectors, width), _padded(queries, width)
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")  # longest first: pruning by length keeps a prefix
    ids, vectors, length = ids[order], vectors[order], length[order]
    unit = (vectors / np.maximum(length, 1e-300)[:, None]).T.copy()
    longest = length[0] if len(length) else 0.0
    found = []
    for row, (qid, q) in enumerate(zip(query_ids.tolist(), queries)):
        size = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        need = least[row]
        upto, within = len(ids), None
        if need == need and need > 0:
            if size == 0 or longest == 0:
                continue
            local = need / (size * longest) * (1 - SLACK)
            if local > 1:
                continue  # nothing in this block is long enough
            upto = int(np.searchsorted(-length, -need / size * (1 - SLACK), side="right"))
            if local >= WORTH and upto:
                way = q / size
                cone = np.arccos(local) + SLACK ** 0.5
                within = np.ones(upto, bool)
                for c in np.argsort(-np.abs(way))[:FOCUS]:
                    angle = np.arccos(np.clip(way[c], -1, 1))
                    low, high = np.cos(min(np.pi, angle + cone)), np.cos(max(0.0, angle - cone))
                    within &= (unit[c, :upto] >= low - SLACK) & (unit[c, :upto] <= high + SLACK)
        at = np.arange(upto) if within is None else np.flatnonzero(within)
        at = at[ids[at] != qid]
        if not len(at):
            continue
        if size * longest < 2.0**52:
            score = (vectors[at].astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        else:  # beyond exact floating point: whole numbers, held within 64 bits
            score = np.clip(vectors[at].astype(object) @ q.astype(object), -2**63, 2**63 - 1).astype(np.int64)
        if need == need:
            keep = score >= need
            at, score = at[keep], score[keep]
        best = np.lexsort((ids[at], -score))[:k]
        found += [(row, int(ids[at[b]]), int(score[b])) for b in best]
    return found


def _grouped(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "query": "int64", "vec_id": "int64", "score": "int64"})
        got = search_block(vectors["vec_id"].to_numpy(), _matrix(vectors["components"]), queries["vec_id"].to_numpy(),
                           _matrix(queries["components"]), queries["least"].to_numpy(np.float64), k)
        row = np.array([g[0] for g in got], np.int64)
        return pd.DataFrame({"query_id": queries["vec_id"].to_numpy()[row], "query": queries["query"].to_numpy()[row],
                             "vec_id": np.array([g[1] for g in got], np.int64), "score": np.array([g[2] for g in got], np.int64)})
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best products of each query, all if there are fewer.

    ``vectors`` come from :func:`integers`. Queries are rows whose id is divisible by ``every``; rows with the
    query's id are its own and no candidates. Rows that repeat a query in id and components ask once; repeated
    candidates count as often as they come. Ties go to the smaller id. Vectors of different lengths count as
    filled with zeros. Scores are held within 64 bits. An empty table gives an empty result.

    A first pass over one block of the fullest bucket gives thresholds, the second visits every block that may hold more.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vectors = written(vectors, "topk-vectors")
    # Buckets are logarithms of lengths: their number has a bound whatever the input (about 15,000).
    counts = {r["bucket"]: r["count"] for r in vectors.groupBy("bucket").count().collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "components", "length").dropDuplicates(["vec_id", "components"])
    asked = asked.withColumn("query", F.xxhash64("vec_id", "components"))
    parts = max(1, -(-asked.count() // QUERIES))
    asked = written(asked.withColumn("part", F.pmod("query", F.lit(parts)).cast("int")), "topk-queries")
    places = [(b, -(-n // BLOCK)) for b, n in sorted(counts.items())]
    rows = spark.createDataFrame(places, "bucket int, blocks int")
    scattered = F.pmod(F.xxhash64("vec_id", "components"), F.col("blocks")).cast("int")
    dealt = vectors.join(F.broadcast(rows), "bucket").withColumn("block", scattered)

    def pass_over(blocks: DataFrame, places: list[tuple[int, int]], queries: DataFrame) -> DataFrame:
        """Every query block meets every block of ``places`` (bucket, blocks) that has vectors long enough for it."""
        left = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        to = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("n")) for b, n in places])).alias("to")
        right = queries.select("*", to).select("*", "to.bucket", F.explode(F.sequence(F.lit(0), F.col("to.n") - 1)).alias("block")).drop("to")
        reach = F.col("length") * F.pow(F.lit(GROWTH), F.col("bucket") + 1) * (1 + 1e-6)
        right = right.where(F.col("least").isNull() | (F.col("least") <= 0) | (reach >= F.col("least")))
        keys = ["bucket", "block", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            _grouped(k), "query_id long, query long, vec_id long, score long")

    # Seed: the fullest bucket's first block, for every query.
    full = max(counts, key=lambda b: (counts[b], b))
    first = pass_over(dealt.where((F.col("bucket") == full) & (F.col("block") == 0)), [(full, 1)],
                      asked.withColumn("least", F.lit(None).cast("double")))
    least = _best(first, k).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
    known = written(asked.join(least, "query", "left").select(asked["*"], F.col("s").cast("double").alias("least")), "topk-known")
    found = pass_over(dealt, places, known)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
