"""Order statistics by rank without sorting: repeated histograms.

Each pass counts the values of the open intervals in equal bins and keeps, per
wanted rank, the one bin that holds it, shrunk to the smallest and largest value
seen there. Bins are monotone in the value, so the search is exact; it ends when
a bin holds a single distinct value. Only bin counts leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..state import maybe_broadcast, written_counted

BINS = 512


@dataclass
class _Search:
    lo: float
    hi: float
    below: int = 0
    below_sum: float = 0.0


Intervals = list[tuple[str, float, float]]
# (key, lo, hi, bin, count, sum, smallest, largest)
Bins = Iterable[tuple[str, float, float, int, int, float, float, float]]


def bin_of(v, lo, hi):
    """Bin number of a value inside [lo, hi]; Spark columns."""
    return F.least(F.floor(F.try_divide(v - lo, hi - lo) * BINS), F.lit(BINS - 1)).cast("int")


def select_ranks(bounds: dict[str, tuple[int, float, float]], wanted: Iterable[tuple[str, int]],
                 histogram: Callable[[Intervals], Bins]) -> dict[tuple[str, int], tuple[float, float]]:
    """For each (key, rank), rank from 1: the value of that rank and the sum of the
    ``rank`` smallest values. ``bounds`` holds (count, min, max) per key."""
    open_ = {(k, r): _Search(bounds[k][1], bounds[k][2]) for k, r in set(wanted)
             if k in bounds and 1 <= r <= bounds[k][0]}
    done: dict[tuple[str, int], tuple[float, float]] = {}
    while open_:
        for key in [t for t, s in open_.items() if s.lo == s.hi]:
            s = open_.pop(key)
            done[key] = (s.lo, s.below_sum + (key[1] - s.below) * s.lo)
        if not open_:
            break
        intervals = sorted({(k, s.lo, s.hi) for (k, _), s in open_.items()})
        cells: dict[tuple[str, float, float], list] = {}
        for k, lo, hi, b, n, total, small, large in histogram(intervals):
            cells.setdefault((k, lo, hi), []).append((b, n, total, small, large))
        for (k, rank), s in open_.items():
            below, below_sum = s.below, s.below_sum
            for _, n, total, small, large in sorted(cells[(k, s.lo, s.hi)]):
                if below + n >= rank:
                    open_[(k, rank)] = _Search(small, large, below, below_sum)
                    break
                below, below_sum = below + n, below_sum + total
    return done


def frame_histogram(values: DataFrame) -> Callable[[Intervals], Bins]:
    """Histogram passes over a table (key, v)."""

    def run(intervals: Intervals) -> Bins:
        open_ = values.sparkSession.createDataFrame(intervals, "key string, lo double, hi double")
        # One row per open interval: at most the number of wanted ranks.
        hit = values.join(F.broadcast(open_), "key").where(F.col("v").between(F.col("lo"), F.col("hi")))
        rows = (hit.groupBy("key", "lo", "hi", bin_of(F.col("v"), F.col("lo"), F.col("hi")).alias("b"))
                .agg(F.count(F.lit(1)), F.sum("v"), F.min("v"), F.max("v")))
        return (tuple(r) for r in rows.collect())

    return run


def frame_bounds(values: DataFrame) -> dict[str, tuple[int, float, float]]:
    rows = values.groupBy("key").agg(F.count("v"), F.min("v"), F.max("v")).collect()
    return {r[0]: (r[1], r[2], r[3]) for r in rows if r[1] > 0}


def quantiles(values: DataFrame, probs: list[float]) -> dict[str, list[float]]:
    """Linear-interpolation quantiles per key of a table (key, v); NULLs are ignored."""
    values = values.where(F.col("v").isNotNull())
    bounds = frame_bounds(values)
    at = {(k, p): (n - 1) * p for k, (n, _, _) in bounds.items() for p in probs}
    wanted = [(k, f(h) + 1) for (k, _), h in at.items() for f in (math.floor, math.ceil)]
    found = select_ranks(bounds, wanted, frame_histogram(values))
    out: dict[str, list[float]] = {k: [] for k in bounds}
    for (k, p), h in at.items():
        a, b = found[(k, math.floor(h) + 1)][0], found[(k, math.ceil(h) + 1)][0]
        out[k].append(a + (h - math.floor(h)) * (b - a))
    return out


def frame_bins(values: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """Histogram passes over a written table (key, v) that stay tables."""

    def run(open_: DataFrame, rows: int) -> DataFrame:
        hit = values.join(maybe_broadcast(open_, rows), "key").where(F.col("v").between(F.col("lo"), F.col("hi")))
        return hit.groupBy("key", "lo", "hi", bin_of(F.col("v"), F.col("lo"), F.col("hi")).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("small"), F.max("v").alias("large"))

    return run


def rank_sums(bounds: DataFrame, wanted: DataFrame, bins: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(key, rank, value, total) for each distinct (key, rank) of ``wanted``: the value of that rank and the sum of the ``rank`` smallest.

    ``bounds(key, n, lo, hi)``; a rank below 1 or above n gives no row. ``bins`` takes the open intervals (key, lo, hi) and gives
    (key, lo, hi, b, n, s, small, large). Every pass is a table; the driver sees how many ranks are open.
    """
    start = wanted.distinct().join(bounds, "key").where(F.col("rank").between(F.lit(1), F.col("n"))).select(
        "key", "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.lit(0.0).alias("below_sum"))
    open_rows = {"open": F.count_if(F.col("lo") < F.col("hi"))}
    state, seen = written_counted(start, "ranks", **open_rows)
    while seen["open"]:
        going = state.where("lo < hi")
        # At most BINS rows of an interval stand in one window.
        upto = Window.partitionBy("key", "lo", "hi").orderBy("b")
        running = bins(going.select("key", "lo", "hi").distinct(), seen["open"]).select(
            "*", F.sum("n").over(upto).alias("upto"), F.sum("s").over(upto).alias("upto_sum"))
        hold = going.join(running, ["key", "lo", "hi"]).where(F.col("below") + F.col("upto") >= F.col("rank"))
        first = hold.groupBy("key", "rank").agg(F.min(F.struct(
            "b", "small", "large", (F.col("below") + F.col("upto") - F.col("n")).alias("below"),
            (F.col("below_sum") + F.col("upto_sum") - F.col("s")).alias("below_sum"))).alias("f"))
        after = first.select("key", "rank", F.col("f.small").alias("lo"), F.col("f.large").alias("hi"), "f.below", "f.below_sum")
        state, seen = written_counted(state.where("lo = hi").unionByName(after), "ranks", **open_rows)
    return state.select("key", "rank", F.col("lo").alias("value"), (F.col("below_sum") + (F.col("rank") - F.col("below")) * F.col("lo")).alias("total"))
