"""Exact pairwise results for many units without a pair table.

Units are hashed into blocks and each pair of blocks becomes one tile. A tile's
distance matrix is computed in a task. Sums, extremes and histograms come from
blocks crossed as :mod:`wardfield.operators.blocks` says: nothing is shuffled but
what a task has added up over all its tiles. Nearest neighbours of many trees are
found in blocks of clusters that lie together, crossed as far as their boxes allow
(:mod:`wardfield.operators.nearest`). State stays linear in the number of units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import to_xyz
from ..state import BLOCK_ROWS, Rounds, maybe_broadcast, ship_package, written, written_counted
from . import extremes, nearest, small_trees
from .blocks import FILE_BLOCKS, FILES, block_count, crossed, packed, squared, squared_strips, unpack
from .indices import c_index_values, dunn, mcclain_rao, silhouette_from_sums
from .ward import GROUP, Tree, all_merges, by_scenario


# Arrow types of the columns tiles return.
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _matrix(rows: pa.Table, column: str) -> np.ndarray:
    """An array column of equal lengths as a matrix; missing entries become NaN."""
    lists = rows[column].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class _Tile:
    """One tile's two sides, sorted by unit, and its distances."""

    def __init__(self, p: int, q: int, left: pa.Table, right: pa.Table):
        self.p, self.q, self.same = p, q, p == q
        self.left, self.right = left, left if self.same else right

    def empty(self) -> bool:
        return len(self.left) == 0 or len(self.right) == 0

    def features(self) -> np.ndarray:
        return np.sqrt(squared(_matrix(self.left, "x"), _matrix(self.right, "x")))

    def places(self) -> np.ndarray:
        """Great-circle angle between the units' points on the sphere."""
        chord = np.sqrt(squared(_matrix(self.left, "g"), _matrix(self.right, "g")))
        return 2 * np.arcsin(np.minimum(chord / 2, 1.0))

    def strips(self, alpha: float, scale: tuple[float, float]) -> Iterator[tuple[int, np.ndarray, float]]:
        """First row, distances and what multiplies their roots, of strips of rows: squared feature distances without places, else the blend and 0."""
        x, y = _matrix(self.left, "x"), _matrix(self.right, "x")
        if not alpha:
            for s, d2 in squared_strips(x, y):
                yield s, d2, 1 / scale[0]
            return
        g, h = _matrix(self.left, "g"), _matrix(self.right, "g")
        for (s, d2), (_, c2) in zip(squared_strips(x, y), squared_strips(g, h)):
            angle = 2 * np.arcsin(np.minimum(np.sqrt(c2) / 2, 1.0))
            yield s, (1 - alpha) / scale[0] * np.sqrt(d2) + alpha / scale[1] * angle, 0.0

    def once(self) -> np.ndarray:
        """Mask of the entries that stand for an unordered pair of units."""
        shape = (len(self.left), len(self.right))
        return np.triu(np.ones(shape, bool), 1) if self.same else np.ones(shape, bool)


def unit_point(lon: str = "lon", lat: str = "lat"):
    """A position as a 3-vector on the unit sphere."""
    p = to_xyz(F.col(lon), F.col(lat))
    return F.array(p["x"], p["y"], p["z"])


def _tables(schema: str) -> tuple[pa.Schema, Callable[[dict], pa.Table]]:
    """The Arrow schema, and what makes a table of a column dictionary; left-out columns are NULL."""
    fields = [(c.split()[0], _TYPES[c.split()[1]]) for c in schema.split(",")]
    arrow = pa.schema(fields)

    def table(columns: dict) -> pa.Table:
        rows = len(next(iter(columns.values())))
        return pa.table([pa.array(columns[n], t) if n in columns else pa.nulls(rows, t) for n, t in fields],
                        schema=arrow)

    return arrow, table


def _over(blocks: DataFrame, work: Callable[[Iterator[_Tile]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``work`` on the tiles of crossed blocks; it gets all tiles of a task and yields column dictionaries."""
    _, table = _tables(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[_Tile]:
            for b in batches:
                for i, (p, q) in enumerate(zip(b.column("blk_a").to_pylist(), b.column("blk_b").to_pylist())):
                    yield _Tile(p, q, unpack(b.column("rows_a"), i), unpack(b.column("rows_b"), i))

        for columns in work(tiles()):
            yield from table(columns).to_batches()

    return crossed(blocks).mapInArrow(run, schema)


def largest_distances(blocks: DataFrame, geo: bool) -> tuple[float, float]:
    """Largest feature distance and largest great-circle angle over all pairs of packed units."""

    def work(tiles: Iterator[_Tile]):
        m0, m1 = 0.0, 0.0
        for t in tiles:
            m0 = max(m0, float(np.nanmax(t.features(), initial=0.0)))
            m1 = max(m1, float(t.places().max()) if geo else 0.0)
        yield {"m0": [m0], "m1": [m1]}

    top = _over(blocks, work, "m0 double, m1 double").agg(F.max("m0"), F.max("m1")).first()
    return float(top[0] or 0.0), float(top[1] or 0.0)


def _blend(t: _Tile, alpha: float, scale: tuple[float, float]) -> np.ndarray:
    d = (1 - alpha) / scale[0] * t.features() if alpha < 1 else 0.0
    return d + alpha / scale[1] * t.places() if alpha > 0 else d


# Clusters in a block up to which sums by cluster are a product of matrices, and sums a task holds before it hands them on.
PRODUCT, HELD = 64, 8_000_000


def _by_label(d: np.ndarray, code: np.ndarray, size: int) -> np.ndarray:
    """Row sums of ``d`` over the columns of each label."""
    if size <= PRODUCT:
        return d @ np.eye(size)[code]
    order = np.argsort(code, kind="stable")
    return np.add.reduceat(d[:, order], np.searchsorted(code[order], np.arange(size)), axis=1)


class _Held:
    """Distance sums of units to clusters, added up over the tiles of a task; one matrix for each block and partition."""

    def __init__(self):
        self.sums: dict[tuple[int, int], list] = {}
        self.cells = 0

    def add(self, blk: int, combo: int, rows: pa.Table, own: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        old = self.sums.get((blk, combo))
        if old is not None and np.array_equal(old[2], ids):
            old[3] += s
            return
        if old is not None:
            both = np.union1d(old[2], ids)
            wide = np.zeros((len(own), len(both)))
            wide[:, np.searchsorted(both, old[2])] = old[3]
            wide[:, np.searchsorted(both, ids)] += s
            self.cells -= old[3].size
            ids, s = both, wide
        self.sums[blk, combo] = [rows["unit"].to_numpy(), own, ids, s]
        self.cells += s.size

    def give(self) -> Iterator[dict]:
        for (_, combo), (unit, own, ids, s) in self.sums.items():
            at, cl = np.divmod(np.arange(s.size), len(ids))
            yield {"combo": np.full(s.size, combo), "unit": unit[at], "own": own[at], "other": ids[cl], "s": s.ravel()}
        self.sums, self.cells = {}, 0


def tile_sums(blocks: DataFrame, combos: list[tuple[int, float]], scale: tuple[float, float], units: bool = True, ends: bool = True) -> DataFrame:
    """One pass for all partitions: :func:`packed` units(unit, x, [g], labels array<int>).

    ``combos`` holds (partition number, weight). Rows without a unit carry sums and pair counts within and between clusters and
    the smallest and largest distance, with ``ends`` also ``max_w`` and ``min_b``. With ``units``, rows with one carry its distance
    sum to each cluster. Both are what a task has added up, to be added up further.
    """

    def work(tiles: Iterator[_Tile]):
        total = {c: {"s_w": 0.0, "n_w": 0, "s_b": 0.0, "n_b": 0, "lo": None, "hi": None, "max_w": None, "min_b": None} for c, _ in combos}
        held = _Held()

        def least(old, d):
            return old if not len(d) else float(d.min()) if old is None else min(old, float(d.min()))

        def most(old, d):
            return old if not len(d) else float(d.max()) if old is None else max(old, float(d.max()))

        for t in tiles:
            lab_l, lab_r = _matrix(t.left, "labels"), _matrix(t.right, "labels")
            once, cache, seen = t.once(), {}, {}
            for c, alpha in combos:
                if alpha not in cache:
                    cache[alpha] = _blend(t, alpha, scale)
                    flat = cache[alpha][once] if t.same else cache[alpha].ravel()
                    seen[alpha] = least(None, flat), most(None, flat)
                d, sum_ = cache[alpha], total[c]
                for k, pick, v in (("lo", min, seen[alpha][0]), ("hi", max, seen[alpha][1])):
                    if v is not None:
                        sum_[k] = v if sum_[k] is None else pick(sum_[k], v)
                own, other = lab_l[:, c], lab_r[:, c]
                (ids_l, code_l), (ids_r, code_r) = (np.unique(v, return_inverse=True) for v in (own, other))
                far = _by_label(d, code_r, len(ids_r))
                pair = _by_label(far.T, code_l, len(ids_l)).T
                size_l, size_r = np.bincount(code_l), np.bincount(code_r)
                alike = ids_l[:, None] == ids_r[None]
                # Both orders of a pair stand in a block's tile with itself, and its diagonal is 0.
                half = 2 if t.same else 1
                counts = size_l[:, None] * size_r[None]
                if t.same:
                    counts = counts - np.diag(size_l)
                for k, mask in (("w", alike), ("b", ~alike)):
                    sum_[f"s_{k}"] += float(pair[mask].sum()) / half
                    sum_[f"n_{k}"] += int(counts[mask].sum()) // half
                if ends:
                    inside = own[:, None] == other[None, :]
                    sum_["max_w"], sum_["min_b"] = most(sum_["max_w"], d[once & inside]), least(sum_["min_b"], d[once & ~inside])
                if units:
                    held.add(t.p, c, t.left, own, ids_r, far)
                    if not t.same:
                        held.add(t.q, c, t.right, other, ids_l, _by_label(d.T, code_l, len(ids_l)))
            if held.cells > HELD:
                yield from held.give()
        yield from held.give()
        yield {"combo": list(total), **{k: [v[k] for v in total.values()] for k in next(iter(total.values()))}}

    return _over(blocks, work, "combo int, unit bigint, own int, other int, s double, s_w double, n_w bigint, max_w double, "
                               "s_b double, n_b bigint, min_b double, lo double, hi double")


# Bins of a histogram pass over pairs, as a power of two; of the first, which every pair goes to and which so has to stay in a cache; and octaves of
# that one: what is smaller shares its first bin. The second pass finds many values in every bin, so it has few: each task gives a row for a bin.
BIN_BITS, FIRST_BITS, SECOND_BITS, OCTAVE_BITS = 16, 13, 12, 3
# Values kept before they are counted, up to which the smallest and largest in a bin are looked for; beyond, a bin's own ends stand for them.
EXACT_ENDS = 1 << 18


def _bits(v: float) -> int:
    return int(np.float64(v + 0.0).view(np.int64))


class _Bins:
    """Counts, sums and ends of bins of values from ``lo`` to ``hi``.

    Numbers of 0 or more have the order of their bits as integers, so a bin is a range of those: its ends are exact.
    """

    def __init__(self, key: str, lo: float, hi: float, first: int | None = None, bits: int = BIN_BITS):
        self.key, self.lo, self.hi = key, lo, hi
        self.first, self.last = _bits(lo) if first is None else first, _bits(hi)
        self.shift = max(0, (self.last - self.first).bit_length() - bits)
        self.room = np.empty(0, np.int64)
        size = 1 << bits
        self.n, self.s, self.small, self.large = np.zeros(size, np.int64), np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)

    def add(self, v: np.ndarray, exact: bool) -> None:
        if not len(v):
            return
        if len(self.room) < len(v):
            self.room = np.empty(len(v), np.int64)
        b = np.subtract(v.view(np.int64), self.first, out=self.room[:len(v)])
        if _bits(self.lo) < self.first:
            np.maximum(b, 0, out=b)
        b >>= self.shift
        size = len(self.n)
        count = np.bincount(b, minlength=size)
        self.n += count
        self.s += np.bincount(b, weights=v, minlength=size)
        if exact:
            np.minimum.at(self.small, b, v)
            np.maximum.at(self.large, b, v)
        else:
            u = np.flatnonzero(count)
            self._ends(u)

    def _ends(self, u: np.ndarray) -> None:
        start = self.first + (u << self.shift)
        low = start.view(np.float64).copy()
        low[u == 0] = min(self.lo, float(np.int64(self.first).view(np.float64)))
        self.small[u] = np.minimum(self.small[u], low)
        self.large[u] = np.maximum(self.large[u], np.minimum(start + (1 << self.shift) - 1, self.last).view(np.float64))

    def columns(self) -> dict:
        u = np.flatnonzero(self.n)
        return {"key": [self.key] * len(u), "lo": np.full(len(u), self.lo), "hi": np.full(len(u), self.hi), "b": u, "n": self.n[u], "s": self.s[u],
                "small": self.small[u], "large": self.large[u]}


_BINS = "key string, lo double, hi double, b int, n bigint, s double, small double, large double"


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "lo", "hi", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("small").alias("small"), F.max("large").alias("large"))


class _Own:
    """Sums of a tile's distances inside clusters, for all partitions of one weight, from strips of its rows."""

    def __init__(self, t: _Tile, combos: list[int]):
        left, right = _matrix(t.left, "labels"), _matrix(t.right, "labels")
        self.half = 2 if t.same else 1  # both orders of a pair stand in a block's tile with itself, and its diagonal is 0
        self.parts, self.n, hot, width = [], {}, [], 0
        for c in combos:
            ids, code = np.unique(right[:, c], return_inverse=True)
            at = np.searchsorted(ids, left[:, c])
            known = ids[np.minimum(at, len(ids) - 1)] == left[:, c]
            size = np.bincount(code)
            self.n[c] = (int(size[at[known]].sum()) - (len(left) if t.same else 0)) // self.half
            product = len(ids) <= PRODUCT
            self.parts.append((c, at, known, width if product else None, code, len(ids)))
            if product:
                hot.append(np.eye(len(ids))[code])
                width += len(ids)
        self.hot = np.concatenate(hot, axis=1) if hot else None

    def add(self, start: int, d: np.ndarray, total: dict[int, dict]) -> None:
        far = d @ self.hot if self.hot is not None else None
        for c, at, known, offset, code, size in self.parts:
            rows = np.flatnonzero(known[start:start + len(d)])
            mine = at[start:start + len(d)][rows]
            sums = far[rows, offset + mine] if offset is not None else _by_label(d, code, size)[rows, mine]
            total[c]["s_w"] += float(sums.sum()) / self.half


def tile_totals(blocks: DataFrame, combos: list[tuple[int, float]], keys: dict[str, float], scale: tuple[float, float], top: dict[str, float]) -> DataFrame:
    """One pass over all distances: sums and pair counts within and between clusters as in :func:`tile_sums` (rows with a combo), and the
    first histogram of each weight of ``keys`` (rows with a key), whose distances are at most ``top``.
    """

    def work(tiles: Iterator[_Tile]):
        total = {c: {"s_w": 0.0, "n_w": 0, "s_b": 0.0, "n_b": 0} for c, _ in combos}
        bins = {k: _Bins(k, 0.0, top[k], max(0, _bits(top[k]) - (1 << (52 + OCTAVE_BITS)) + 1), FIRST_BITS) for k in keys}
        ends = {k: [np.inf, -np.inf] for k in keys}
        for t in tiles:
            if t.empty():
                continue
            for key, alpha in keys.items():
                mine = [c for c, a in combos if a == alpha]
                own, all_ = _Own(t, mine), 0.0
                pairs_ = len(t.left) * (len(t.left) - 1) // 2 if t.same else len(t.left) * len(t.right)
                for start, d, root in t.strips(alpha, scale):
                    if root:
                        np.sqrt(d, out=d)
                        if root != 1:
                            d *= root
                    own.add(start, d, total)
                    all_ += float(d.sum())
                    v = d[np.arange(len(d))[:, None] + start < np.arange(d.shape[1])] if t.same else d.ravel()
                    low, high = (float(v.min()), float(v.max())) if len(v) else (np.inf, -np.inf)
                    if np.isnan(low):
                        v = v[~np.isnan(v)]
                        low, high = (float(v.min()), float(v.max())) if len(v) else (np.inf, -np.inf)
                    ends[key] = [min(ends[key][0], low), max(ends[key][1], high)]
                    bins[key].add(v, False)
                for c in mine:
                    total[c]["n_w"] += own.n[c]
                    total[c]["n_b"] += pairs_ - own.n[c]
                    total[c]["s_b"] += all_ / own.half
        for c, sums in total.items():
            yield {"combo": [c], "s_w": [sums["s_w"]], "n_w": [sums["n_w"]], "s_b": [sums["s_b"] - sums["s_w"]], "n_b": [sums["n_b"]]}
        for k, (low, high) in ends.items():
            if low <= high:
                yield {"key": [k], "small": [low], "large": [high]}
            yield bins[k].columns()

    return _over(blocks, work, "combo int, s_w double, n_w bigint, s_b double, n_b bigint, " + _BINS)


def tile_histogram(blocks: DataFrame, alphas: dict[str, float], scale: tuple[float, float]):
    """Histogram passes over all pair distances, for the rank search; an interval shrinks by 2 ** BIN_BITS a pass or to the values seen.

    Squared distances tell what may lie in an interval, and only of that roots are taken.
    """

    def run(open_: DataFrame, _rows: int, bits: int = BIN_BITS) -> DataFrame:
        intervals = [tuple(r) for r in open_.collect()]  # at most two a partition

        def work(tiles: Iterator[_Tile]):
            bins = [_Bins(*one, bits=bits) for one in intervals]
            over, under = np.empty((2, 0), bool)
            kept: list[list[np.ndarray]] = [[] for _ in bins]
            held = [0] * len(bins)

            def count(at: int) -> None:
                if held[at]:
                    bins[at].add(np.concatenate(kept[at]), held[at] <= EXACT_ENDS)
                    kept[at], held[at] = [], 0

            for t in tiles:
                for key in {b.key for b in bins}:
                    for start, d, root in t.strips(alphas[key], scale) if not t.empty() else ():
                        d = d[np.arange(len(d))[:, None] + start < np.arange(d.shape[1])] if t.same else d.ravel()
                        if len(over) < len(d):
                            over, under = np.empty((2, len(d)), bool)
                        for at, one in enumerate(bins):
                            if one.key != key:
                                continue
                            low, high = ((one.lo / root) ** 2 * (1 - 1e-14), (one.hi / root) ** 2 * (1 + 1e-14)) if root else (one.lo, one.hi)
                            fits = np.greater_equal(d, low, out=over[:len(d)])
                            fits &= np.less_equal(d, high, out=under[:len(d)])
                            v = d[np.flatnonzero(fits)]
                            if root and len(v):
                                v = np.sqrt(v) * root
                                v = v[(v >= one.lo) & (v <= one.hi)]
                            if len(v):
                                kept[at].append(v + 0.0)
                                held[at] += len(v)
                                if held[at] > EXACT_ENDS:
                                    count(at)
            for at, one in enumerate(bins):
                count(at)
                yield one.columns()

        return _added(_over(blocks, work, _BINS))

    return run


def _c_index(blocks: DataFrame, alphas: dict[str, float], scale: tuple[float, float], variant: str) -> DataFrame:
    """(combo, value) of the C-index: one pass for the sums and the first histogram, and the passes of the rank search for what is left."""
    combos = list(enumerate(alphas.values()))
    weights = {str(a): a for a in alphas.values()}
    first = written(tile_totals(blocks, combos, weights, scale, _tops(blocks, weights, scale)), "tile-totals")
    key = F.element_at(F.array(*[F.lit(str(a)) for _, a in combos]), F.col("combo") + 1).alias("key")
    keyed = written(first.where(F.col("combo").isNotNull()).groupBy("combo").agg(*[F.sum(c).alias(c) for c in ("s_w", "n_w", "s_b", "n_b")]).select("*", key), "tile-overall")
    ends = first.where(F.col("b").isNull() & F.col("key").isNotNull()).groupBy("key").agg(F.min("small").alias("lo"), F.max("large").alias("hi"))
    bounds = written(keyed.groupBy("key").agg(F.max(F.col("n_w") + F.col("n_b")).alias("n")).join(F.broadcast(ends), "key"), "tile-bounds")  # a row a weight
    seen = _added(first.where(F.col("b").isNotNull())).drop("lo", "hi").join(F.broadcast(bounds.select("key", "lo", "hi")), "key")
    # No value lies outside of the smallest and the largest.
    seen = seen.withColumns({"small": F.greatest("small", "lo"), "large": F.least("large", "hi")})
    later, turn = tile_histogram(blocks, weights, scale), []

    def bins(open_: DataFrame, rows: int) -> DataFrame:
        turn.append(rows)
        return later(open_, rows, SECOND_BITS if len(turn) == 2 else BIN_BITS) if len(turn) > 1 else seen.select([c.split()[0] for c in _BINS.split(", ")])

    return c_index_values(keyed, bounds, bins, variant).select("combo", "value")


def _tops(blocks: DataFrame, weights: dict[str, float], scale: tuple[float, float]) -> dict[str, float]:
    """No distance is larger, for each weight: from the largest entry of every column, not from pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = _matrix(unpack(b.column("rows"), i), "x")
                with np.errstate(invalid="ignore"):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(np.fmin.reduce(x)), pa.array(np.fmax.reduce(x))], names=["at", "lo", "hi"])

    span = F.max("hi") - F.min("lo")
    ends = blocks.mapInArrow(run, "at bigint, lo double, hi double").where("NOT isnan(lo)").groupBy("at").agg(span.alias("v"))
    # Of columns that are missing in places a few, scaled up to all, may be the only shared ones.
    most, count = ends.agg(F.max("v"), F.count(F.lit(1))).first()
    wide = float(most or 0.0) * float(count or 1) ** 0.5 * (1 + 1e-6) / scale[0]
    return {k: max((1 - a) * wide + a * float(np.pi) * (1 + 1e-6) / scale[1], 1e-300) for k, a in weights.items()}


def vector_indices(units: DataFrame, partitions: dict[str, int], indices: list[str] | None = None,
                   block_rows: int = BLOCK_ROWS, variant: str = "sums") -> DataFrame:
    """(key, index, value) of Silhouette, Dunn, C-index and McClain-Rao for given partitions.

    ``units(unit, x[, g], <one int column per key>)``; ``partitions`` maps a partition's
    column to its weight step. With any weight above 0 both distances are first divided
    by their largest value.
    """
    wanted = indices or ["Sil", "Dunn", "Cindex", "McClain"]
    keys = list(partitions)
    geo = any(partitions.values())
    if wanted == ["Dunn"] and not units.where(F.exists("x", lambda v: v.isNull() | F.isnan(v))).take(1):
        return pruned_dunn(units, partitions).select("key", F.lit("Dunn").alias("index"), "value")
    payload = units.select("unit", "x", *(["g"] if geo else []),
                           F.array(*[F.col(k).cast("int") for k in keys]).alias("labels"))
    blocks = packed(payload, payload.count(), block_rows)
    scale = largest_distances(blocks, True) if geo else (1.0, 1.0)
    alphas = {k: step / 100.0 for k, step in partitions.items()}
    combos = [(i, alphas[k]) for i, k in enumerate(keys)]
    name = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("combo") + 1).alias("key")
    out = []
    if set(wanted) - {"Cindex"}:
        found = tile_sums(blocks, combos, scale, "Sil" in wanted, "Dunn" in wanted)
        # Added up by the task that made them and once more here, so what is written is a row for each unit and cluster at most.
        sums = written(found.groupBy("combo", "unit", "own", "other").agg(
            *[F.sum(c).alias(c) for c in ("s", "s_w", "n_w", "s_b", "n_b")], F.max("max_w").alias("max_w"), F.min("min_b").alias("min_b")), "tile-sums")
        overall = sums.where(F.col("unit").isNull()).drop("unit", "own", "other", "s")
    if "Sil" in wanted:
        sizes, seen = written_counted(payload.select(F.posexplode("labels").alias("combo", "other")).groupBy("combo", "other").agg(
            F.count(F.lit(1)).alias("size")), "tile-sizes")
        per = sums.where(F.col("unit").isNotNull()).select("combo", "unit", "own", "other", "s").join(
            maybe_broadcast(sizes, seen["rows"]), ["combo", "other"])
        # A unit is no neighbour of itself.
        per = per.withColumn("n", F.col("size") - (F.col("own") == F.col("other")).cast("int")).where("n > 0")
        out.append(("Sil", silhouette_from_sums(per, ["combo"])))
    if "Dunn" in wanted:
        out.append(("Dunn", dunn(overall)))
    if "McClain" in wanted:
        out.append(("McClain", mcclain_rao(overall)))
    if "Cindex" in wanted:
        out.append(("Cindex", _c_index(blocks, alphas, scale, variant)))
    parts = [df.select(name, F.lit(n).alias("index"), "value") for n, df in out]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def pruned_dunn(units: DataFrame, partitions: dict[str, int]) -> DataFrame:
    """(key, value, measured, possible): the Dunn index of given partitions without comparing all pairs.

    As :func:`vector_indices`, for features without gaps. ``measured`` of the ``possible`` pairs of cells were compared
    vector by vector; bounds ruled the others out.
    """
    split = units.select(F.max(F.size("x"))).first()[0] or 0
    found = []
    geo = any(partitions.values())
    v = F.concat("x", "g") if geo else F.col("x")
    tops = (extremes.largest_distance(units, "x", split)["all"], extremes.largest_distance(units, "g", 3, angle=True)["all"]) if geo else (1.0, 1.0)
    for step in sorted(set(partitions.values())):
        alpha = step / 100.0
        names = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("int").alias("label"))
                                    for k, s in partitions.items() if s == step])).alias("p")
        metric = extremes.Metric(split, (1 - alpha) / (tops[0] or 1.0), alpha / (tops[1] or 1.0) if alpha else 0.0)
        points = units.select(names, (v if alpha else F.col("x")).alias("v")).select("p.key", "p.label", "v")
        found.append(extremes.cluster_extremes(points, metric))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return dunn(rows).select("key", "value", "measured", "possible")


def vector_inertia(units: DataFrame, x: str = "x", by: list[str] | None = None) -> DataFrame:
    """Total inertia with weights 1/n from column variances: linear, no pairs."""
    by = by or []
    spread = units.select(*by, F.posexplode(x).alias("pos", "v")).groupBy(*by, "pos").agg(F.var_pop("v").alias("s"))
    return spread.groupBy(*by).agg(F.sum("s").alias("inertia"))


# Clusters drawn for a block of a tree, to halve the space by, and those drawn for all trees.
DRAWN, ALL_DRAWN = 32, 131_072


def _halves(v: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of every node of ``depth`` halvings of the space, so that each part holds about as many of the rows."""
    axis, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    rows = {0: np.arange(len(v))}
    for node in range(len(axis)):
        mine = rows.pop(node)
        if len(mine):
            part = v[mine]
            axis[node] = (part.max(0) - part.min(0)).argmax()
            along = part[:, axis[node]]
            cut[node] = np.partition(along, (len(along) - 1) // 2)[(len(along) - 1) // 2]
            over = along > cut[node]
            rows[2 * node + 1], rows[2 * node + 2] = mine[~over], mine[over]
        else:
            rows[2 * node + 1] = rows[2 * node + 2] = mine
    return axis, cut


def _part(v: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The part of the space that each row lies in."""
    node = np.zeros(len(v), np.int64)
    while len(axis) and len(node) and node[0] < len(axis):
        node = 2 * node + 1 + (v[np.arange(len(v)), axis[node]] > cut[node])
    return node - len(axis)


_NEAR_BLOCK = "scenario string, alpha_step int, blk bigint, lo array<double>, hi array<double>, least double, top double, n int, rows binary"


def near_blocks(clusters: DataFrame, per_tree: int, split: int, scales: dict[str, tuple[float, float]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Clusters that lie together as blocks of at most ``block_rows``, a row each with its box, least weight and the largest of its
    clusters' smallest Ward values inside the block; a written table. Only a few clusters are drawn to see where they lie.
    """
    ship_package(clusters.sparkSession)
    trees = clusters.select(*GROUP).distinct().count()
    depth = (min(block_count(per_tree, block_rows), max(1, ALL_DRAWN // (DRAWN * max(1, trees)))) - 1).bit_length()

    def vectors(rows: pa.Table, tree: tuple[str, int]) -> np.ndarray:
        return _matrix(rows, "z") / rows["w"].to_numpy()[:, None] * small_trees.stretched(scales[tree[0]], split, tree[1])

    def of(rows: pa.Table, tree: tuple[str, int]) -> pa.Table:
        return rows.filter(pc.and_(pc.equal(rows["scenario"], tree[0]), pc.equal(rows["alpha_step"], tree[1])))

    def found_in(rows: pa.Table) -> list[tuple[str, int]]:
        return [tuple(r.values()) for r in rows.select(GROUP).group_by(GROUP).aggregate([]).to_pylist()]

    drawn = clusters.sample(min(1.0, DRAWN * 2.0**depth / per_tree), 7).select(*GROUP, "w", "z").toArrow() if depth else None  # ALL_DRAWN rows
    cuts = {t: _halves(vectors(of(drawn, t), t), depth) for t in found_in(drawn)} if depth else {}
    none = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.Table.from_batches([b])
            for t in found_in(rows):
                mine = of(rows, t)
                yield from mine.append_column("part", pa.array(_part(vectors(mine, t), *cuts.get(t, none)))).to_batches()

    def blocks(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("unit").combine_chunks()
        tree, part = (rows["scenario"][0].as_py(), rows["alpha_step"][0].as_py()), rows["part"][0].as_py()
        ids, w, v = rows["unit"].to_numpy(), rows["w"].to_numpy(), vectors(rows, tree)
        order, out = nearest.halved(v), []
        for piece, start in enumerate(range(0, len(ids), block_rows)):
            at = order[start:start + block_rows]
            c = nearest.Cells.ordered(np.arange(len(at)), ids[at], w[at], v[at])
            best, nbr = c.unknown()
            nearest.search(c, c, best, nbr, np.arange(best.size).reshape(best.shape))
            best, nbr = best.ravel()[:len(at)], nbr.ravel()[:len(at)]
            # Numbers of a tree's blocks are odd and even alike, whatever the pieces.
            out.append((*tree, part * 65_537 + piece, v[at].min(0).tolist(), v[at].max(0).tolist(), float(w[at].min()), float(best.max()), len(at),
                        b"".join(x.tobytes() for x in (ids[at].astype(np.int64), nbr, w[at], best, v[at]))))
        names = [c.split()[0] for c in _NEAR_BLOCK.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int32(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    whole = clusters.select("scenario", "alpha_step", F.col("unit").cast("bigint").alias("unit"), "w", "z")
    dealt = whole.mapInArrow(parted, "scenario string, alpha_step int, unit bigint, w double, z array<double>, part bigint")
    files = max(FILES, -(-trees * (1 << depth) // FILE_BLOCKS))
    return written(dealt.repartition(files, *GROUP, "part").groupBy(*GROUP, "part").applyInArrow(blocks, _NEAR_BLOCK), "near-blocks")


class _Asked:
    """A block's clusters in cells, and the nearest neighbours known to a task."""

    def __init__(self, n: int, rows: bytes):
        ids, nbr = np.frombuffer(rows, np.int64, 2 * n).reshape(2, n)
        rest = np.frombuffer(rows, np.float64, offset=16 * n)
        self.cells = nearest.Cells.ordered(np.arange(n), ids, rest[:n], rest[2 * n:].reshape(n, -1))
        self.n, self.whole, self.first = n, False, (rest[n:2 * n], nbr)
        self.best, self.nbr = self.cells.unknown()
        self.best.ravel()[:n], self.nbr.ravel()[:n] = self.first

    def give(self, scenario: str, step: int) -> dict | None:
        """Neighbours that are better than those in the block itself, which are given once: with the block's pair with itself."""
        best, nbr = self.best.ravel()[:self.n], self.nbr.ravel()[:self.n]
        at = np.flatnonzero(np.isfinite(best) & (self.whole | (best != self.first[0]) | (nbr != self.first[1])))
        return {"scenario": [scenario] * len(at), "alpha_step": np.full(len(at), step), "node": self.cells.ids.ravel()[at], "nbr": nbr[at], "ward": best[at]}


_NEAREST = "scenario string, alpha_step int, node bigint, nbr bigint, ward double"


def nearest_clusters(clusters: DataFrame, per_tree: int, split: int, scales: dict[str, tuple[float, float]],
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact nearest neighbour of every cluster by Ward value, ties to the smallest id; one scale per scenario.

    A pair of blocks meets only if its boxes allow a value that beats what the clusters of either have in their own block.
    """
    blocks = near_blocks(clusters, per_tree, split, scales, block_rows)
    _, table = _tables(_NEAREST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Asked] = {}
        for b in batches:
            keys = [list(zip(*(b.column(f"{c}_{s}").to_pylist() for c in ("scenario", "alpha_step", "blk")))) for s in "ab"]
            for i, (p, q) in enumerate(zip(*keys)):
                for key, s in ((p, "a"), (q, "b")):
                    if key not in held:
                        held[key] = _Asked(b.column(f"n_{s}")[i].as_py(), b.column(f"rows_{s}")[i].as_py())
                left, right = held[p], held[q]
                if p == q:
                    left.whole = True
                    continue
                nearest.search(left.cells, right.cells, left.best, left.nbr)
                nearest.search(right.cells, left.cells, right.best, right.nbr)
        for (scenario, step, _), asked in held.items():
            yield from table(asked.give(scenario, step)).to_batches()

    def gap(p: str, q: str):
        return F.zip_with(p, q, lambda x, y: x - y)

    apart = F.zip_with(gap("lo_b", "hi_a"), gap("lo_a", "hi_b"), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    half = F.col("least_a") * F.col("least_b") / (F.col("least_a") + F.col("least_b"))
    least = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x) * half * (1 - 1e-9)
    one = (F.col("scenario_a") == F.col("scenario_b")) & (F.col("alpha_step_a") == F.col("alpha_step_b"))
    met = crossed(blocks, where=one & (least <= F.greatest("top_a", "top_b")))
    columns = [f"{c}_{s}" for c in ("scenario", "alpha_step", "blk", "n", "rows") for s in "ab"]
    return met.select(columns).mapInArrow(run, _NEAREST).groupBy(*GROUP, "node").agg(F.min(F.struct("ward", "nbr")).alias("best"))


def merged_vectors(clusters: DataFrame, best: DataFrame, split: int, scales: dict[str, tuple[float, float]],
                   step: int) -> DataFrame:
    """The reciprocal nearest neighbours as merges, with the weight and vector sum they form."""
    pair = best.select(*GROUP, F.least("node", "best.nbr").alias("left"),
                       F.greatest("node", "best.nbr").alias("right"), "best.ward")
    met = pair.groupBy(*GROUP, "left", "right").agg(
        F.count(F.lit(1)).alias("votes"), F.max("ward").alias("ward")).where("votes = 2").drop("votes")

    def end(name: str) -> DataFrame:
        return clusters.select("scenario", "alpha_step", F.col("unit").alias(name), F.col("w").alias(f"w_{name}"),
                               F.col("z").alias(f"z_{name}"), F.col("h").alias(f"h_{name}"))

    both = met.join(end("left"), [*GROUP, "left"]).join(end("right"), [*GROUP, "right"])
    gap = F.zip_with("z_left", "z_right", lambda a, b: F.pow(
        a / F.col("w_left") - b / F.col("w_right"), F.lit(2.0)))
    half = F.col("w_left") * F.col("w_right") / (F.col("w_left") + F.col("w_right"))

    def growth(part, place):
        square = by_scenario({s: float(v[place]) ** 2 for s, v in scales.items()})
        return F.aggregate(part, F.lit(0.0), lambda s, v: s + v) * half / square

    return both.select(
        *GROUP, F.lit(step).alias("round"), "left", "right",
        F.greatest("ward", "h_left", "h_right").alias("height"),
        growth(F.slice(gap, 1, split), 0).alias("dw0"),
        growth(F.slice(gap, split + 1, 3), 1).alias("dw1"),
        (F.col("w_left") + F.col("w_right")).alias("w"),
        F.zip_with("z_left", "z_right", lambda a, b: a + b).alias("z"))


def _copies(units: DataFrame, alpha_steps: list[int], n: int, split: int, scale: tuple[float, float]) -> DataFrame:
    """Units of the same vector in a tree merge at no height, the smallest with one after the other as tied neighbours do.

    One row per unit and weight: its merge with the ``left`` one (round 0: it is that one), and with the last, which has ``size`` rows
    before it, the cluster's vector sum ``z``.
    """
    width = split + 3
    steps = F.explode(F.array(*[F.lit(int(a)) for a in alpha_steps])).alias("alpha_step")
    # A part of the vector without weight may differ.
    same = F.when(F.col("alpha_step") == 0, F.col("x")).when(F.col("alpha_step") == 100, F.col("g")).otherwise(F.concat("x", "g"))
    rows = units.select(F.col("unit").cast("bigint").alias("unit"), "x", "g", steps)
    rows = rows.select("alpha_step", "unit", F.concat("x", "g").alias("v"), same.alias("same"))
    whole = Window.partitionBy("alpha_step", "same")
    upto = whole.orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = F.array(*[F.sum(F.col("v")[k]).over(upto) for k in range(width)])
    rows = rows.select("alpha_step", "unit", "v", F.row_number().over(whole.orderBy("unit")).alias("place"), F.count(F.lit(1)).over(whole).alias("size"),
                       F.first("unit").over(upto).alias("left"), sums.alias("z"))
    before = F.col("place") - 1
    gap = F.zip_with("z", "v", lambda s, v: F.pow((s - v) / before - v, F.lit(2.0)))

    def growth(start: int, count: int, scale_: float):
        spread = F.aggregate(F.slice(gap, start, count), F.lit(0.0), lambda s, v: s + v) * before / F.col("place") / float(n) / scale_ ** 2
        return F.when(before > 0, spread)

    return rows.select("alpha_step", before.cast("int").alias("round"), "left", F.col("unit").alias("right"), F.lit(0.0).alias("height"),
                       growth(1, split, scale[0]).alias("dw0"), growth(split + 1, 3, scale[1]).alias("dw1"),
                       F.when(F.col("place") == F.col("size"), F.transform("z", lambda v: v / F.lit(float(n)))).alias("z"),
                       (F.col("size") / F.lit(float(n))).alias("w"))


# Tasks for each tree that one task finishes, so that trees seldom share one.
SPREAD = 32


def ward_tree_vectors(units: DataFrame, alpha_steps: list[int], scale: tuple[float, float] | None = None,
                      scenario: str = "all", block_rows: int = BLOCK_ROWS) -> Tree:
    """Exact Ward trees (squared mix) for units(unit, x, g) with linear state.

    Feature distances are Euclidean and places are straight lines between points of
    the unit sphere, so a cluster is its weight and its vector sum, and the Ward value
    needs only those. Copies merge first. A round finds every cluster's exact nearest
    neighbour in blocks of what lies together and merges the reciprocal ones; trees with
    at most ``small_trees.LARGE`` clusters are left to the end, when one task finishes each.
    """
    spark = units.sparkSession
    units = written(units.select("unit", "x", "g"), "units")
    n = units.count()
    split = units.select(F.max(F.size("x"))).first()[0]
    if scale is None and n <= small_trees.LARGE:
        top0, top1 = largest_distances(packed(units, n, block_rows), True)
        scale = (top0 or 1.0, 2 * np.sin(top1 / 2) or 1.0)
    elif scale is None:
        scale = (extremes.largest_distance(units, "x", split)["all"] or 1.0, extremes.largest_distance(units, "g", 3)["all"] or 1.0)
    scales = {scenario: scale}
    rounds, done = Rounds(spark, "ward-vectors"), []
    left, step = {int(a): n for a in alpha_steps}, 1
    named = F.lit(scenario).alias("scenario")

    def merged(merges: DataFrame) -> None:
        done.append(merges.select([c.split()[0] for c in small_trees.MERGED.split(", ")]))
        for r in merges.groupBy("alpha_step").agg(F.count(F.lit(1)).alias("count")).collect():  # one row per weight
            left[r["alpha_step"]] -= r["count"]

    rounds.fit(8 * n * len(left))
    copies = rounds.keep(_copies(units, alpha_steps, n, split, scale).select(named, "*"), "copies")
    merged(copies.where("round > 0"))
    step += copies.agg(F.max("round")).first()[0] or 0
    clusters = copies.where(F.col("z").isNotNull()).select(*GROUP, F.col("left").alias("unit"), "w", "z", F.lit(0.0).alias("h"))
    kept = None
    while True:
        large = {a: count for a, count in left.items() if count > small_trees.LARGE}
        if not large:
            break
        rounds.fit(8 * sum(large.values()))
        near = nearest_clusters(clusters.where(F.col("alpha_step").isin(list(large))), max(large.values()), split, scales, block_rows)
        merges, count = rounds.keep_counted(merged_vectors(clusters, near, split, scales, step), f"merges-{step}")
        if not count:
            raise ValueError("no clusters to merge: a vector has missing entries")
        merged(merges)
        touched = merges.select(*GROUP, F.explode(F.array("left", "right")).alias("unit"))
        stay = clusters.join(maybe_broadcast(touched, 2 * count), [*GROUP, "unit"], "left_anti")
        fresh = merges.select(*GROUP, F.col("left").alias("unit"), "w", "z", F.col("height").alias("h"))
        clusters = rounds.keep(stay.select(fresh.columns).unionByName(fresh), f"clusters-{step}")
        if kept:
            rounds.drop(kept)
        kept, step = f"clusters-{step}", step + 1
    if max(left.values()) > 1:
        done.append(rounds.keep(small_trees.finish_vectors(clusters.repartition(SPREAD * len(left), *GROUP), split, scales, step), f"merges-{step}"))
    return Tree(units.select(F.lit(scenario).alias("scenario"), "unit"), all_merges(rounds, done, spark),
                list(alpha_steps), {scenario: n})
