"""Near-duplicate documents by SetSketch registers over word shingles.

A register holds the exponentially spaced, truncated minimum of an exponential variate over a set's shingles. Registers of a union
are the maxima of the registers, and two sets agree in a register with a probability that grows with their Jaccard similarity.
Bands of registers give candidates; how many registers of a pair are above, below and equal gives, with the exact set sizes, a joint
likelihood of the similarity; the likeliest pairs are decided on the full sets. What then still stands apart from others it shares a band
with is compared with all of them, set by set, in tiles of bounded size that write down links only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..state import maybe_broadcast, written, written_counted
from .common import BATCH_ROWS, mixed, over_batches, words_of
from .graph import components

#: Registers by band. At similarity 0.8 a register agrees with probability 0.80, so a pair shares none of the bands once in 400,000.
BANDS, WIDTH = 42, 6
REGISTERS = BANDS * WIDTH
#: Ratio of neighbouring register values, rate of the variates, largest value.
BASE, RATE, TOP = 1.02, 20.0, 0xFFFE
#: A pair is ruled out when twice the log-likelihood it lacks at the least similarity exceeds this (six standard deviations).
DOUBT = 36.0
#: Similarities the likelihood is evaluated at.
GRID = 64
#: Shingles of the open sets of one task, and of the sets they are compared with: what a tile holds at most, but for one long text.
OPEN, OTHERS = 200_000, 1_000_000
#: Shingles hashed at once.
CHUNK = 4_096
_rng = np.random.default_rng(11)
_FACTOR = _rng.integers(0, 1 << 31, REGISTERS).astype(np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_OFFSET = _rng.integers(0, 1 << 32, REGISTERS).astype(np.uint32)[:, None]


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width`` are one shingle, none give none."""
    words = words_of(None if text is None else text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    each = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + each[i:len(out) + i])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty."""
    half = REGISTERS // 2
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at:at + CHUNK]
        low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
        np.minimum(least[:half], (_FACTOR[:half] * low + _OFFSET[:half]).min(axis=1), out=least[:half])
        np.minimum(least[half:], (_FACTOR[half:] * high + _OFFSET[half:]).min(axis=1), out=least[half:])
    variate = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def likelihood(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs with so many registers above and below: the most likely similarity, and whether ``least`` or more is possible."""
    above, below, a, b = (np.asarray(x, np.float64)[:, None] for x in (above, below, size_a, size_b))
    most = np.minimum(a, b) / np.maximum(a, b)
    step = (BASE - 1) / BASE

    def log_p(j):
        up = -np.log1p(-np.maximum((a - b * j) / (a + b), 1e-12) * step) / np.log(BASE)
        down = -np.log1p(-np.maximum((b - a * j) / (a + b), 1e-12) * step) / np.log(BASE)
        same = np.maximum(1 - up - down, 1e-12)
        return above * np.log(up) + below * np.log(down) + (REGISTERS - above - below) * np.log(same)

    grid = most * np.linspace(0, 1, GRID)
    values = log_p(grid)
    at = values.argmax(axis=1)
    best = grid[np.arange(len(at)), at]
    lack = 2 * (values.max(axis=1, initial=-np.inf) - log_p(np.minimum(most, least))[:, 0])
    return best, (most[:, 0] >= least - 1e-9) & ((best >= least) | (lack <= DOUBT))


def _sketched(width: int, id_type: str):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                node, n, sketch = [], [], []
                for t in part.column(2):
                    h = shingles(t.as_py(), width)
                    n.append(len(h))
                    node.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None)
                    sketch.append(registers(h).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()),
                                                  pa.array(sketch, pa.binary())], names=["id", "h", "node", "n", "sketch"])
    return run, f"id {id_type}, h long, node long, n long, sketch binary"


def _sets(width: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in part.column(1)], pa.binary())],
                                                 names=["node", "set"])
    return run


def _possible(least: float):
    """Pairs with both sketches to those that the likelihood doesn't rule out, with their most likely similarity."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4_096):
                p = b.slice(at, 4_096)
                sk = [np.frombuffer(b"".join(p.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb")]
                best, keep = likelihood((sk[0] > sk[1]).sum(axis=1), (sk[0] < sk[1]).sum(axis=1), p.column("na").to_numpy(), p.column("nb").to_numpy(), least)
                yield pa.RecordBatch.from_arrays([p.column("a").filter(pa.array(keep)), p.column("b").filter(pa.array(keep)), pa.array(best[keep])],
                                                 names=["a", "b", "j"])
    return run


def _confirmed(percent: int):
    """Pairs with both sets to those whose similarity is ``percent`` or more."""
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([one, two])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep, pa.bool_())), b.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])
    return run


def _tile_links(percent: int):
    """A spanning forest of the links between the open sets of a tile and all its other sets."""
    def run(rows: pa.Table) -> pa.Table:
        side = rows["open"].to_numpy()
        node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
        others, open_ = np.flatnonzero(~side), np.flatnonzero(side)
        found: list[tuple[int, int]] = []
        if len(others) and len(open_):
            sizes = np.array([len(sets[i]) for i in others])
            every = np.concatenate([sets[i] for i in others])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], np.repeat(np.arange(len(others)), sizes)[order]
            group: dict[int, int] = {}

            def top(x: int) -> int:
                while group.get(x, x) != x:
                    x = group[x]
                return x

            for i in open_.tolist():
                mine = sets[i]
                low, high = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
                width = high - low
                at = np.arange(width.sum()) + np.repeat(low - np.cumsum(width) + width, width)
                shared = np.bincount(owner[at], minlength=len(others))
                for j in others[100 * shared >= percent * (len(mine) + sizes - shared)].tolist():
                    a, b = top(int(root[i])), top(int(root[j]))
                    if a != b:
                        group[max(a, b)] = min(a, b)
                        found.append((int(node[i]), int(node[j])))
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


class _Search:
    """Links between the distinct sets of a table of documents."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.docs, self.nodes, self.width, self.percent = docs, nodes, width, percent

    def possible(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """Of ``pairs(a, b)`` those that sizes and likelihood allow, with ``j``."""
        side = self.nodes.select("node", "n", "sketch")
        first = side.toDF("a", "na", "sa")
        both = pairs.join(first, "a").join(side.toDF("b", "nb", "sb"), "b").where(
            F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)
        return written_counted(over_batches(both, _possible(self.percent / 100), "a long, b long, j double"), "sketch-possible")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``(node, set)`` of distinct ``wanted(node)``, made anew from the texts of their documents."""
        place, seen = written_counted(self.nodes.select("node", "rep.id", "rep.h").join(wanted, "node", "left_semi").select(
            F.col("node"), F.col("id").alias("id_"), F.col("h").alias("h_")), "sketch-wanted")
        rows = maybe_broadcast(place, seen["rows"])
        texts = self.docs.join(rows, self.docs["id"].eqNullSafe(rows["id_"]) & (self.docs["h"] == rows["h_"]))
        return written(over_batches(texts.select("node", "text"), _sets(self.width), "node long, set binary").dropDuplicates(["node"]), "sketch-sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs(a, b)``, a written table, those whose full sets are similar enough."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        # The end with more pairs, a centre, is joined last: its set isn't moved again.
        both = pairs.select("a", "b").join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
        return written(over_batches(both.select("a", "b", "x", "y"), _confirmed(self.percent), "a long, b long"), "sketch-links")

    def crowd_links(self, crowds: DataFrame) -> DataFrame:
        """Links that connect components inside ``crowds(crowd, node, root)``: every open set, whose root isn't the crowd's, with all sets of the crowd.

        A crowd is dealt into tiles of bounded size, each open block with each block of the crowd; a tile gives a spanning forest of the links it finds.
        """
        open_ = F.col("root") != F.col("crowd")
        sized = crowds.join(self.nodes.select("node", "n"), "node")
        blocks = sized.groupBy("crowd").agg(
            F.ceil(F.sum(F.when(open_, F.col("n")).otherwise(0)) / OPEN).cast("long").alias("xs"), F.ceil(F.sum("n") / OTHERS).cast("long").alias("ys"))
        dealt = crowds.join(blocks, "crowd").withColumns({"x": F.pmod(F.xxhash64("node"), F.col("xs")), "y": F.pmod(F.xxhash64("node", F.lit(1)), F.col("ys"))})
        left = dealt.where(open_).select("crowd", "node", "root", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)).alias("y"), F.lit(True).alias("open"))
        right = dealt.select("crowd", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("xs") - 1)).alias("x"), "y", F.lit(False).alias("open"))
        rows = left.unionByName(right).join(self.sets(crowds.select("node").distinct()), "node")
        return written(rows.groupBy("crowd", "x", "y").applyInArrow(_tile_links(self.percent), "a long, b long"), "sketch-links")

    def run(self) -> DataFrame:
        """``(node, root)`` of the sets that share a band key with another: linked ones have the same root.

        Each band key has a centre, its smallest member, and every set is first decided against the likeliest of its centres. In keys that then hold
        several components, what lies outside the largest one is compared with all that share such a key with that component.
        So the pairs looked at are linear in a key's members but for those that link to none of their centres, and none that shares a key is missed.
        """
        start = 2 * WIDTH
        key = [F.xxhash64(F.lit(k), F.substring("sketch", k * start + 1, start)) for k in range(BANDS)]
        bands = self.nodes.select("node", F.explode(F.array(*key)).alias("key"))
        centres = bands.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
        crowds = written(bands.join(centres.where("centre < last"), "key").select("key", "node", "centre"), "sketch-crowds")
        stars, seen = self.possible(crowds.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
        # Only sets that share a key with another can link; all others are their own roots.
        roots, known = written_counted(crowds.select("node").distinct().withColumn("root", F.col("node")), "sketch-roots")
        few = known["rows"]
        if seen["rows"]:
            likeliest = stars.groupBy("b").agg(F.max_by("a", F.struct("j", "a")).alias("a")).select("a", "b")
            roots = _rooted(roots, few, self.links(written(likeliest, "sketch-stars")))
        named = written(crowds.select("key", "node").join(maybe_broadcast(roots, few), "node"), "sketch-named")
        largest = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
            F.max_by("root", F.struct("c", "root")).alias("crowd"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        apart, seen = written_counted(named.join(largest, "key").select("crowd", "node", "root").distinct(), "sketch-apart")
        return _joined(roots, few, self.crowd_links(apart)) if seen["rows"] else roots


def _rooted(roots: DataFrame, rows: int, links: DataFrame) -> DataFrame:
    """``roots(node, root)`` from links that give each ``b`` one smaller ``a``: pointers are followed in doubling steps."""
    now = roots.join(links.select(F.col("b").alias("node"), F.col("a").alias("to")), "node", "left").select("node", F.coalesce("to", "root").alias("root"))
    now, seen = written_counted(now, "sketch-roots", moved=F.count_if(F.col("node") != F.col("root")))
    while seen["moved"]:
        ahead = maybe_broadcast(now.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("to")), rows)
        now, seen = written_counted(now.join(ahead, "root", "left").select("node", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")),
                                    "sketch-roots", moved=F.count_if("moved"))
        now = now.drop("moved")
    return now


def _joined(roots: DataFrame, rows: int, links: DataFrame) -> DataFrame:
    """``roots(node, root)`` after new links: only the components that they connect are looked at again."""
    for end in ("a", "b"):
        links = links.join(maybe_broadcast(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), rows), end)
    moved = components(links.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return written(roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select(
        "node", F.coalesce("to", "root").alias("root")), "sketch-roots")


def near_duplicates(documents: DataFrame, id_: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``documents``.

    A document's set holds the distinct word shingles of its whole text with A-Z in lower case; fewer words than ``width`` are one
    shingle. Documents link when ``100 * intersection >= percent * union``, and ``component_id`` is the smallest id
    reachable. Null and empty texts and those of white space have an empty set and link with nothing. Repeated rows and equal texts share
    a set, so they link. A null id is never the smallest: a component of null ids alone has a null ``component_id``; ``kept`` is false for
    a null id. Other columns play no part. An empty table stays empty. Sets and shingles are told apart by 64-bit hashes.
    """
    docs = documents.select(F.col(id_).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).cast("binary").alias("text"))
    run, schema = _sketched(width, dict(docs.dtypes)["id"])
    rows = written(over_batches(docs, run, schema), "sketch-rows")
    nodes = written(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("id", "h")).alias("rep"), F.min("id").alias("least")), "sketch-nodes")
    roots = _Search(docs, nodes, width, percent).run()
    placed = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("smallest"))
    classes = written(placed.join(smallest, "root").select("node", "smallest"), "sketch-classes")
    lone = F.col("node").isNull()
    found = rows.select("id", "node", "n").join(classes, "node", "left").withColumn("component_id", F.when(lone, F.col("id")).otherwise(F.col("smallest")))
    return found.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
