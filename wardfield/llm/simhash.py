"""SimHash near-duplicates through an inverted index over byte positions of the fingerprints.

Two 64-bit fingerprints that differ in at most three bits share at least five of their eight bytes, each in
its place. A posting holds the fingerprints that share the bytes at one choice of five places; a pair is
tallied inside a posting it shares, kept if it has the guaranteed minimum of shared positional bytes, and
verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..state import written
from .common import new_name, over_batches, with_columns, words_of
from .graph import components

BITS, BYTES = 3, 8
#: Bytes that a pair within BITS differing bits shares at least.
SHARED = BYTES - BITS
CHOICES = list(combinations(range(BYTES), SHARED))
MASKS = np.array([sum(0xFF << (8 * p) for p in c) for c in CHOICES], np.uint64)
#: First choice of places, by the set (one bit a place) of places in which a pair agrees.
FIRST = np.array([next((i for i, c in enumerate(CHOICES) if all(s >> p & 1 for p in c)), -1) for s in range(256)])
#: Postings up to this length give all their links; longer ones a spanning forest of them.
SHORT = 64
#: From this many open fingerprints on, neighbours are looked up by flipping bits instead of compared.
LOOKUP = 4_096
#: Sorted rows handled at once.
ROWS = 400_000


def fingerprint(words: list[bytes], width: int) -> int:
    """SimHash of word shingles, repeats included; fewer words than ``width`` are one shingle, none give zero."""
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(*[words[i:] for i in range(width)])]
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at:at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str, into: str, width: int) -> DataFrame:
    """``df`` with the fingerprint of the whole lower-cased text as a signed 64-bit integer."""
    def make(b: pa.RecordBatch):
        got = [fingerprint(words_of(t.as_py()), width) if not t.is_valid else
               fingerprint(t.as_py().encode().lower().split(), width) for t in b.column(text)]
        return [pa.array(np.array(got, np.uint64).view(np.int64))]
    return with_columns(df, [T.StructField(into, T.LongType())], make)


def _runs(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def _short(choice: np.ndarray, fp: np.ndarray, part: np.ndarray, longest: int) -> list[np.ndarray]:
    """All links inside the runs ``part`` of one posting each; a pair that shares several postings counts in the first."""
    found = []
    for lag in range(1, longest):
        at = np.flatnonzero(part[lag:] == part[:-lag])
        if not len(at):
            break
        a, b = fp[at], fp[at + lag]
        differ = a ^ b
        agree = np.packbits((differ.view(np.uint8).reshape(-1, BYTES) == 0), axis=1, bitorder="little")[:, 0]
        tally = np.bitwise_count(agree)
        keep = (tally >= SHARED) & (FIRST[agree] == choice[at])
        keep &= np.bitwise_count(differ) <= BITS
        if keep.any():
            found.append(np.stack([a[keep], b[keep]], axis=1))
    return found


def _flips(mask: np.uint64) -> np.ndarray:
    """All ways to flip one to BITS bits outside ``mask``."""
    free = [np.uint64(1) << np.uint64(i) for i in range(64) if not int(mask) >> i & 1]
    return np.array([np.bitwise_or.reduce(np.array(c, np.uint64)) for n in range(1, BITS + 1)
                     for c in combinations(free, n)], np.uint64)


def _forest(fp: np.ndarray, mask: np.uint64) -> np.ndarray:
    """A spanning forest of the links among distinct fingerprints of one posting.

    A breadth-first walk: each fingerprint is met once, by comparison with those still open or, while many
    are open, by looking up its neighbours, so work per fingerprint has a fixed bound.
    """
    fp = np.sort(fp)
    open_, tree, flips = np.ones(len(fp), bool), [], None
    rest = np.arange(len(fp))
    for start in range(len(fp)):
        if not open_[start]:
            continue
        open_[start] = False
        front = [start]
        while front:
            i = front.pop()
            if len(rest) > LOOKUP:
                flips = _flips(mask) if flips is None else flips
                want = fp[i] ^ flips
                at = np.minimum(np.searchsorted(fp, want), len(fp) - 1)
                near = at[(fp[at] == want) & open_[at]]
            else:
                rest = rest[open_[rest]]
                near = rest[np.bitwise_count(fp[rest] ^ fp[i]) <= BITS]
            if len(near):
                open_[near] = False
                tree.append(np.stack([np.full(len(near), fp[i]), fp[near]], axis=1))
                front += near.tolist()
        if len(rest) > LOOKUP and start % LOOKUP == 0:
            rest = rest[open_[rest]]
    return np.concatenate(tree) if tree else np.zeros((0, 2), np.uint64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted postings; a posting cut by the end of a batch waits for the next one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def give(choice, fp):
        key = fp & MASKS[choice]
        new = np.r_[True, (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])]
        part = np.cumsum(new)
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(fp)])
        out = []
        if (long := np.flatnonzero(size > SHORT)).size:
            for k in long:
                s = slice(start[k], start[k] + size[k])
                out.append(_forest(fp[s], MASKS[choice[s][0]]))
        keep = np.repeat((size <= SHORT) & (size > 1), size)
        if keep.any():
            out += _short(choice[keep], fp[keep], part[keep], int(size[size <= SHORT].max()))
        return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)

    def batch(pairs):
        pairs = np.sort(pairs.view(np.int64), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append((b.column("choice").to_numpy(zero_copy_only=False).astype(np.int64),
                     b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        rows += b.num_rows
        if rows < ROWS:
            continue
        choice, fp = (np.concatenate(x) for x in zip(*held))
        last = (choice == choice[-1]) & ((fp & MASKS[choice]) == (fp[-1] & MASKS[choice[-1]]))
        cut = len(fp) - int(last[::-1].argmin()) if not last.all() else 0
        held, rows = [(choice[cut:], fp[cut:])], 0
        if cut:
            yield batch(give(choice[:cut], fp[:cut]))
    if held:
        yield batch(give(*(np.concatenate(x) for x in zip(*held))))


def links(fingerprints: DataFrame) -> DataFrame:
    """``(a, b)`` pairs of distinct fingerprints whose graph has the components of "at most BITS bits differ".

    ``fingerprints(fp)`` must be distinct. Every link is found in a posting it shares. Postings of at most
    SHORT entries give all their links, each once; a longer posting, as a large group of near copies makes,
    gives a spanning forest of its links, so output stays linear and no link between different fingerprints
    is lost to the components. A posting has at most 2^24 different entries.
    """
    masks = F.array(*[F.lit(int(m)) for m in MASKS.view(np.int64)])
    postings = fingerprints.select(F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("choice", "shared"), "fp")
    dealt = postings.repartition("choice", "shared").sortWithinPartitions("choice", "shared").select("choice", "fp")
    return over_batches(dealt, _links, "a long, b long")


def near_duplicates(documents: DataFrame, id_: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``documents`` with ``fingerprint`` (long) and ``component_id`` for every row.

    Documents link when their fingerprints differ in at most three bits; ``component_id`` is the smallest id
    reachable. Null and empty texts have fingerprint zero and link like any other. Repeated rows stay and
    share a component. A null id is never the smallest; a component of null ids alone has a null
    ``component_id``. Columns that are called like the two new ones are replaced. An empty table stays empty.
    """
    plain = documents.drop("fingerprint", "component_id")
    marked = written(with_fingerprint(plain, text, "fingerprint", width), "simhash-docs")
    return with_components(marked, id_)


def with_components(marked: DataFrame, id_: str, find: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """Adds ``component_id`` to rows that carry ``fingerprint``; ``find`` gives the links of the distinct ones."""
    firsts = written(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_).alias("least")), "simhash-fp")
    roots = components(written(find(firsts.select("fp")), "simhash-links"))
    joined = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("smallest"))
    classes = written(joined.join(smallest, "root").select(
        F.col("fp").alias("fingerprint"), F.col("smallest").alias("component_id")), "simhash-classes")
    return marked.join(classes, "fingerprint").select(*marked.columns, "component_id")


def keep_one(documents: DataFrame, id_: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One document of each component, with the columns of ``documents``: the one with the smallest id.

    Rows that repeat an id are one document; of these, the row that comes first by its text stays. Of a
    component without any id, the row whose text comes first stays. Null texts count as the empty text.
    """
    slim = with_fingerprint(documents.select(id_, text), text, new := new_name(documents, "fingerprint"), width)
    slim = written(slim.select(F.col(id_).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
                               F.col(new).alias("fingerprint")), "simhash-slim")
    return first_of_each(documents, with_components(slim, "id"), id_, text)


def first_of_each(documents: DataFrame, classes: DataFrame, id_: str, text: str) -> DataFrame:
    """The rows of ``documents`` that :func:`keep_one` keeps, by ``classes(id, h, fingerprint, component_id)``."""
    root = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("no id "), F.col("fingerprint")))
    first = (classes.where(F.col("id").eqNullSafe(F.col("component_id"))).withColumn("root", root)
             .groupBy("root").agg(F.min(F.struct("id", "h")).alias("f")))
    stay = first.select("f.id", "f.h")
    key = documents.withColumns({(a := new_name(documents, "keep_id")): F.col(id_),
                                 (b := new_name(documents, "keep_hash")): F.xxhash64(F.coalesce(text, F.lit("")))})
    kept = key.join(stay, key[a].eqNullSafe(stay["id"]) & (key[b] == stay["h"]), "left_semi")
    return kept.dropDuplicates([a, b]).select(*[key[c] for c in documents.columns])
