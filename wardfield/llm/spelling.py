"""Spelling variants: words of a corpus that one edit turns into a more frequent word.

The vocabulary goes into blocked Bloom filters, one shard for each word length. Every word's one-edit neighbourhood is generated as
hashes: a polynomial over the code points lets an edit be hashed without spelling it out. Only edits that a filter may hold are spelled, and
an exact join with the vocabulary removes the false ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..state import discard, new_folder, written, written_counted
from .common import mixed, over_batches

#: Words are runs of these letters; only A-Z change to lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Shards by length: longer words share the last one.
SHARDS = 64
#: Bits of a filter for each word, and 64-bit blocks that one pass holds and broadcasts (16 MB).
BITS, PASS_BLOCKS = 16, 1 << 21
#: Code points of a batch of words hashed at once, and words a task probes.
CODES, TASK_WORDS = 200_000, 10_000
#: Distinct words a counting task holds before it gives them out.
HELD = 200_000
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)
_ALL = (1 << 64) - 1


def _count(batches):
    """Partial counts of words, after the deletion that the contract plants in some of them."""
    held: Counter = Counter()

    def give():
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            start = zlib.crc32(f"{i or ''}:".encode())
            for run, n in Counter(RUN.findall((t.as_py() or b"").lower().decode())).items():
                h = zlib.crc32(run.encode(), start)
                if h % 97 == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
                held[run] += n
            if len(held) > HELD:
                yield give()
                held.clear()
    if held:
        yield give()


def vocabulary(documents: DataFrame, id_: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3) -> DataFrame:
    """``(word, n)``: words of at least ``shortest`` code points that occur at least ``least`` times.

    Null and empty texts have no words; a null id counts as the empty text. Rows that repeat count again.
    """
    slim = documents.select(F.col(id_).cast("string").alias("id"), F.col(text).cast("binary").alias("text"))
    return over_batches(slim, _count, "word string, n long").where(F.length("word") >= shortest).groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least)


def _values(codes: np.ndarray) -> np.ndarray:
    """A scattered 64-bit value for each code point."""
    return mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def _powers(size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    np.cumprod(np.full(size - 1, _BASE, np.uint64), out=out[1:])
    return out


def _by_length(words: list[str]):
    """``(rows, codes)``: words of one length as a matrix of code points, a bounded number at a time."""
    groups: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for size, rows in groups.items():
        step = max(1, CODES // size)
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            yield np.array(part), np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32).reshape(-1, size)


class Filters:
    """Where words of each length lie in the blocks of all shards, one after the other."""

    def __init__(self, counts: dict[int, int]):
        """``counts`` of words by shard."""
        blocks = [-(-counts.get(s, 0) * BITS // 64) for s in range(SHARDS + 1)]
        self.size = np.array(blocks, np.uint64)
        self.start = np.r_[0, np.cumsum(blocks)][:-1].astype(np.uint64)
        self.total = int(sum(blocks))

    def place(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and bit mask of each hash of a word of ``length``; an empty shard has no block and gives a zero block size."""
        shard = min(length, SHARDS)
        z = mixed(hashes + np.uint64(length))
        block = self.start[shard] + ((z >> np.uint64(32)) * self.size[shard] >> np.uint64(32))
        mask = np.zeros(z.shape, np.uint64)
        for k in range(4):
            mask |= np.uint64(1) << (z >> np.uint64(6 * k) & np.uint64(63))
        return block, mask

    def holds(self, hashes: np.ndarray, length: int, low: int, bits: np.ndarray) -> np.ndarray:
        """Whether the blocks ``bits``, from block ``low`` on, may hold each hash."""
        if not self.size[min(length, SHARDS)]:
            return np.zeros(hashes.shape, bool)
        block, mask = self.place(hashes, length)
        inside = (block >= low) & (block < low + len(bits))
        at = np.where(inside, block - np.uint64(low), np.uint64(0)).astype(np.int64)
        return inside & (bits[at] & mask == mask)


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the polynomial of each word, and its hash."""
    terms = _values(codes) * _powers(codes.shape[1])
    return terms, terms.sum(axis=1, dtype=np.uint64)


def _fill(filters: Filters, low: int, high: int):
    def run(batches):
        for b in batches:
            blocks, masks = [], []
            for _, codes in _by_length(b.column(0).to_pylist()):
                block, mask = filters.place(_hashes(codes)[1], codes.shape[1])
                keep = (block >= low) & (block < high)
                blocks.append(block[keep])
                masks.append(mask[keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks or [np.zeros(0, np.uint64)]).view(np.int64)),
                                              pa.array(np.concatenate(masks or [np.zeros(0, np.uint64)]).view(np.int64))], names=["block", "mask"])
    return run


def neighbours(word: list[str], alphabet: np.ndarray, may_hold) -> tuple[list[int], list[str]]:
    """Rows of ``word`` and edits of them that ``may_hold`` lets through: each deletion, and each replacement by a later letter.

    Two words one insertion apart meet in the deletion of the longer one, and two one replacement apart in that of the
    earlier letter, so every pair of near words is generated once.
    """
    rows, edits = [], []

    def give(part, at, spell):
        for r, i in zip(*at):
            rows.append(int(part[r]))
            edits.append(spell(word[part[r]], int(i)))

    for part, codes in _by_length(word):
        size = codes.shape[1]
        terms, whole = _hashes(codes)
        powers = _powers(size)
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        gone = before + (whole[:, None] - before - terms) * np.uint64(_UNDO)
        fresh = np.c_[np.ones(len(codes), bool), codes[:, 1:] != codes[:, :-1]]  # in a run of one letter any deletion is the same
        if size > 1:
            give(part, np.nonzero(may_hold(gone, size - 1) & fresh), lambda w, i: w[:i] + w[i + 1:])
        rest = whole[:, None] - terms
        for c, value in zip(alphabet, _values(alphabet)):
            r, i = np.nonzero(codes < c)
            hit = np.flatnonzero(may_hold(rest[r, i] + value * powers[i], size))
            give(part, (r[hit], i[hit]), lambda w, i, c=chr(c): w[:i] + c + w[i + 1:])
    return rows, edits


def _probe(filters: Filters, low: int, bits, alphabet: np.ndarray):
    def run(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            rows, edits = neighbours(words, alphabet, lambda h, n: filters.holds(h, n, low, bits.value))
            n = b.column(1).to_numpy()
            for at in range(0, len(rows), 50_000):
                part = rows[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(edits[at:at + 50_000], pa.string()), pa.array([words[i] for i in part], pa.string()),
                                                  pa.array(n[part])], names=["edit", "word", "n"])
    return run


def near_words(vocab: DataFrame, alphabet: np.ndarray) -> DataFrame:
    """``(a, na, b, nb)``: pairs of words of ``vocab(word, n)`` that differ by one inserted, deleted or replaced code point, each once.

    A pass holds at most PASS_BLOCKS blocks of the filters, which the driver gathers and broadcasts; a larger
    vocabulary takes more passes. ``vocab`` must be a written table.
    """
    spark = vocab.sparkSession
    counts = vocab.groupBy(F.least(F.length("word"), F.lit(SHARDS)).alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()
    filters = Filters({r["s"]: r["c"] for r in counts})
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(r["c"] for r in counts) // TASK_WORDS))
    dealt = vocab.repartition(tasks, "word")
    found = []
    for low in range(0, filters.total, PASS_BLOCKS):
        high = min(low + PASS_BLOCKS, filters.total)
        blocks = over_batches(vocab.select("word"), _fill(filters, low, high), "block long, mask long").groupBy("block").agg(
            F.bit_or("mask").alias("mask")).toArrow()
        bits = np.zeros(high - low, np.uint64)
        bits[blocks.column("block").to_numpy() - low] = blocks.column("mask").to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast(bits)
        found.append(written(over_batches(dealt, _probe(filters, low, shared, alphabet), "edit string, word string, n long"), "spelling-edits"))
        shared.unpersist()
    if not found:
        return vocab.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("word").alias("b"), F.col("n").alias("nb")).where("false")
    edits = found[0]
    for more in found[1:]:
        edits = edits.unionByName(more)
    right = vocab.select(F.col("word").alias("edit"), F.col("n").alias("nb"))
    return edits.join(right, "edit").select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("edit").alias("b"), "nb")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms(word, to)``: pointers are followed in doubling steps. Counts rise along a chain, so it ends."""
    spark = forms.sparkSession
    path = new_folder(spark, "spelling-roots")
    now, seen = written_counted(forms, "spelling-roots", path)
    moved = seen["rows"]
    while moved:
        ahead = now.select(F.col("word").alias("to"), F.col("to").alias("further"))
        after = new_folder(spark, "spelling-roots")
        now, seen = written_counted(now.join(ahead, "to", "left").select("word", F.coalesce("further", "to").alias("to"), (
            F.col("further").isNotNull()).alias("moved")), "spelling-roots", after, moved=F.count_if("moved"))
        discard(spark, path)
        now, path, moved = now.drop("moved"), after, seen["moved"]
    return now.select("word", F.col("to").alias("root"))


def variants(documents: DataFrame, id_: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of :func:`vocabulary`.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them (ties: first in code-point order) if it
    occurs at least ``times`` as often as the word, ``form_n`` its count, ``root`` the end of the chain of forms. A word
    without a form has nulls there and is its own root. Without words the result is empty.
    """
    vocab = written(vocabulary(documents, id_, text, shortest, least), "spelling-words")
    # Letters of RUN only: 90 at most.
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint32)
    pairs = written(near_words(vocab, alphabet), "spelling-pairs")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("c")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("c")))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("c")).alias("c"), "near")).alias("best"))
    taken = -F.col("best.c") >= times * F.col("n")
    table = written(vocab.join(best, "word", "left").select(
        "word", F.when(taken, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, -F.col("best.c")).alias("form_n")), "spelling-forms")
    ends = _roots(table.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
