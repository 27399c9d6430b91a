"""Removal of passages that repeat across documents, exact to the word, with FM-indices over shards.

A window is ``WINDOW`` consecutive words. Every window has an anchor: of its short word runs the one whose hash is
smallest. Equal windows have equal anchors, so a shard that holds all passages around an anchor can judge them:

1. Each document lists its anchors, with a digest of the passage in which the anchor rules (one row per ~20 words).
2. Anchors of at least two documents stay; equal passages are counted once.
3. Passages are dealt to shards by anchor. A shard builds an FM-index of its passages, streams passages through it
   by backward search and reports for each window the smallest document in whose text it starts.
4. Every document drops the words of windows that start in a smaller document.

An anchor with very many different passages around it, such as the edge of a common licence text, is not put in one
shard: its windows are counted by digest, and those that repeat are dealt by digest as passages of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..state import discard, new_folder, written
from .common import held, mixed, new_name, over_batches, words_of
from .fmindex import Index

WINDOW = 50
#: Words in an anchor, and bits that hold a position beside the leading bits of its hash.
ANCHOR, PLACE_BITS = 8, 28
#: Different passages around one anchor up to which they share a shard.
CROWD = 1_000
#: Words in one index, a bound on a task's memory.
SHARD_WORDS = 250_000
#: Words remembered per worker, with their hashes.
WORDS_KEPT = 300_000


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    known = held("word-hashes", dict)
    if len(known) > WORDS_KEPT:
        known.clear()
    out = np.empty(len(words), np.uint64)
    try:
        out[:] = [known[w] for w in words]
    except KeyError:
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        out[:] = [known[w] for w in words]
    return out


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text of word hashes: hash of the anchor, first window it rules, number of windows."""
    n = len(h)
    if n < window:
        return (np.zeros(0, np.uint64),) * 3
    grams = np.zeros(n - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        grams = grams * np.uint64(0x100000001B3) + h[j:n - ANCHOR + 1 + j]
    grams = mixed(grams)
    if n >> PLACE_BITS:
        raise ValueError("a text has too many words")
    packed = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    span, done = window - ANCHOR + 1, 1
    low = packed
    while done * 2 <= span:  # minimum over 2, 4, 8, ... neighbours
        low = np.minimum(low[:len(low) - done], low[done:])
        done *= 2
    if done < span:
        low = np.minimum(low[:len(low) - (span - done)], low[span - done:])
    place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return grams[place[first]], first, np.diff(np.r_[first, len(place)])


def _digest(h: np.ndarray, lo: int, words: int) -> int:
    """Digest of a word range as a signed 64-bit integer."""
    return int.from_bytes(xxhash.xxh64_digest(h[lo:lo + words].tobytes()), "big", signed=True)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for id_, text in zip(part.column(0).to_pylist(), part.column(1)):
                    h = hashes(words_of(text.as_py()))
                    a, lo, n = anchors(h, window)
                    if len(a):
                        out[0].append(a)
                        out[1].append(np.array([_digest(h, x, y + window - 1) for x, y in zip(lo.tolist(), n.tolist())], np.int64))
                        out[2].append(np.full(len(a), id_))
                        out[3].append(lo)
                        out[4].append(n)
                if out[0]:
                    a, d, i, lo, n = (np.concatenate(x) for x in out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(d), pa.array(i.astype(np.int64)),
                         pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "digest", "id", "lo", "n"])
    return run


def _passage_rows(window: int):
    """Word hashes of the passages listed for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for id_, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                h = hashes(words_of(text.as_py()))
                for w in wanted:
                    lo, n = w["lo"], w["n"] + window - 1
                    # Another row with the same id may have another text: its passage is elsewhere.
                    if lo + n <= len(h) and _digest(h, lo, n) == w["digest"]:
                        for c, v in zip(cols, (w["anchor"], w["digest"], id_, w["crowded"], h[lo:lo + n].tobytes())):
                            c.append(v)
                if len(cols[0]) > 20_000:
                    yield _passages(cols)
                    cols = [[], [], [], [], []]
            if cols[0]:
                yield _passages(cols)
    return run


def _passages(cols):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["anchor", "digest", "id", "crowded", "words"])


def _window_rows(window: int):
    """A digest of every window of passages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                words = [np.frombuffer(w, np.uint64) for w in part.column("words").to_pylist()]
                counts = np.array([len(w) - window + 1 for w in words])
                row = pa.array(np.repeat(np.arange(len(words)), counts))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(row) for c in ("anchor", "digest", "id")),
                     pa.array(np.concatenate([np.arange(c) for c in counts]).astype(np.int32)),
                     pa.array([_digest(w, j, window) for w, c in zip(words, counts) for j in range(c)], pa.int64())],
                    names=["anchor", "digest", "id", "j", "whole"])
    return run


def _judge(window: int):
    """Shards of rows sorted by anchor: builds an index of whole anchor groups and streams their passages through it."""
    def shard(rows):
        passages = [np.frombuffer(w, np.uint64) for w in rows["words"]]
        index = Index(passages, np.array(rows["id"], np.int64), window)
        least = index.owners_of(passages)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["anchor"], pa.int64()), pa.array(rows["digest"], pa.int64()),
             pa.array([x.tolist() for x in least], pa.list_(pa.int64()))], names=["anchor", "digest", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in ("anchor", "digest", "id", "words")}
        size = 0
        for b in batches:
            for a, d, i, w in zip(*(b.column(c).to_pylist() for c in held)):
                if size >= SHARD_WORDS and a != held["anchor"][-1]:
                    yield shard(held)
                    held, size = {c: [] for c in held}, 0
                if held["anchor"] and (a, d) == (held["anchor"][-1], held["digest"][-1]):
                    held["id"][-1] = min(held["id"][-1], i)  # the same passage from a repeated row
                    continue
                for c, v in zip(held.values(), (a, d, i, w)):
                    c.append(v)
                size += len(w) // 8
        if held["anchor"]:
            yield shard(held)
    return run


def _judged(passages: DataFrame, window: int) -> DataFrame:
    dealt = passages.repartition("anchor").sortWithinPartitions("anchor", "digest")
    return over_batches(dealt, _judge(window), "anchor long, digest long, least array<long>")


def repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(id, spans)`` of documents that lose words, from ``documents(id long, text string)``.

    ``spans`` lists the ``[from, to)`` word ranges covered by windows whose words also start in a document with a smaller
    id. Null ids neither lose words nor make others lose any; rows with one id count as one document
    for "smaller", and each row's ranges apply to the rows of that id that have the passage. Texts with fewer words
    than a window have none. Overlapping ranges are not merged here. Windows are equal when the 64-bit hashes of all
    their words are.
    """
    named = documents.where("id is not null")
    folder = new_folder(documents.sparkSession, "substring")
    rows = written(over_batches(named.select("id", "text"), _anchor_rows(window),
                                "anchor long, digest long, id long, lo int, n int"), "substring-anchors", f"{folder}/anchors")
    passages = rows.groupBy("anchor", "digest").agg(
        F.min(F.struct("id", "lo", "n")).alias("first"), F.max("id").alias("last"))
    crowd = passages.groupBy("anchor").agg(F.count(F.lit(1)).alias("passages"), F.min("first").alias("least"),
                                           F.max("last").alias("most")).where("least.id < most")
    # Both sides read the same columns of the passages (the second condition always holds), so that one shuffle serves both.
    shared = passages.join(crowd.select("anchor", "most", (F.col("passages") > CROWD).alias("crowded")), "anchor").where("last <= most")
    lists = shared.groupBy("first.id").agg(F.collect_list(F.struct("anchor", "digest", "first.lo", "first.n", "crowded")).alias("wanted"))
    texts = named.join(lists, "id").select("id", "text", "wanted")
    words = written(over_batches(texts, _passage_rows(window), "anchor long, digest long, id long, crowded boolean, words binary"),
                    "substring-passages", f"{folder}/passages")
    judged = _judged(words.where("not crowded"), window).unionByName(_crowded(words.where("crowded"), window, folder))
    found = written(judged, "substring-least", f"{folder}/least")
    for spent in ("passages", "windows", "counted"):
        discard(documents.sparkSession, f"{folder}/{spent}")
    marked = rows.select("anchor", "digest", "id", "lo").join(found, ["anchor", "digest"])
    covered = over_batches(marked.select("id", "digest", "lo", "least"), _spans(window),
                           "id long, digest long, lo int, words int, spans array<struct<start:int,stop:int>>")
    return covered.groupBy("id").agg(F.collect_list(F.struct("digest", "lo", "words", "spans")).alias("spans"))


def _crowded(passages: DataFrame, window: int, folder: str) -> DataFrame:
    """The smallest owner of every window of passages around crowded anchors.

    Windows are summed by digest before they move; those of one passage only belong to it, the others are dealt
    to shards by their digest, each as a passage of its own.
    """
    singles = written(over_batches(passages, _window_rows(window), "anchor long, digest long, id long, j int, whole long"),
                      "substring-windows", f"{folder}/windows")
    counted = singles.groupBy("whole").agg(F.min(F.struct("id", "anchor", "digest", "j")).alias("first"),
                                           F.min(F.struct("anchor", "digest")).alias("one"), F.max(F.struct("anchor", "digest")).alias("other"))
    counted = written(counted.select("whole", "first.*", (F.col("one") == F.col("other")).alias("alone")), "substring-counted", f"{folder}/counted")
    again = counted.where("not alone").join(passages.drop("id"), ["anchor", "digest"]).select(
        F.col("whole").alias("anchor"), F.col("whole").alias("digest"), "id",
        F.substring("words", F.col("j") * 8 + 1, F.lit(8 * window)).alias("words"))
    known = counted.where("alone").select("whole", F.col("id").alias("owner")).unionByName(
        _judged(again, window).select(F.col("anchor").alias("whole"), F.col("least")[0].alias("owner")))
    return singles.join(known, "whole").groupBy("anchor", "digest").agg(
        F.array_sort(F.collect_set(F.struct("j", "owner"))).alias("w")).select(
        "anchor", "digest", F.col("w.owner").alias("least"))


def _spans(window: int):
    """Word ranges of windows owned by a smaller document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            lo = b.column("lo").to_numpy()
            lists = b.column("least")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
            sizes = np.diff(offsets)
            row = np.repeat(np.arange(len(ids)), sizes)
            inside = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
            hit = np.flatnonzero(flat < ids[row])
            if not len(hit):
                continue
            start = np.r_[True, (row[hit[1:]] != row[hit[:-1]]) | (inside[hit[1:]] != inside[hit[:-1]] + 1)]
            first = hit[start]
            last = hit[np.r_[start[1:], True]]
            rows, at = np.unique(row[first], return_index=True)
            spans = pa.StructArray.from_arrays(
                [pa.array((lo[row[first]] + inside[first]).astype(np.int32)),
                 pa.array((lo[row[last]] + inside[last] + window).astype(np.int32))], names=["start", "stop"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), b.column("digest").take(pa.array(rows)), pa.array(lo[rows]),
                 pa.array((sizes[rows] + window - 1).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.r_[at, len(first)].astype(np.int32)), spans)],
                names=["id", "digest", "lo", "words", "spans"])
    return run


def removed(words: list[bytes], found: list[dict] | None) -> np.ndarray:
    """Which of a document's words go."""
    gone = np.zeros(len(words), bool)
    if found:
        h = hashes(words)
        for f in found:
            if f["lo"] + f["words"] <= len(words) and _digest(h, f["lo"], f["words"]) == f["digest"]:
                for s in f["spans"]:
                    gone[s["start"]:s["stop"]] = True
    return gone


def _with_spans(documents: DataFrame, id_: str, text: str, window: int) -> tuple[DataFrame, str]:
    found = repeats(documents.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")), window)
    key, spans = new_name(documents, "repeat_of"), new_name(documents, "repeat_spans")
    found = found.withColumnsRenamed({"id": key, "spans": spans})
    joined = documents.join(found, documents[id_] == found[key], "left").drop(key)
    return joined, spans


def kept_digests(documents: DataFrame, id_: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` of every row; see :func:`repeats` for what goes."""
    joined, spans = _with_spans(documents.select(id_, text), id_, text, window)

    def run(batches):
        for b in batches:
            out = []
            for t, found in zip(b.column(text), b.column(spans).to_pylist()):
                words = words_of(t.as_py())
                gone = removed(words, found)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if found else words
                out.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, g, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(id_), pa.array(n, pa.int64()), pa.array(g, pa.int64()),
                                              pa.array(sha, pa.string())], names=[id_, "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType([joined.schema[id_], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return over_batches(joined, run, schema)


def without_repeats(documents: DataFrame, id_: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``documents`` whose texts lost their repeated passages; a document that loses every word goes.

    Texts that lose nothing stay as they are, nulls and empty ones too. Others keep their white space
    except what followed a removed word. Other columns pass through.
    """
    joined, spans = _with_spans(documents, id_, text, window)
    names = documents.columns
    at = names.index(text)

    def run(batches):
        import re

        space = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
        for b in batches:
            texts, stay = [], []
            for t, found in zip(b.column(text), b.column(spans).to_pylist()):
                if not found:
                    texts.append(t.as_py())
                    stay.append(True)
                    continue
                raw = t.as_py().encode()
                words = raw.split()
                gone = removed(words, found)
                if not gone.any():
                    texts.append(t.as_py())
                    stay.append(True)
                    continue
                parts = space.findall(raw)
                texts.append(b"".join(p for p, g in zip(parts, gone.tolist()) if not g).decode())
                stay.append(not gone.all())
            cols = [c for c, name in zip(b.columns, b.schema.names) if name != spans]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(stay, pa.bool_()))

    return over_batches(joined, run, documents.schema)
