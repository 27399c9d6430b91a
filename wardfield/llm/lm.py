"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts a token from the two tokens before it, in two steps. The class of the token comes from the classes of both: each of the commonest
words, and the end of a text, is a class of its own, all other words share classes by their last two letters. Which word of a shared class
it is comes from the token before: every word that occurs often enough has a vector of its own, trained against
noise drawn from its class on the counts of all contexts it occurs in, and the others of the class have their smoothed training frequency. Both steps are
normalised, so token probabilities are normalised over all words. Word counts, class triples and contexts of words cover every
training document and are added up by Spark; the vectors of blocks of words are trained in tasks, so what is learned grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..state import written
from .common import over_batches, words_of

#: Words that are classes of their own, and classes by ending that the others share.
OWN, SHARED = 95, 64
END, CLASSES = OWN, OWN + 1 + SHARED
START = CLASSES  # before the first token
#: Common words whose counts every task holds; the counts of all others are joined.
HEAD = 100_000
WIDTH, STEPS, BATCH, NOISE, SAMPLES, RATE, SEED = 32, 2_000, 2_048, 20, 192, 0.02, 5
#: Words of shared classes with a vector of their own: what occurs so often, up to a number that a task can hold (the commonest).
LEAST, VECTORS = 20, 20_000
#: Words in a block that is trained at once (its cells are numbered in 16 bits); salts that its counts are added up in first; steps and ridge of the training.
BLOCK, SALTS, NEWTON, RIDGE = 256, 64, 8, 1.0
#: Words beside the common ones that a worker remembers.
REMEMBERED = 60_000
_LN10 = np.log(10)


def ending(word: bytes) -> int:
    """The shared class of a word: the CRC-32 of its last two characters, in SHARED parts."""
    return OWN + 1 + zlib.crc32(word.decode()[-2:].encode()) % SHARED


class Model:
    """Log-bilinear scores: the context's representation is a linear map of both tokens' vectors."""

    def __init__(self, triples: np.ndarray, counts: np.ndarray, seed: int = SEED):
        """Trained on ``triples`` (rows of class before last, last, next) with their ``counts``."""
        rng = np.random.default_rng(seed)
        self.r = rng.standard_normal((CLASSES + 1, WIDTH)) * 0.1
        self.c = [np.eye(WIDTH) * 0.5 + rng.standard_normal((WIDTH, WIDTH)) * 0.05 for _ in range(2)]
        self.q = rng.standard_normal((CLASSES, WIDTH)) * 0.1
        unigram = np.bincount(triples[:, 2], counts, CLASSES) + 0.5 if len(triples) else np.ones(CLASSES)
        noise = unigram / unigram.sum()
        self.b = np.log(noise)
        if len(triples):
            self._train(triples, counts / counts.sum(), noise, rng)

    def _train(self, triples, share, noise, rng):
        """Noise-contrastive estimation: tell the true next class from NOISE draws of the class frequencies.

        Batches are drawn by the counts; a batch shares SAMPLES noise draws, weighted to NOISE for each token.
        """
        upto = np.cumsum(share)
        for name in ("r", "q", "b"):
            setattr(self, name, getattr(self, name).astype(np.float32))
        self.c = [c.astype(np.float32) for c in self.c]
        params = {"r": self.r, "c0": self.c[0], "c1": self.c[1], "q": self.q, "b": self.b}
        mean = {k: np.zeros_like(v) for k, v in params.items()}
        square = {k: np.zeros_like(v) for k, v in params.items()}
        log_noise = np.log(NOISE * noise).astype(np.float32)
        for step in range(1, STEPS + 1):
            t = triples[np.minimum(np.searchsorted(upto, rng.random(BATCH)), len(upto) - 1)]
            drawn = rng.choice(CLASSES, SAMPLES, p=noise)
            a, b = self.r[t[:, 0]], self.r[t[:, 1]]
            h = a @ self.c[0] + b @ self.c[1]
            true = (h * self.q[t[:, 2]]).sum(axis=1) + self.b[t[:, 2]] - log_noise[t[:, 2]]
            false = h @ self.q[drawn].T + self.b[drawn] - log_noise[drawn]
            g_true = (1 / (1 + np.exp(-np.clip(true, -30, 30))) - 1) / BATCH
            g_false = 1 / (1 + np.exp(-np.clip(false, -30, 30))) * (NOISE / SAMPLES / BATCH)
            dh = g_true[:, None] * self.q[t[:, 2]] + g_false @ self.q[drawn]
            pick = _one_hot(t[:, 2], CLASSES)
            draw = _one_hot(drawn, CLASSES)
            grad = {"q": pick @ (g_true[:, None] * h) + draw @ (g_false.T @ h), "b": pick @ g_true + draw @ g_false.sum(axis=0),
                    "c0": a.T @ dh, "c1": b.T @ dh,
                    "r": _one_hot(t[:, 0], CLASSES + 1) @ (dh @ self.c[0].T) + _one_hot(t[:, 1], CLASSES + 1) @ (dh @ self.c[1].T)}
            rate = np.float32(RATE * min(1, step / 100) * 0.5 * (1 + np.cos(np.pi * step / STEPS)))
            for k, g in grad.items():
                mean[k] += np.float32(0.1) * (g - mean[k])
                square[k] += np.float32(0.01) * (g * g - square[k])
                params[k] -= rate * (mean[k] / np.float32(1 - 0.9**step)) / (np.sqrt(square[k] / np.float32(1 - 0.99**step)) + np.float32(1e-8))

    def table(self) -> np.ndarray:
        """log10 probabilities of the next class for every pair of classes before: batched products, normalised."""
        left, right = self.r @ self.c[0], self.r @ self.c[1]
        out = np.empty(((CLASSES + 1) ** 2, CLASSES), np.float32)
        for a in range(CLASSES + 1):
            s = (left[a] + right) @ self.q.T + self.b
            s -= s.max(axis=1, keepdims=True)
            out[a * (CLASSES + 1):(a + 1) * (CLASSES + 1)] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / _LN10
        return out


def _one_hot(at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, len(at)), np.float32)
    out[at, np.arange(len(at))] = 1
    return out


def _lower(text: str | None) -> list[bytes]:
    return words_of(None if text is None else text.encode().lower())


def _count_words(batches):
    """Partial word counts, given out before they grow large."""
    held: Counter = Counter()

    def give():
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    for b in batches:
        for t in b.column(0):
            held.update(_lower(t.as_py()))
            if len(held) > 300_000:
                yield give()
                held.clear()
    if held:
        yield give()


class Lexicon:
    """Numbers of words with their classes: first the common ones, by frequency, then others as they come."""

    def __init__(self, head: list[bytes]):
        self.head = len(head)
        self.common = {w: i for i, w in enumerate(head)}
        self.place = dict(self.common)
        self.kind = np.array([i if i < OWN else ending(w) for i, w in enumerate(head)], np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.place) > self.head + REMEMBERED:
                self.place = dict(self.common)
                self.kind = self.kind[:self.head]
            fresh = [w for w in set(words) if w not in self.place]
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
            self.kind = np.concatenate([self.kind, np.array([ending(w) for w in fresh], np.int64)])
            return self.numbers(words)

    def classes(self, numbers: np.ndarray) -> np.ndarray:
        """Classes of the words and of the end."""
        return np.append(self.kind[numbers], END)


def _contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.r_[START, START, classes[:-1]][:len(classes)], np.r_[START, classes[:-1]]
    return before


_GATHERED = "block int, salt int, t long, c long, cells binary, times binary"


def _gather(head: list[bytes], vectors: int):
    """Of a task: counts of class triples (block -1), and for each block of words their counts after each class."""
    def run(batches):
        lexicon, n = Lexicon(head), CLASSES + 1
        sums, words = np.zeros(n * n * CLASSES, np.int32), np.zeros((-(-vectors // BLOCK) * BLOCK, n), np.int32)
        flat = words.ravel()
        for b in batches:
            for t in b.column(0):
                numbers = lexicon.numbers(_lower(t.as_py()))
                c = lexicon.classes(numbers)
                a, z = _contexts(c)
                np.add.at(sums, (a * n + z) * CLASSES + c, 1)
                own = numbers - OWN
                mine = np.flatnonzero((own >= 0) & (own < vectors))
                np.add.at(flat, own[mine] * n + z[mine], 1)
        at = np.flatnonzero(sums)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = [f.split()[0] for f in _GATHERED.split(", ")]
        salt = TaskContext.get().partitionId() % SALTS
        for i in range(0, len(at), 50_000):
            rows = at[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), -1), kinds[0]), pa.array(np.full(len(rows), salt), kinds[1]), pa.array(rows),
                                              pa.array(sums[rows].astype(np.int64)), *[pa.nulls(len(rows), kinds[4])] * 2], names=names)
        for k in range(0, len(words), BLOCK):
            part = flat[k * n:(k + BLOCK) * n]
            at = np.flatnonzero(part)
            if len(at):
                row = [k // BLOCK, salt, None, None, *_packed(at, part[at])]
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names=names)
    return run


def _packed(at: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """The cells of a block that aren't zero, and what they hold."""
    return at.astype(np.uint16).tobytes(), times.astype(np.int64).tobytes()


def _added(rows: pa.Table) -> np.ndarray:
    out = np.zeros(BLOCK * (CLASSES + 1), np.int64)
    for at, times in zip(rows["cells"], rows["times"]):
        out[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(times.as_buffer(), np.int64)
    return out


def _added_rows(rows: pa.Table) -> pa.Table:
    out = _added(rows)
    at = np.flatnonzero(out)
    return pa.table({"block": rows["block"][:1], **{c: pa.array([v], pa.binary()) for c, v in zip(("cells", "times"), _packed(at, out[at]))}})


def word_vectors(counts: np.ndarray, noise: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Vectors of words from their ``counts`` after each class, against as many draws spread as ``noise`` (shares, a row a word).

    Noise-contrastive estimation with one draw for each occurrence: the score of a word after a class is the product of its vector and the class's
    context vector, and tells occurrences from draws; Newton steps with a ridge, for all words at once.
    """
    drawn = counts.sum(axis=1, keepdims=True) * noise
    width = contexts.shape[1]
    squares = (contexts[:, :, None] * contexts[:, None]).reshape(len(contexts), -1)
    q = np.zeros((len(counts), width))
    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-np.clip(q @ contexts.T, -30, 30)))
        slope = (counts * (1 - p) - drawn * p) @ contexts - RIDGE * q
        bend = (((counts + drawn) * p * (1 - p)) @ squares).reshape(-1, width, width) + RIDGE * np.eye(width)
        q += np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
    return q


def _train_words(kinds: np.ndarray, noise: np.ndarray, contexts: np.ndarray):
    """The vectors of one block; ``kinds`` are the classes of all words with vectors."""
    def run(rows: pa.Table) -> pa.Table:
        first = rows["block"][0].as_py() * BLOCK
        kind = kinds[first:first + BLOCK]
        counts = _added(rows).reshape(BLOCK, CLASSES + 1)[:len(kind)].astype(np.float64)
        q = word_vectors(counts, noise[kind], contexts)
        return pa.table({"word": pa.array(np.arange(first, first + len(kind))), "q": pa.array(list(q), pa.list_(pa.float64()))})
    return run


class Words:
    """The second step: of each word with a vector its log10 factor after each class, and of each class and class before the log10 of the total weight."""

    def __init__(self, q: np.ndarray, contexts: np.ndarray, kinds: np.ndarray, counts: np.ndarray, weights: np.ndarray):
        """``weights``: log10 of the classes' total weight (counts and a half for each word and an unknown one) without any factor."""
        self.factor = (q @ contexts.T / _LN10).astype(np.float32)
        change = (counts + 0.5)[:, None] * (10.0 ** self.factor.astype(np.float64) - 1)
        total = np.repeat(10.0 ** weights[:, None], CLASSES + 1, axis=1)
        np.add.at(total, kinds, change)
        self.total = np.log10(total)


def _score(head: list[bytes], counts: np.ndarray, model: Model, words: Words):
    """Scores of whole texts but for the counts of words outside ``head``, which come as a list."""
    state: dict = {}

    def run(batches):
        if not state:
            state.update(table=model.table(), lexicon=Lexicon(head), logs=np.log10(counts + 0.5))
        table, lexicon, logs, n = state["table"], state["lexicon"], state["logs"], CLASSES + 1
        vectors = len(words.factor)
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            for t in b.column("text"):
                split = _lower(t.as_py())
                numbers = lexicon.numbers(split)
                c = lexicon.classes(numbers)
                a, z = _contexts(c)
                neural = float(table[a * n + z, c].sum(dtype=np.float64))
                known = numbers < lexicon.head
                got = np.zeros(len(numbers))
                got[known] = logs[numbers[known]]
                rare = [split[i] for i in np.flatnonzero(~known).tolist()]
                inner = np.flatnonzero(c[:-1] > END)
                own = numbers[inner] - OWN
                has = (own >= 0) & (own < vectors)
                second = got[inner].sum() - words.total[c[inner], z[inner]].sum() + float(words.factor[own[has], z[inner[has]]].sum(dtype=np.float64))
                for col, v in zip(rows, (len(c), int(known.sum()), float(got.sum()), neural + float(second), rare)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(b.num_columns - 1)], pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                 pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.float64()), pa.array(rows[4], pa.list_(pa.binary()))],
                names=["row", "id", "held_out", "n_tokens", "n_head", "head_log", "model_log", "rare"])
    return run


def score(documents: DataFrame, held_out: Column, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    The model learns from the rows that ``held_out`` does not mark (a null mark counts as false). Tokens are the words of the
    whole text with A-Z in lower case, then one end; null and empty texts are one end. ``base_score`` is the smoothed
    unigram log10 probability, ``score`` the model's. Without any training row every word is unknown and classes
    have equal probabilities. Repeated rows teach as often as they come, and each is scored.
    """
    docs = documents.select(F.col(id_).alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    teach = docs.where(~F.col("held_out")).select("text")
    counts = written(over_batches(teach, _count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = teach.count()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    # HEAD rows at most: the most frequent words, ties by the word.
    common = counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()
    head, head_counts = [bytes(r["word"]) for r in common], np.array([r["c"] for r in common], np.float64)
    own = head[:OWN]
    vectors = min(VECTORS, max(0, int((head_counts >= LEAST).sum()) - OWN))
    tail = F.decode("word", "UTF-8")
    last = F.crc32(F.encode(F.right(tail, F.lit(2)), "UTF-8"))
    shared = counts.where(~F.col("word").isin(own) if own else F.lit(True))
    sizes = shared.groupBy((F.pmod(last, F.lit(SHARED)) + (OWN + 1)).cast("int").alias("k")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    weights = np.full(CLASSES, np.log10(0.5))  # of an empty class: one unknown word
    for r in sizes:
        weights[r["k"]] = np.log10(r["n"] + 0.5 * (r["v"] + 1))
    gathered = written(over_batches(teach, _gather(head, vectors), _GATHERED), "lm-gathered")
    # At most (CLASSES + 1)^2 * CLASSES different triples, whatever the corpus.
    counted = gathered.where("block < 0").groupBy("t").agg(F.sum("c").alias("c")).orderBy("t").toArrow()
    t, c = counted.column("t").to_numpy(), counted.column("c").to_numpy().astype(np.float64)
    del counted
    triples = np.stack([(t // CLASSES // (CLASSES + 1)).astype(np.int16), (t // CLASSES % (CLASSES + 1)).astype(np.int16), (t % CLASSES).astype(np.int16)], axis=1)
    del t
    model = Model(triples, c)
    kinds = np.array([ending(w) for w in head[OWN:OWN + vectors]], np.int64)
    contexts = (model.r @ model.c[1]).astype(np.float64)
    after = np.full((CLASSES, CLASSES + 1), 1e-9)
    np.add.at(after, (triples[:, 2], triples[:, 1]), c)
    noise = after / after.sum(axis=1, keepdims=True)
    del triples, c
    sums = gathered.where("block >= 0").groupBy("block", "salt").applyInArrow(_added_rows, "block int, cells binary, times binary")
    # At most VECTORS rows of WIDTH numbers.
    trained = sums.groupBy("block").applyInArrow(_train_words(kinds, noise, contexts), "word long, q array<double>").toArrow()
    q = np.zeros((vectors, WIDTH))
    q[trained.column("word").to_numpy()] = trained.column("q").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH) if len(trained) else 0
    words = Words(q, contexts, kinds, head_counts[OWN:OWN + vectors], weights)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    kind = dict(docs.dtypes)["id"]
    scored = written(over_batches(rows, _score(head, head_counts, model, words),
                                  f"row long, id {kind}, held_out boolean, n_tokens long, n_head long, head_log double, model_log double, "
                                  "rare array<binary>"), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("word", "row").agg(F.count(F.lit(1)).alias("times"))
    known = rare.join(counts, "word", "left").select(
        "row", "times", F.coalesce("c", F.lit(0)).alias("c")).groupBy("row").agg(
        F.sum("times").alias("rare_n"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("rare_log"))
    # Every word outside the head is in a shared class, whose weight the task has already taken off.
    joined = scored.drop("rare").join(known, "row", "left").na.fill(0, ["rare_n", "rare_known", "rare_log"])
    end_known, end_log = int(ends > 0), float(np.log10(ends + 0.5))
    floor = float(np.log10(n + 0.5 * (v + 1)))
    return joined.select(
        F.col("id").alias(id_), "held_out", "n_tokens", (F.col("n_head") + F.col("rare_known") + end_known).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("rare_log") + end_log - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("model_log") + F.col("rare_log")).alias("score"))
