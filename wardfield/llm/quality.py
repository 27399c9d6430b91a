"""Quality classifier from weak labels: overlapping heuristic labellers, their accuracies by
expectation-maximisation, and a hashed linear scorer trained on the posterior labels.

Each labeller votes bad, good or not at all on a whole text. The counts of vote patterns over all documents, of
which there are at most ``3 ** len(LABELLERS)``, are all that estimation needs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, new_name, with_columns, words_of

BAD, GOOD, NONE = 0, 1, 2
#: Hashed features, and the documents that the scorer is trained on at most (first by hash): the bounded sample.
BUCKETS, SAMPLE = 1 << 14, 4_000
ROUNDS, EPOCHS, BATCH, RATE, PENALTY, SEED = 100, 30, 128, 0.05, 1e-4, 3
#: Mean weights are multiplied by this, so that weights stay near one.
SCALE = 10.0
#: Distinct words remembered per worker.
WORDS_KEPT = 300_000

_SYMBOLS = b"#*$%&|<>"
#: Small letters and bytes of other letters to a, capitals to A, digits to 0; runs of one kind count once.
_KINDS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"([aA0])\1+")


def buckets(word: bytes) -> tuple[int, int]:
    """Hashed features of a word: itself in lower case, and its shape (letters a, capitals A, digits 0)."""
    kinds = word.translate(_KINDS)
    shape = _RUNS.sub(rb"\1", kinds) if kinds.strip(b"a") else b"a"
    return zlib.crc32(word.lower()) % BUCKETS, zlib.crc32(b"\0" + shape) % BUCKETS


#: Features of a word by whether it repeats the word before it.
AGAIN, FRESH = (zlib.crc32(x) % BUCKETS for x in (b"\0again", b"\0fresh"))


_MARKED = np.isin(np.arange(256), list(b"!?#*$%&|<>"))


def _facts(words: list[bytes]) -> np.ndarray:
    """Of each word: length, symbols, whether it ends in a mark, has capitals only, is short, begins with a digit."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    plain = np.fromiter(map(len, [w.translate(None, _SYMBOLS) for w in words]), np.int64, n)
    first, last = (np.fromiter((w[at] for w in words), np.uint8, n) for at in (0, -1))
    return np.stack([size, size - plain, _MARKED[last], np.fromiter(map(bytes.isupper, words), bool, n), size <= 3, (first >= 48) & (first <= 57)], axis=1)


class Words:
    """Numbers of words, with what is looked at in each; those seen lately are remembered."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.facts, self.bucket = np.zeros((1_024, 6)), np.zeros((1_024, 2), np.int64)
        self.hashed = 0  # words whose buckets are known: the others' are found when they are asked for
        self.weights, self.sums, self.summed = None, np.zeros(1_024), 0

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [words_of(t) for t in texts]
        new = set().union(*split) - self.place.keys()
        if len(self.place) + len(new) > WORDS_KEPT:
            self.__init__()
            new = set().union(*split)
        if new:
            new, start = list(new), len(self.place)
            self.place.update(zip(new, range(start, start + len(new))))
            if len(self.place) > len(self.facts):  # room for twice as many, so that growing copies little
                room = 2 * len(self.place)
                self.facts = np.resize(self.facts, (room, 6))
                self.bucket = np.resize(self.bucket, (room, 2))
                self.sums = np.resize(self.sums, room)
            self.facts[start:len(self.place)] = _facts(new)
        number = self.place.__getitem__
        return [np.fromiter(map(number, ws), np.int64, len(ws)) for ws in split]

    def measures(self, text: str | None, at: np.ndarray) -> dict[str, float]:
        """What the labellers look at, for a whole text and the numbers of its words."""
        n = max(1, len(at))
        sums = self.facts[at].sum(axis=0) if len(at) else np.zeros(6)
        lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
        return {"words": len(at), "mean": sums[0] / n, "symbols": sums[1] / n, "marked": sums[2] / n, "capitals": sums[3] / n,
                "short": sums[4] / n, "digits": sums[5] / n, "dup_lines": 1 - len(set(lines)) / max(1, len(lines)),
                "distinct": len(np.unique(at)) / n, "again": float((at[1:] == at[:-1]).sum()) / n}

    def _hash(self) -> None:
        if self.hashed < len(self.place):
            self.bucket[self.hashed:len(self.place)] = [buckets(w) for w in islice(self.place, self.hashed, None)]
            self.hashed = len(self.place)

    def features(self, at: np.ndarray) -> np.ndarray:
        self._hash()
        again = np.r_[False, at[1:] == at[:-1]] if len(at) else np.zeros(0, bool)
        return np.r_[self.bucket[at].ravel(), np.where(again, AGAIN, FRESH)]

    def scores(self, numbers: list[np.ndarray], weights: np.ndarray) -> list[float]:
        """The mean weight of each text's features: weights are added up once for each word that is remembered."""
        self._hash()
        if self.weights is not weights:
            self.weights, self.summed = weights, 0
        fresh = slice(self.summed, len(self.place))
        self.sums[fresh] = weights[self.bucket[fresh]].sum(axis=1)
        self.summed = len(self.place)
        out = []
        for at in numbers:
            again = int((at[1:] == at[:-1]).sum())
            total = self.sums[at].sum() + again * weights[AGAIN] + (len(at) - again) * weights[FRESH]
            out.append(float(total) / (3 * len(at)) if len(at) else 0.0)
        return out


def _words() -> Words:
    return held("quality-words", Words)


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def _prose(m: dict[str, float]) -> bool:
    return m["words"] >= 20


#: Shares that need some words to mean anything are not voted on in shorter texts.
LABELLERS: list[tuple[str, Callable[[dict[str, float]], int]]] = [
    ("length", lambda m: _vote(False, _prose(m))),
    ("symbols", lambda m: _vote(m["symbols"] > 0.1, m["symbols"] < 0.01)),
    ("marked", lambda m: _vote(m["marked"] > 0.2, m["marked"] < 0.02)),
    ("capitals", lambda m: _vote(m["capitals"] > 0.4, m["capitals"] < 0.05)),
    ("dup_lines", lambda m: _vote(m["dup_lines"] > 0.3, _prose(m) and m["dup_lines"] < 0.1)),
    ("distinct", lambda m: _vote(_prose(m) and m["distinct"] < 0.3, _prose(m) and m["distinct"] > 0.4)),
    ("again", lambda m: _vote(m["again"] > 0.1, _prose(m) and m["again"] < 0.03)),
    ("short", lambda m: _vote(_prose(m) and m["short"] < 0.08, _prose(m) and m["short"] > 0.15)),
    ("mean", lambda m: _vote(_prose(m) and not 3 <= m["mean"] <= 9, _prose(m) and 3.5 <= m["mean"] <= 7.5)),
    ("digits", lambda m: _vote(_prose(m) and m["digits"] > 0.2, False)),
]


def pattern(m: dict[str, float]) -> int:
    """All votes as one number in base three."""
    out = 0
    for _, label in LABELLERS:
        out = 3 * out + label(m)
    return out


def features_of(numbers: np.ndarray) -> np.ndarray:
    """Hashed features of the words that :func:`patterns_of` numbered in the same batch."""
    return _words().features(numbers)


def patterns_of(texts: list[str | None]) -> tuple[list[int], list[np.ndarray]]:
    """Vote patterns, and the numbers of the words, of whole texts."""
    known = _words()
    numbers = known.numbers(texts)
    return [pattern(known.measures(t, at)) for t, at in zip(texts, numbers)], numbers


def _votes(patterns: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return patterns[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


class _Voted(dict):
    """How many labellers vote in a pattern."""

    def __missing__(self, p: int) -> int:
        self[p] = int((_votes(np.array([p])) != NONE).sum())
        return self[p]


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of good for each pattern, and each labeller's ``P(vote | class)`` (labeller x class x vote).

    Expectation-maximisation, from the start that any bad vote makes bad likely (texts are bad in one way,
    seldom in all, so the majority is a poor start): classes weigh patterns, patterns weigh votes. Votes are
    independent within a class, and not to vote says nothing about the class, so that short texts, on which few
    labellers vote, are judged by those. Labellers that never vote change nothing.
    """
    v, n = _votes(patterns), counts.astype(np.float64)
    good = np.where((v == BAD).any(axis=1), 0.1, 0.95)
    table = np.ones((v.shape[1], 2, 3))
    for _ in range(ROUNDS):
        before = good
        share = np.stack([1 - good, good]) * n
        prior = (share.sum(axis=1) + 1) / (n.sum() + 2)
        for j in range(v.shape[1]):
            for y in (BAD, GOOD):
                table[j, y, :NONE] = np.bincount(v[:, j], share[y], 3)[:NONE] + 1
        table[:, :, :NONE] /= table[:, :, :NONE].sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + np.stack([sum(np.log(table[j, y])[v[:, j]] for j in range(v.shape[1])) for y in (BAD, GOOD)])
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(good - before).max() < 1e-9:
            break
    return good, table


def train(rows: list[tuple[list[int], list[float], float]]) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on rows of (buckets, shares, posterior); zeros without rows."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    rng = np.random.default_rng(SEED)
    square, square_bias = np.full(BUCKETS, 1e-8), 1e-8
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at:at + BATCH]]
            index = np.concatenate([np.asarray(p[0], np.int64) for p in part])
            value = np.concatenate([np.asarray(p[1]) for p in part])
            row = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            z = SCALE * np.bincount(row, weights[index] * value, len(part)) + bias
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([p[2] for p in part])) / len(part)
            g = SCALE * np.bincount(index, value * d[row], BUCKETS) + PENALTY * weights
            square += g * g
            square_bias += d.sum() ** 2
            weights -= RATE * g / np.sqrt(square)
            bias -= RATE * d.sum() / np.sqrt(square_bias)
    return weights, float(bias)


def classify(documents: DataFrame, id_: str = "doc_id", text: str = "text", least: float = 0.5,
             into: tuple[str, str, str, str] = ("labellers", "posterior", "score", "kept")) -> DataFrame:
    """``documents`` with the number of labellers that voted, the posterior, the scorer's probability of good, and ``kept``.

    ``kept`` is a score of at least ``least``. A null text, or one without a word, has posterior and score 0. Rows
    are judged one by one, so repeated rows agree; whole texts are read; other columns pass through, and the new names must
    be new. An empty table stays empty.
    """
    place = new_name(documents, "vote_pattern")
    voted = with_columns(documents, [T.StructField(place, T.IntegerType())],
                         lambda b: [pa.array(patterns_of(b.column(text).to_pylist())[0], pa.int32())])
    # At most 3 ** len(LABELLERS) rows whatever the input.
    counts = voted.where(F.col(text).rlike(r"[^\x20\x09-\x0D]")).groupBy(place).count().orderBy(place).collect()
    patterns = np.array([r[place] for r in counts], np.int64)
    good, _ = estimate(patterns, np.array([r["count"] for r in counts])) if counts else (np.zeros(0), None)
    posterior = dict(zip(patterns.tolist(), good.tolist()))
    first = (documents.select(F.col(text).alias("text"), F.xxhash64(F.col(id_), F.col(text)).alias("h"))
             .where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    ends = first.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h").alias("last")).first()["last"]
    weights, bias = np.zeros(BUCKETS), 0.0
    if ends is not None:
        def sample(b: pa.RecordBatch):
            index, value, label = [], [], []
            for p, words in zip(*patterns_of(b.column("text").to_pylist())):
                at, n = np.unique(features_of(words), return_counts=True)
                index.append(at.tolist())
                value.append((n / n.sum()).tolist())
                label.append(posterior[p])
            return [pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64())), pa.array(label, pa.float64())]

        fields = [T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.DoubleType())),
                  T.StructField("label", T.DoubleType())]
        drawn = with_columns(first.where(F.col("h") <= ends), fields, sample).select("h", "index", "value", "label").limit(SAMPLE)
        table = drawn.toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
        weights, bias = train(list(zip(*(table.column(c).to_pylist() for c in ("index", "value", "label")))))

    voted_on = _Voted()

    def judge(b: pa.RecordBatch):
        found, numbers = patterns_of(b.column(text).to_pylist())
        some = [len(at) > 0 for at in numbers]
        n = [voted_on[p] if x else 0 for p, x in zip(found, some)]
        post = [posterior.get(p, 0.0) if x else 0.0 for p, x in zip(found, some)]
        z = np.clip(SCALE * np.array(_words().scores(numbers, weights)) + bias, -500, 500)
        score = np.where(some, 1 / (1 + np.exp(-z)), 0.0).tolist()
        return [pa.array(n, pa.int32()), pa.array(post, pa.float64()), pa.array(score, pa.float64()),
                pa.array([s >= least for s in score], pa.bool_())]

    kinds = (T.IntegerType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    return with_columns(documents, [T.StructField(c, k) for c, k in zip(into, kinds)], judge)
