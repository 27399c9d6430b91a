"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word, from both ends, and labels every position with a distribution over the learned
languages; a document's probabilities are the mean over all positions of its words that have a letter. A word's
labels depend on the word alone, so each distinct word runs once per batch of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, new_name, split_words, with_columns, words_of

UNKNOWN = "und"
#: Labelled documents a language is learned from at most, and distinct words of them: the bounded training sample.
DOCS_PER_LANGUAGE, WORDS_PER_LANGUAGE = 500, 12_000
#: Bytes read in one go; longer words are read in pieces of this length.
STRETCH = 32
HIDDEN, BATCH, EPOCHS, RATE, SEED = 20, 256, 4, 0.01, 7
#: Distinct words remembered per worker.
WORDS_KEPT = 400_000
START = 32  # a space stands at both ends of every word

_LETTERS = np.zeros(256, bool)
_LETTERS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two gated recurrent layers, one a direction, and a softmax layer at every position."""

    def __init__(self, languages: list[str], rng: np.random.Generator, hidden: int = HIDDEN):
        self.languages, self.hidden = languages, hidden
        f32 = lambda *shape, s=1.0: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = f32(256, 3 * hidden, s=0.3)
            self.p[f"u{d}"] = f32(hidden, 2 * hidden, s=hidden**-0.5)
            self.p[f"n{d}"] = f32(hidden, hidden, s=hidden**-0.5)
        self.p["out"] = f32(2 * hidden, len(languages), s=0.2)
        self.p["bias"] = np.zeros(len(languages), np.float32)

    def _layer(self, d: str, x: np.ndarray, keep: list | None):
        """Hidden states along the columns of ``x`` (sequences x positions)."""
        h, k = np.zeros((len(x), self.hidden), np.float32), self.hidden
        out = np.empty((x.shape[1], len(x), k), np.float32)
        xs, u, nu = self.p[f"x{d}"], self.p[f"u{d}"], self.p[f"n{d}"]
        for t in range(x.shape[1]):
            a = xs[x[:, t]]
            g = _sigmoid(a[:, :2 * k] + h @ u)
            z, r = g[:, :k], g[:, k:]
            n = np.tanh(a[:, 2 * k:] + (r * h) @ nu)
            if keep is not None:
                keep.append((h, z, r, n))
            h = h + z * (n - h)
            out[t] = h
        return out

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every position: positions x sequences x languages."""
        return self._softmax(np.concatenate([self._layer("f", x, None), self._layer("b", x[:, ::-1], None)[::-1]], axis=2))

    def _softmax(self, h):
        s = h @ self.p["out"] + self.p["bias"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        return s / s.sum(axis=2, keepdims=True)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy of all positions, by backpropagation through time."""
        kept = {"f": [], "b": []}
        hf = self._layer("f", x, kept["f"])
        hb = self._layer("b", x[:, ::-1], kept["b"])[::-1]
        both = np.concatenate([hf, hb], axis=2)
        delta = self._softmax(both)
        delta[:, np.arange(len(y)), y] -= 1
        delta *= (weight / (weight.sum() * x.shape[1]))[None, :, None].astype(np.float32)
        g = {"out": np.einsum("tbh,tbc->hc", both, delta), "bias": delta.sum(axis=(0, 1))}
        dh_all = delta @ self.p["out"].T
        k = self.hidden
        for d, dh_out, seq in (("f", dh_all[:, :, :k], x), ("b", dh_all[::-1, :, k:], x[:, ::-1])):
            u, nu = self.p[f"u{d}"], self.p[f"n{d}"]
            gu, gn, rows, index = np.zeros_like(u), np.zeros_like(nu), [], []
            dh = np.zeros_like(dh_out[0])
            for t in range(x.shape[1] - 1, -1, -1):
                h, z, r, n = kept[d][t]
                dh = dh + dh_out[t]
                dn = dh * z * (1 - n * n)
                dz = dh * (n - h) * z * (1 - z)
                back = dn @ nu.T
                dr = back * h * r * (1 - r)
                dg = np.concatenate([dz, dr], axis=1)
                gn += (r * h).T @ dn
                gu += h.T @ dg
                rows.append(np.concatenate([dg, dn], axis=1))
                index.append(seq[:, t])
                dh = dh * (1 - z) + back * r + dg @ u.T
            one_hot = np.zeros((256, len(rows) * len(x)), np.float32)
            one_hot[np.concatenate(index), np.arange(one_hot.shape[1])] = 1
            g[f"x{d}"], g[f"u{d}"], g[f"n{d}"] = one_hot @ np.concatenate(rows), gu, gn
        return g


def _stretches(word: bytes) -> list[bytes]:
    return [word[i:i + STRETCH] for i in range(0, len(word), STRETCH)]


def _matrix(words: list[bytes]) -> np.ndarray:
    """Equal-length stretches with a space at both ends, as an array of bytes."""
    return np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).reshape(len(words), -1)


def train(sample: list[tuple[bytes, str, int]], epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """A network from ``(word, language, count)`` rows; None without any row. Languages weigh the same in total."""
    rng = np.random.default_rng(seed)
    rows = sorted((s, lang, n) for w, lang, n in sample for s in _stretches(w))
    if not rows:
        return None
    languages = sorted({lang for _, lang, _ in rows})
    net = Network(languages, rng)
    at = {lang: i for i, lang in enumerate(languages)}
    y = np.array([at[lang] for _, lang, _ in rows])
    weight = np.sqrt(np.array([n for _, _, n in rows], np.float64))
    weight /= np.bincount(y, weight, len(languages))[y]
    weight /= weight.mean()
    by_size: dict[int, list[int]] = {}
    for i, (w, _, _) in enumerate(rows):
        by_size.setdefault(len(w), []).append(i)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        batches = [idx[i:i + BATCH] for idx in (rng.permutation(v) for v in by_size.values())
                   for i in range(0, len(idx), BATCH)]
        for b in rng.permutation(len(batches)):
            idx = batches[b]
            x = _matrix([rows[i][0] for i in idx])
            share = len(idx) / BATCH * weight[idx].mean()
            step += 1
            rate = RATE * min(1, step / 50) * 0.4**epoch * min(1, share)
            for k, g in net.gradient(x, y[idx], weight[idx]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return net


def training_words(documents: DataFrame, text: str, label: str, id_: str) -> list[tuple[bytes, str, int]]:
    """The bounded sample: of each language the documents and then the words that come first by hash."""
    given = documents.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(F.col(id_), F.col(text)).alias("h"))
    first = given.select("label", "h").withColumn(
        "r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("r") <= DOCS_PER_LANGUAGE)
    # One bound per language goes back as a literal, so that texts are filtered where they are read.
    ends = first.groupBy("label").agg(F.max("h").alias("last")).collect()
    if not ends:
        return []
    chosen = F.lit(False)
    for e in ends:
        chosen = chosen | ((F.col("label") == e["label"]) & (F.col("h") <= e["last"]))
    words = given.where(chosen).select("label", F.explode(split_words(F.col("text"))).alias("w"))
    counts = words.groupBy("label", "w").count().where(F.col("w").rlike("[A-Za-z\\x{80}-\\x{10ffff}]"))
    rows = counts.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("count"), F.xxhash64("w"))))
    return [(r["w"].encode(), r["label"], r["count"]) for r in rows.where(F.col("r") <= WORDS_PER_LANGUAGE).collect()]


class Reader:
    """Pooled labels of words, remembered per worker."""

    def __init__(self, net: Network):
        self.net, self.place, self.sums = net, {}, np.zeros((0, len(net.languages) + 1))

    def words(self, words: set[bytes]) -> None:
        """Makes sure that all ``words`` have their sums of label probabilities and numbers of positions."""
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > WORDS_KEPT:
            self.place, self.sums = {}, self.sums[:0]
            new = list(words)
        pieces = [(s, i) for i, w in enumerate(new) if _LETTERS[np.frombuffer(w, np.uint8)].any() for s in _stretches(w)]
        pieces.sort(key=lambda p: len(p[0]))
        sums = np.zeros((len(new), self.sums.shape[1]))
        at = 0
        while at < len(pieces):
            n, upto = len(pieces[at][0]), at
            while upto < len(pieces) and len(pieces[upto][0]) == n and upto < at + 8192:
                upto += 1
            pooled = self.net.labels(_matrix([p for p, _ in pieces[at:upto]]))[1:-1].sum(axis=0)
            np.add.at(sums, [i for _, i in pieces[at:upto]], np.c_[pooled, np.full(len(pooled), n)])
            at = upto
        self.place.update(zip(new, range(len(self.sums), len(self.sums) + len(new))))
        self.sums = np.concatenate([self.sums, sums])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        self.words({w for ws in split for w in ws})
        out = []
        for t, ws in zip(texts, split):
            if not t or not any(map(str.isalpha, t)):
                out.append((UNKNOWN, 0.0))
                continue
            total = self.sums[[self.place[w] for w in ws]].sum(axis=0)
            p = total[:-1] / max(total[-1], 1.0)
            best = int(p.argmax())
            out.append((self.net.languages[best], float(min(1.0, max(0.0, p[best])))))
        return out


def _reader(token: int, net: Network) -> Reader:
    """This worker's reader of a network; tasks of one query share it."""
    return held(f"reader-{token}", lambda: Reader(net))


def identify(documents: DataFrame, net: Network | None, text: str = "text", lang: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """``documents`` with the predicted language and its probability.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned.
    Rows are judged one by one: repeated rows get the same answer. Whole texts are read. Other columns pass
    through; ``lang`` and ``score`` must be new names. An empty table stays empty.
    """
    token = int(np.random.default_rng().integers(1 << 62))

    def make(b: pa.RecordBatch):
        if net is None:
            return [pa.array([UNKNOWN] * b.num_rows), pa.array([0.0] * b.num_rows)]
        got = _reader(token, net).predict(b.column(text).to_pylist())
        return [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]

    return with_columns(documents, [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())], make)


def learn(documents: DataFrame, learn_from: Column | None = None, text: str = "text", label: str = "lang",
          id_: str = "doc_id") -> Network | None:
    """A network from the labelled rows of ``documents`` that ``learn_from`` admits; rows without text or label teach nothing."""
    rows = documents if learn_from is None else documents.where(learn_from)
    return train(training_words(rows, text, label, id_))


def keep_known(documents: DataFrame, net: Network | None, least: float, text: str = "text") -> DataFrame:
    """Rows whose language is known with at least the score ``least``, with the columns of ``documents``."""
    lang, score = new_name(documents, "lang_pred"), new_name(documents, "lang_score")
    marked = identify(documents, net, text, lang, score)
    return marked.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*documents.columns)
