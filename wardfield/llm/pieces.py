"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file gives pieces and scores; merging and decoding are done here on flat arrays.
"""

from __future__ import annotations

import hashlib
import re
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held, with_columns

MARK = "▁"
#: Symbols at or above this stand for single characters that are no piece, as BASE + code point.
BASE = 1 << 20
NO_RANK = np.int64(1 << 40)
#: Distinct words remembered per worker, and those merged in one set of rounds.
WORD_CACHE = 100_000
CHUNK_SYMBOLS = 300_000


class Vocabulary:
    """Pieces of a model as merge tables and byte tables."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = np.full(256, -1, np.int64)
        names, normal = [sp.id_to_piece(i) for i in range(size)], {}
        scores = np.array([sp.get_score(i) for i in range(size)])
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal[name] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces that span words are not supported")
        # Same score, same rank; the best score is rank 0.
        rank = np.unique(-scores, return_inverse=True)[1]
        self.symbol = lambda s: normal.get(s, BASE + ord(s) if len(s) == 1 else -1)
        pairs: dict[tuple[int, int], int] = {}
        inside = set()
        for name, i in normal.items():
            if len(name) > 1:
                inside.update(name)
            for cut in range(1, len(name)):
                a, b = self.symbol(name[:cut]), self.symbol(name[cut:])
                if a >= 0 and b >= 0:
                    pairs[a, b] = i
        self._table(np.array([(a << 32) | b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int64), rank)
        # Code point -> symbol, for the planes where pieces live.
        self.top = max(map(ord, inside | {n for n in normal if len(n) == 1})) + 1
        self.of_char = BASE + np.arange(self.top, dtype=np.int64)
        for name, i in normal.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        # A line end is in no longer piece, so it parts words like a space does.
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in inside else f"{MARK}*[^{MARK}]+|{MARK}+")
        # Bytes each id decodes to; control ids give none, the unknown id its usual surface.
        out = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                out.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i):
                out.append(b"")
            elif sp.is_unknown(i):
                out.append(" ⁇ ".encode())
            else:
                out.append(name.replace(MARK, " ").encode())
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.byte_ids] = True
        self.control = np.array([sp.is_control(i) for i in range(size)])
        self.surface = out

    def _table(self, keys: np.ndarray, pieces: np.ndarray, rank: np.ndarray) -> None:
        """Pairs in an open-addressed table, a sixteenth full at most; an empty slot has key -1."""
        self.bits = int(len(keys)).bit_length() + 4
        self.pair_keys = np.full(1 << self.bits, -1, np.int64)
        self.pair_rank = np.full(1 << self.bits, NO_RANK)
        self.pair_piece = np.zeros(1 << self.bits, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.pair_keys[slot[left]] < 0
            self.pair_keys[slot[left[free]]] = keys[left[free]]
            put = self.pair_keys[slot[left]] == keys[left]
            got = left[put]
            self.pair_rank[slot[got]], self.pair_piece[slot[got]] = rank[pieces[got]], pieces[got]
            left = left[~put]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of neighbours; NO_RANK where they make no piece."""
        key = (a << 32) | b
        at = self._slot(key)
        found = self.pair_keys[at]
        odd = np.flatnonzero((found != key) & (found >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & ((1 << self.bits) - 1)
            found = self.pair_keys[at[odd]]
            odd = odd[(found != key[odd]) & (found >= 0)]
        return self.pair_rank[at], self.pair_piece[at]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (a run of marks and what follows) as little-endian 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(words):
            upto, n = at, 0
            while upto < len(words) and (upto == at or n + len(words[upto]) <= CHUNK_SYMBOLS):
                n += len(words[upto])
                upto += 1
            out += self._encode(words[at:upto])
            at = upto
        return out

    def _encode(self, words: list[str]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = np.where(chars < self.top, self.of_char[np.minimum(chars, self.top - 1)], BASE + chars)
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word, done_at = [], [], []
        place = np.arange(len(sym))
        rank, piece = self._pairs(sym, word)
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            counts = np.diff(np.r_[start, len(sym)])
            live = np.repeat(least < NO_RANK, counts)
            if not live.all():  # words without a pair are finished: compaction drops them
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                done_at.append(place[~live])
                sym, word, place, rank, piece = (x[live] for x in (sym, word, place, rank, piece))
                if not len(sym):
                    break
                counts, least = counts[least < NO_RANK], least[least < NO_RANK]
            take = self._leftmost(sym, word, rank, piece, np.repeat(least, counts))
            sym, word, place, rank, piece = self._merge(sym, word, place, rank, piece, take)
        sym, word, place = (np.concatenate(x) for x in (done_sym or [sym], done_word or [word], done_at or [place]))
        order = np.argsort(place)
        return self._ids(sym[order], word[order], len(words))

    def _pairs(self, sym, word):
        rank = np.full(len(sym), NO_RANK)
        piece = np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same], piece[same] = self.merged(sym[same], sym[same + 1])
        return rank, piece

    def _leftmost(self, sym, word, rank, piece, least):
        """Positions whose pair merges this round: those of the word's best rank, from the left, not overlapping.

        Where a merge would make a pair that is at least as good as the current one, one at a time would differ
        from all at once, so such a word merges its first pair only.
        """
        hit = np.flatnonzero(rank == least)
        if len(hit) > 1:  # in a chain of touching hits every second one goes, counted from the left
            fresh = np.r_[True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        many = np.flatnonzero(word[hit[1:]] == word[hit[:-1]]) if len(hit) > 1 else hit[:0]
        if not len(many):
            return hit
        new, n = piece[hit], len(sym)
        seen, chosen = np.zeros(len(hit), bool), np.zeros(n, bool)
        chosen[hit] = True
        for side in (-1, 2):  # the neighbour as it is, and as it would be if it merged too
            at = hit + side
            ok = (at >= 0) & (at < n)
            ok[ok] = word[at[ok]] == word[hit[ok]]
            far = hit - 2 if side < 0 else hit + 2
            other = ok & chosen[np.clip(far, 0, n - 1)]
            for mask, with_ in ((ok, sym[np.clip(at, 0, n - 1)]), (other, piece[np.clip(far, 0, n - 1)])):
                if mask.any():
                    a, b = (with_[mask], new[mask]) if side < 0 else (new[mask], with_[mask])
                    seen[mask] |= self.merged(a, b)[0] <= least[hit[mask]]
        if not seen.any():
            return hit
        slow = np.isin(word[hit], word[hit[seen]])
        first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
        return hit[~slow | first]

    def _merge(self, sym, word, place, rank, piece, take):
        sym[take] = piece[take]
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        sym, word, place, rank, piece = (x[keep] for x in (sym, word, place, rank, piece))
        at = take - np.arange(len(take))  # each merge before it has closed one gap
        touched = np.zeros(len(sym), bool)
        touched[at] = True
        touched[np.maximum(at - 1, 0)] = True
        redo = np.flatnonzero(touched)
        last = redo + 1 >= len(sym)
        nxt = np.minimum(redo + 1, len(sym) - 1)
        inner = ~last & (word[nxt] == word[redo])
        rank[redo] = NO_RANK
        rank[redo[inner]], piece[redo[inner]] = self.merged(sym[redo[inner]], sym[nxt[inner]])
        return sym, word, place, rank, piece

    def _ids(self, sym, word, n):
        """Ids per word; characters that are no piece become the pieces of their UTF-8 bytes."""
        odd = np.flatnonzero(sym >= BASE)
        if len(odd):
            raw = [self.byte_ids[list(chr(int(c) - BASE).encode())] for c in sym[odd]]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            where = np.repeat(sym >= BASE, times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[where] = np.concatenate(raw)
        ends = np.searchsorted(word, np.arange(n + 1)) * 4
        flat = sym.astype("<u4").tobytes()
        return [flat[ends[i]:ends[i + 1]] for i in range(n)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces with marks as spaces, byte runs as UTF-8, the leading mark dropped."""
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        if self.control[ids].any():
            ids = ids[~self.control[ids]]
        if not len(ids):
            return ""
        edges = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
        out = []
        for run in np.split(ids, edges):
            raw = b"".join([self.surface[i] for i in run.tolist()])
            out.append(_utf8(raw) if self.is_byte[run[0]] else raw.decode())
        if not self.is_byte[ids[0]] and ids[0] != self.unk and out[0].startswith(" "):
            out[0] = out[0][1:]
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """Bytes as text; every byte that is no part of a valid character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Encoder:
    """Encodes whole texts, remembering the ids of words seen lately."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known, self.older = vocabulary, {}, {}

    def encode(self, texts: list[str | None], bos: bool, eos: bool) -> list[np.ndarray]:
        """Ids of each text; a null counts as empty, and an empty text has begin and end only."""
        split = [self.v.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {w for ws in split for w in ws if w not in self.known}
        if len(self.known) + len(new) > WORD_CACHE:  # what was used since the last change of the guard lives on
            self.known, self.older = {}, self.known
            new = {w for ws in split for w in ws}
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        new = sorted((w for w in new if w not in self.older), key=len)
        self.known.update(zip(new, self.v.encode_words(new)))
        head = struct.pack("<I", self.v.bos) if bos else b""
        tail = struct.pack("<I", self.v.eos) if eos else b""
        return [np.frombuffer(head + b"".join([self.known[w] for w in ws]) + tail, "<u4") for ws in split]


def worker(name: str) -> Encoder:
    """The encoder of this Python worker, from the model file that the driver handed out."""
    return held(f"pieces-{name}", lambda: Encoder(Vocabulary(Path(SparkFiles.get(name)).read_bytes())))


def share_model(spark, path: str) -> str:
    """Hand the model file to every worker through Spark, so that ``path`` need only exist on the driver."""
    name = Path(path).name
    spark.sparkContext.addFile(path)
    return name


def encode(df: DataFrame, model: str, text: str = "text", into: str = "ids",
           bos: bool = True, eos: bool = True) -> DataFrame:
    """``df`` with ``into``: the ids of ``text``.

    A null or empty text gets the begin and end ids only; repeated rows stay repeated; other
    columns pass through; an empty table stays empty. Whole texts are encoded, whatever their length.
    """
    name = share_model(df.sparkSession, model)

    def make(b: pa.RecordBatch):
        ids = worker(name).encode(b.column(text).to_pylist(), bos, eos)
        sizes = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return [pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.astype(np.int32)))]

    return with_columns(df, [T.StructField(into, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with ``into``: the text of ``ids``. Null ids give null; control ids give nothing."""
    name = share_model(df.sparkSession, model)

    def make(b: pa.RecordBatch):
        v = worker(name).v
        lists = b.column(ids)
        return [pa.array([None if x is None else v.decode(np.asarray(x.values if hasattr(x, "values") else x, np.int64))
                          for x in (s if s.is_valid else None for s in lists)], pa.string())]

    return with_columns(df, [T.StructField(into, T.StringType())], make)


def encode_and_decode(df: DataFrame, model: str, text: str = "text", into: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of :func:`encode` and the text that :func:`decode` gives for them, in one pass of one worker."""
    name = share_model(df.sparkSession, model)

    def make(b: pa.RecordBatch):
        e = worker(name)
        ids = e.encode(b.column(text).to_pylist(), True, True)
        sizes = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return [pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.astype(np.int32))),
                pa.array([e.v.decode(x) for x in ids], pa.string())]

    return with_columns(df, [T.StructField(into, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())], make)


def digests(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with the number of ids, and digests of the ids and of the text decoded from them.

    The columns are those of :func:`encode` and :func:`decode` reduced inside the task, so that neither ids nor
    texts are moved.
    """
    name = share_model(df.sparkSession, model)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]

    def make(b: pa.RecordBatch):
        e = worker(name)
        ids = e.encode(b.column(text).to_pylist(), True, True)
        return [pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(e.v.decode(x).encode()).hexdigest() for x in ids])]

    return with_columns(df, fields, make).drop(text)
