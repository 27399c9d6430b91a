"""A small table of documents with every awkward case, and brute-force answers."""

import hashlib
import random
import zlib
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, epoch int"


def prose(rng, words, alphabet):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(words))


def documents():
    """Rows (doc_id, text, lang, source, n_chars, and two columns whose names clash with results)."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(60, 160), "the and of ing" if i % 2 else "çéàuelx") for i in range(24)]
    passage = prose(rng, 80, "qrstuv")
    texts[3] += " " + passage
    texts[5] = passage + "\n" + texts[5]
    texts[7] = texts[2]
    texts[9] = texts[2].replace(" ", "  ", 3) + " end"
    texts[11] = "\n".join(["A line of junk!! #### again"] * 30)
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 6 == 5 else f"s{i % 3}", len(t), "x", i) for i, t in enumerate(texts)]
    odd = [(100, None, "en", "s0", None, None, None), (101, "", None, "s0", 0, "x", 1), (102, " \n\t ", "fr", None, 4, "x", 1),
           (103, "12 34 #### ++", "en", "s1", 13, "x", 1), (None, texts[2], "en", "s1", 5, "x", 1), (None, None, None, None, None, None, None),
           (104, "one", "en", "s9", 3, "x", 1), (105, "x" * 5_000, "en", "s0", 5_000, "x", 1),
           (106, prose(rng, 6_000, "abcde"), "en", "s0", 1, "x", 1), (4, rows[4][1], "fr", "s1", 7, "x", 1)]
    return rows + odd


def words(t):
    return (t or "").encode().split()


def repeats(rows, window):
    """(doc_id, n_words, n_removed, digest) for every row, window by window."""
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s:s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for s in range(len(w) - window + 1):
                if first[tuple(w[s:s + window])] < i:
                    gone[s:s + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def components(rows, fingerprints):
    """component_id per row, from all pairs of fingerprints."""
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[root(i)] = min(least.get(root(i), id_), id_)
    return [least.get(root(i)) for i in range(len(rows))]


def base_scores(rows):
    """op3's counts and base score per row."""
    import math

    lists = [[w.lower() for w in words(t)] + [None] for _, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(lists, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))
            for (i, _), h, ws in zip(rows, held, lists)]


def counts(text):
    """op8's base columns of one text."""
    import re

    t = text or ""
    ws, seen, dup = [w.decode() for w in words(t)], set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[j:j + 8]) for j in range(len(ws) - 7))
    covered = {k for j in range(len(ws) - 7) if windows[tuple(ws[j:j + 8])] > 1 for k in range(j, j + 8)}
    return (len(ws), sum(map(len, ws)), sum(ch in "#*$%&|<>" for ch in t), dup, len(covered),
            len(ws) < 20 or 100 * len(covered) > 30 * len(ws))
