"""Near duplicates by sketches, whitening and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from wardfield.llm import registry, setsketch, spelling, whitening

from . import data

ROWS = [(r[0], r[1]) for r in data.documents()]
WORDS = ["".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(2_000)]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


# ---- near duplicates ---------------------------------------------------------

def sets(text):
    w = [x.lower() for x in data.words(text)]
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} - {()}


def classes(texts):
    """(id, n_shingles, component_id, kept) from all pairs."""
    found = [sets(t) for _, t in texts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if found[i] and 100 * len(found[i] & found[j]) >= 80 * len(found[i] | found[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(texts):
        if id_ is not None:
            least[root(i)] = min(least.get(root(i), id_), id_)
    got = [(i, len(found[k]), least.get(root(k)) if found[k] else i) for k, (i, _) in enumerate(texts)]
    return sorted(((*g, g[0] is not None and g[0] == g[2]) for g in got), key=repr)


def copies():
    """Copies around the least similarity, chains of copies, and a crowd of near copies of which many don't link directly."""
    rng, out = random.Random(8), []

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = rng.choice(WORDS)
        return words

    for length in (20, 100, 400):
        for _ in range(20):
            base = rng.choices(WORDS, k=length)
            out += [base] + [changed(base, max(1, length * n // 100)) for n in (1, 4, 5, 6, 9)]
    chain = rng.choices(WORDS, k=200)
    for _ in range(12):
        chain = changed(chain, 8)
        out.append(chain)
    base = rng.choices(WORDS, k=150)
    out += [changed(base, rng.randint(1, 8)) for _ in range(200)]
    return [(1_000 + i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("shingles", [200_000, 700])
def test_components_equal_all_pairs(spark, monkeypatch, shingles):
    monkeypatch.setattr(setsketch, "OPEN", shingles)
    monkeypatch.setattr(setsketch, "OTHERS", 2 * shingles)
    texts = copies() + ROWS
    table = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_shingles int")
    assert rows(setsketch.near_duplicates(table), "doc_id", "n_shingles", "component_id", "kept") == classes(texts)


def test_sketch_of_awkward_documents(docs, empty):
    assert rows(setsketch.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == classes(ROWS)
    assert setsketch.near_duplicates(empty).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    for n, share in ((40, 0.5), (1_000, 0.8), (30_000, 0.9), (5_000, 0.1)):
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64) * np.uint64(2)
        k = int(n * share)
        a, b = pool[:n], np.concatenate([pool[:k], pool[n:2 * n - k]])
        ra, rb = setsketch.registers(a), setsketch.registers(b)
        assert (setsketch.merge(ra, rb) == setsketch.registers(np.union1d(a, b))).all()
        j = k / (2 * n - k)
        best, possible = setsketch.likelihood([(ra > rb).sum()], [(ra < rb).sum()], [n], [n], 0.8)
        assert abs(best[0] - j) < 5 * np.sqrt(j * (1 - j) / setsketch.REGISTERS) + 0.02
        assert possible[0] == (j > 0.6)


# ---- whitening ---------------------------------------------------------------

def exact(vectors):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(size)]
    cov = [[Fraction(sum((n * r[d] - s[d]) * (n * r[e] - s[e]) for r in x), n**3) for e in range(size)] for d in range(size)]
    return n, [sum((n * r[d] - s[d]) ** 2 for d in range(size)) for r in x], np.array(cov, float), np.array([[r[d] - s[d] / n for d in range(size)] for r in x])


@pytest.mark.parametrize("size,scale", [(12, 1.0), (5, 1e9), (3, 1e-5)])
def test_whitening_equals_exact_covariance(spark, size, scale):
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((size, size)) * scale
    vectors = (rng.standard_normal((700, size)) @ mix + 3).tolist()
    vectors[7] = vectors[8]
    odd = [(900, None), (901, [None, *[1.0] * (size - 1)]), (902, [float("nan")] * size), (903, [float("inf")] * size), (904, []), (905, [1.0])]
    table = spark.createDataFrame([(None if i == 5 else min(i, 698), v, 0) for i, v in enumerate(vectors)] + [(*o, 0) for o in odd],
                                  "vec_id long, embedding array<double>, component int").repartition(3)
    got = whitening.whitened_rows(table).collect()
    n, deviation, cov, centred = exact(vectors)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(8, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == 700 * k and {r["n"] for r in got} == {700}
    assert max(r["identity_error"] for r in got) == min(r["identity_error"] for r in got) <= 1e-4 or k == 0
    want = centred @ v[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        mine = sorted((r["whitened"], r["deviation"]) for r in got if r["component"] == c + 1)
        sign = np.sign(np.array([r["whitened"] for r in got if r["component"] == c + 1 and r["vec_id"] == 9]) * want[9, c])[0]
        theirs = sorted((sign * w, d if d < 2**63 else None) for w, d in zip(want[:, c].tolist(), deviation))
        assert np.allclose([m[0] for m in mine], [t[0] for t in theirs], atol=1e-6)
        assert Counter(m[1] for m in mine) == Counter(t[1] for t in theirs)
        assert all(abs(r["explained"] / (e[c] / e.sum()) - 1) < 1e-9 for r in got if r["component"] == c + 1)


def test_registered_whitening_of_the_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    x = np.array([np.floor(1024 * np.array(r["embedding"], np.float64)) for r in table]).astype(np.int64).astype(object) + 100_000
    n, s = len(x), x.sum(axis=0)
    away = n * x - s
    e, v = np.linalg.eigh(np.array(away.T @ away / n, float) / n**2)
    e, v = e[::-1], v[:, ::-1]
    got = {(r["vec_id"], r["component"]): r for r in registry.QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 8 * n
    want = np.array(away / n, float) @ v[:, :8] / np.sqrt(e[:8])
    for k in range(8):
        sign = np.sign(got[table[0]["vec_id"], k + 1]["whitened"] * want[0, k])
        for i, r in enumerate(table):
            g = got[r["vec_id"], k + 1]
            assert g["n"] == n and g["deviation"] == sum(a * a for a in away[i]) and abs(g["whitened"] - sign * want[i, k]) < 1e-6
            assert abs(g["explained"] / (e[k] / e.sum()) - 1) < 1e-4 and g["identity_error"] <= 1e-4


def test_whitening_without_scale(spark):
    schema = "vec_id long, embedding array<float>"
    for given in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None), (2, [])]):
        assert whitening.whitened_rows(spark.createDataFrame(given, schema)).count() == 0
    line = whitening.whitened_rows(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(70)], schema)).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-9


def test_planes_are_exact():
    rng = np.random.default_rng(6)
    for bits in ([3, 0, 61], [11] * 9, [0, 0], [1]):
        u = np.stack([rng.integers(0, 1 << b, 9_000) for b in bits], axis=1)
        planes = whitening.Planes(bits)
        for at in range(0, len(u), whitening.ROWS):
            planes.add(u[at:at + whitening.ROWS])
        big = u.astype(object)
        for d in range(len(bits)):
            assert sum(int(x) << whitening.LIMB * i for i, x in enumerate(planes.sums[:, d])) == sum(big[:, d])
            for e in range(d, len(bits)):
                assert sum(int(x) << whitening.LIMB * i for i, x in enumerate(planes.products[:, d, e])) == (big[:, d] * big[:, e]).sum()


# ---- spelling ----------------------------------------------------------------

def brute(texts):
    """The rows of op13 from all pairs of words."""
    c = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(x.lower() if x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            c[run] += 1
    c = {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    out = {}
    for w, n in c.items():
        others = [v for v in c if near(w, v)]
        best = min(others, key=lambda v: (-c[v], v), default=None)
        out[w] = (best if best and c[best] >= 2 * n else None, len(others))
    found = []
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        found.append((w, form, root, c[w], n_near, c[form] if form else None))
    return sorted(found, key=repr)


def misspelt():
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdeé", k=rng.randint(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Zébra", "x" * 300]
    out = []
    for i in range(60):
        words = []
        for _ in range(120):
            w = rng.choice(base[:1 + rng.randrange(len(base))])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "é" + w[k]]) + w[k + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", ", ", "-7-"]).join(words)))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("blocks", [1 << 21, 7])
def test_variants_equal_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(spelling, "PASS_BLOCKS", blocks)
    texts = misspelt() + (ROWS if blocks > 7 else [])
    table = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, word string").repartition(3)
    want = brute(texts)
    assert rows(spelling.variants(table), *COLUMNS) == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[1] is None for w in want)


def test_variants_of_nothing(spark, empty):
    assert rows(spelling.variants(empty), *COLUMNS) == []
    one = spark.createDataFrame([(1, "hello hello hello world"), (2, None)], "doc_id long, text string")
    assert rows(spelling.variants(one), *COLUMNS) == brute([(1, "hello hello hello world")])


def test_an_edit_has_the_hash_of_its_word():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(300)]
    known = {(int(spelling._hashes(codes)[1][k]), codes.shape[1]) for part, codes in spelling._by_length(words) for k in range(len(part))}
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint32)
    got = spelling.neighbours(words, alphabet, lambda h, n: np.isin(h, np.array([x for x, m in known if m == n], np.uint64)))
    pairs = {frozenset((words[r], e)) for r, e in zip(*got)}
    edits = lambda w: {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in "abcé"}
    assert pairs == {frozenset((w, e)) for w in words for e in edits(w) & set(words) if e != w}
