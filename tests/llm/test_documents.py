"""Operators on documents against brute force, on a table with every awkward case and on an empty one."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece as library
from pyspark.sql import functions as F

from wardfield.llm import language, lm, mixing, pieces, quality, registry, rules, simhash, substring
from wardfield.llm.common import fold, split_words

from . import data

ROWS = [(r[0], r[1]) for r in data.documents()]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def coder():
    model = registry.piece_model()
    with open(model, "rb") as f:
        return library.SentencePieceProcessor(model_file=model), pieces.Encoder(pieces.Vocabulary(f.read()))


def test_merge_rounds_equal_the_library(coder):
    sp, e = coder
    rng = random.Random(2)
    texts = ["", " ", "   a", "a" * 999, " " * 300, "▁ ▁▁x", "\n\t\0", "<s></s><0x0A>", "漢字🎉 ́é", "ababab" * 60]
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(1, 60))) for a in ["ab ", " ▁x", "the ing", "=-_ \n", "漢é a"] for _ in range(80)]
    got = e.encode(texts, True, True)
    assert [x.tolist() for x in got] == sp.encode(texts, add_bos=True, add_eos=True)
    assert [e.v.decode(x) for x in got] == [sp.decode(x.tolist()) for x in got]


def test_any_ids_decode_like_the_library(coder):
    sp, e = coder
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(400 if rng.random() < 0.7 else 32_000) for _ in range(rng.randrange(10))]
        assert e.v.decode(np.array(ids, np.int64)) == sp.decode(ids), ids


def test_encode_and_decode_rows(docs, empty, coder):
    sp, _ = coder
    model = registry.piece_model()
    got = pieces.decode(pieces.encode(docs, model), model).collect()
    assert len(got) == len(ROWS)
    assert all(r["ids"] == sp.encode(r["text"] or "", add_bos=True, add_eos=True) and r["decoded"] == (r["text"] or "") for r in got)
    assert rows(pieces.digests(docs.select("doc_id", "text"), model), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(
        ((r["doc_id"], len(r["ids"]), hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest(),
          hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got), key=repr)
    assert pieces.encode(empty, model).count() == 0


def test_simhash_components(docs, empty):
    prints = [simhash.fingerprint([w.lower() for w in data.words(t)], 3) for _, t in ROWS]
    want = sorted(((i, f - (1 << 64) if f >> 63 else f, c) for (i, _), f, c in zip(ROWS, prints, data.components(ROWS, prints))), key=repr)
    got = simhash.near_duplicates(docs)
    assert rows(got, "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [simhash.fingerprint([w.lower() for w in data.words(t)], 3) for _, t in ROWS]
    named = {c for c in data.components(ROWS, prints) if c is not None}
    assert sorted(r[0] for r in rows(kept, "doc_id") if r[0] is not None) == sorted(named)
    assert simhash.keep_one(empty).count() == 0


def test_postings_of_any_length_give_the_same_components(monkeypatch):
    rng = np.random.default_rng(4)
    near = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 24, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 24, 400).astype(np.uint64))
    fp = np.unique(np.r_[near, rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    mask = simhash.MASKS[-1]

    def parts(pairs):
        group = {int(x): int(x) for x in fp}

        def root(x):
            while group[x] != x:
                x = group[x]
            return x
        for a, b in pairs.tolist():
            group[root(a)] = root(b)
        return len({root(int(x)) for x in fp})

    inside = np.sort(fp[(fp & mask) == (near[0] & mask)])
    brute = np.array([(a, b) for i, a in enumerate(inside) for b in inside[:i] if np.bitwise_count(a ^ b) <= 3], np.uint64)
    assert parts(simhash._forest(inside, mask)) == parts(brute)
    monkeypatch.setattr(simhash, "LOOKUP", 10)
    assert parts(simhash._forest(inside, mask)) == parts(brute)


@pytest.mark.parametrize("crowd", [1, 1_000])
def test_substring_removal(docs, empty, crowd, monkeypatch):
    monkeypatch.setattr(substring, "CROWD", crowd)
    got = rows(substring.kept_digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == data.repeats(ROWS, 50)
    assert sum(r[2] for r in got) > 100
    assert substring.kept_digests(empty).count() == 0


def test_texts_without_repeats(docs, empty):
    left = substring.without_repeats(docs)
    assert left.columns == docs.columns
    want = sorted((i, h) for i, n, g, h in data.repeats(ROWS, 50) if i is not None and not 0 < n == g)
    got = sorted((r["doc_id"], hashlib.sha256(b" ".join(data.words(r["text"]))).hexdigest()) for r in left.collect() if r["doc_id"] is not None)
    assert got == want
    assert substring.without_repeats(empty).count() == 0


def test_language_learns_and_rejects(docs, empty, monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 12)
    net = language.train(language.training_words(docs.where("doc_id < 20"), "text", "lang", "doc_id"), epochs=12)
    got = {r["doc_id"]: r for r in language.identify(docs, net).collect() if r["doc_id"] is not None}
    assert all(got[i]["lang_pred"] == got[i]["lang"] for i in range(20, 24)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und"] * 4
    assert language.keep_known(docs, net, 0.3).columns == docs.columns
    assert language.learn(empty) is None and language.identify(empty, net).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_language_gradient():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], rng, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.integers(97, 123, (3, 6)).astype(np.uint8), np.array([0, 2, 1]), np.ones(3)

    def loss():
        p = net.labels(x)
        return -np.log(p[:, np.arange(3), y]).mean()

    grad = net.gradient(x, y, w)
    for name, at in (("uf", (1, 2)), ("nb", (0, 3)), ("out", (5, 1)), ("xf", (int(x[0, 2]), 3)), ("xb", (int(x[1, 4]), 9))):
        keep, step = net.p[name][at], 1e-3
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-4, name


def test_lm_scores(docs, empty):
    got = lm.score(docs, fold(F.col("doc_id"), 5) == 1).withColumn("base_score", F.round("base_score", 6))
    assert rows(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == sorted(data.base_scores(ROWS), key=repr)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.collect())
    assert lm.score(empty, F.lit(False)).count() == 0
    assert lm.score(docs, F.lit(True)).where("n_known > 0 or train_tokens > 0").count() == 0


def test_lm_probabilities_sum_to_one_and_follow_counts(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 1_500)
    triples = np.array([(a, b, 10 + b) for a in range(5) for b in range(5)] + [(a, b, 7) for a in range(5) for b in range(5)])
    table = lm.Model(triples, np.array([30.0] * 25 + [10.0] * 25)).table()
    assert np.allclose((10.0**table).sum(axis=1), 1, atol=1e-4)
    right = [10 ** table[a * (lm.CLASSES + 1) + b, 10 + b] for a in range(5) for b in range(5)]
    assert np.mean(right) > 0.4


def test_lm_score_is_the_sum_of_normalised_token_probabilities(docs, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 150)
    monkeypatch.setattr(lm, "STEPS", 50)
    monkeypatch.setattr(lm, "LEAST", 2)
    seen = {}
    inner = lm._score
    monkeypatch.setattr(lm, "_score", lambda head, counts, model, words: seen.update(model=model, words=words, head=head) or inner(head, counts, model, words))
    got = rows(lm.score(docs, fold(F.col("doc_id"), 5) == 1), "doc_id", "n_tokens", "score")
    table, words, place = seen["model"].table(), seen["words"], {w: i for i, w in enumerate(seen["head"])}
    held = [data.zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in ROWS]
    counts = data.Counter(w.lower() for (_, t), h in zip(ROWS, held) if not h for w in data.words(t))
    kind = lambda w: place[w] if place.get(w, lm.OWN) < lm.OWN else lm.ending(w)

    def word(w, before):
        """log10 probability of a word of a shared class inside it; None is an unknown word of class k."""
        own = place.get(w, -1) - lm.OWN
        factor = float(words.factor[own, before]) if 0 <= own < len(words.factor) else 0.0
        return np.log10(counts.get(w, 0) + 0.5) + factor

    want = []
    for i, t in ROWS:
        tokens = [w.lower() for w in data.words(t)]
        c = [kind(w) for w in tokens] + [lm.END]
        total = 0.0
        for k, x in enumerate(c):
            a, z = c[k - 2] if k > 1 else lm.START, c[k - 1] if k else lm.START
            total += float(table[a * (lm.CLASSES + 1) + z, x])
            if x > lm.END:
                total += word(tokens[k], z) - words.total[x, z]
        want.append((i, len(c), total))
    assert all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-4 * w[1] for g, w in zip(got, sorted(want, key=repr)))
    # The words of a class and one unknown word share its probability, after every class.
    assert len(words.factor) > 20 and np.abs(words.factor).max() > 0.05
    for z in (0, 5, lm.END, lm.START):
        sums = np.full(lm.CLASSES, 0.5)
        for w in counts:
            if kind(w) > lm.END:
                sums[kind(w)] += 10 ** word(w, z)
        assert np.allclose(np.log10(sums[lm.END + 1:]), words.total[lm.END + 1:, z], atol=1e-5)


def test_word_vectors_follow_contexts():
    rng = np.random.default_rng(3)
    contexts = np.eye(6)[rng.integers(0, 6, 40)]
    shares = np.full((3, 40), 1 / 40)
    counts = np.zeros((3, 40))
    counts[0] = 25.0  # spread like the noise: no factor
    counts[1] = np.where(contexts[:, 2] > 0, 100.0, 10.0)
    counts[2, 0] = 1.0
    factor = lm.word_vectors(counts, shares, contexts) @ contexts.T
    assert np.abs(factor[0]).max() < 0.01
    drawn = counts[1].sum() / 40
    assert np.allclose(factor[1], np.log(counts[1] / drawn), atol=0.1)
    assert np.isfinite(factor).all()


def test_rare_words_are_joined(docs, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 100)
    monkeypatch.setattr(lm, "STEPS", 20)
    got = lm.score(docs, fold(F.col("doc_id"), 5) == 1).withColumn("base_score", F.round("base_score", 6))
    assert rows(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == sorted(data.base_scores(ROWS), key=repr)


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(24)] + [(11, 0), (None, 0), (999, 1), (3, None)], "doc_id long, quality int")
    got, _ = rules.judge(docs, labels)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(got, "doc_id", *names) == sorted(((i, *data.counts(t)) for i, t in ROWS), key=repr)
    assert got.where("kept and (base_failed or rule > 0)").count() == 0
    assert rules.judge(empty, labels)[0].count() == 0
    none, found = rules.judge(docs, labels.where("false"))
    assert found == [] and none.where("kept = base_failed").count() == 0


def test_rules_find_a_planted_conjunction(spark):
    rng = random.Random(1)
    made = [tuple(rng.random() for _ in rules.STATISTICS) for _ in range(600)]
    at = [rules.STATISTICS.index(c) for c in ("symbol_share", "short_share")]
    full = [(*m, m[at[0]] > 0.6 and m[at[1]] < 0.4, i % 3 != 0) for i, m in enumerate(made)]
    table = spark.createDataFrame(full, ", ".join(f"{c} double" for c in rules.STATISTICS) + ", bad boolean, grow boolean")
    found = rules.learn(table)
    judged = table.withColumn("hit", rules.verdict(found) > 0)
    assert judged.where("hit and bad").count() > 0.8 * judged.where("bad").count()
    assert judged.where("hit and not bad").count() < 0.1 * judged.where("hit").count()


def test_weak_labels(docs, empty):
    got = {r["doc_id"]: r for r in quality.classify(docs).collect() if r["doc_id"] is not None}
    assert len(got) == len({i for i, _ in ROWS if i is not None})
    assert [got[i]["score"] for i in (100, 101, 102)] == [0.0] * 3
    assert got[11]["posterior"] < got[2]["posterior"]
    assert quality.classify(empty).count() == 0


def test_weak_label_rows_equal_a_plain_computation(docs, monkeypatch):
    seen = {}
    train, estimate = quality.train, quality.estimate
    monkeypatch.setattr(quality, "train", lambda r: seen.setdefault("weights", train(r)))
    monkeypatch.setattr(quality, "estimate", lambda p, n: seen.setdefault("good", (p, estimate(p, n)))[1])
    got = sorted(((r["doc_id"], r["text"], r["labellers"], r["posterior"], r["score"], r["kept"]) for r in quality.classify(docs).collect()), key=repr)
    weights, bias = seen["weights"]
    posterior = dict(zip(seen["good"][0].tolist(), seen["good"][1][0].tolist()))
    want = []
    for i, t in ROWS:
        w, lines = data.words(t), [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        n = max(1, len(w))
        m = {"words": len(w), "mean": sum(map(len, w)) / n, "symbols": sum(x in b"#*$%&|<>" for v in w for x in v) / n,
             "marked": sum(v[-1:] in b"!?#*$%&|<>" for v in w) / n, "capitals": sum(v.isupper() for v in w) / n, "short": sum(len(v) <= 3 for v in w) / n,
             "digits": sum(v[:1].isdigit() for v in w) / n, "dup_lines": 1 - len(set(lines)) / max(1, len(lines)), "distinct": len(set(w)) / n,
             "again": sum(a == b for a, b in zip(w, w[1:])) / n}
        votes = [label(m) for _, label in quality.LABELLERS]
        p = sum(v * 3 ** k for k, v in enumerate(reversed(votes)))
        if not w:
            want.append((i, t, 0, 0.0, 0.0, False))
            continue
        parts = [weights[b] for v in w for b in quality.buckets(v)]
        parts += [weights[quality.AGAIN if k and w[k] == w[k - 1] else quality.FRESH] for k in range(len(w))]
        score = 1 / (1 + np.exp(-(quality.SCALE * sum(parts) / len(parts) + bias)))
        want.append((i, t, sum(v != quality.NONE for v in votes), posterior[p], score, score >= 0.5))
    for g, x in zip(got, sorted(want, key=repr)):
        assert g[:3] == x[:3] and abs(g[3] - x[3]) < 1e-9 and abs(g[4] - x[4]) < 1e-9 and g[5] == x[5]


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    k = len(quality.LABELLERS)
    truth = rng.random(20_000) < 0.8
    flip = rng.random((20_000, k)) < 0.1
    votes = np.where(rng.random((20_000, k)) < 0.2, quality.NONE, (truth[:, None] ^ flip).astype(int))
    p, n = np.unique(votes @ 3 ** np.arange(k - 1, -1, -1), return_counts=True)
    good, table = quality.estimate(p, n)
    assert np.abs(table[:, quality.GOOD, quality.GOOD] - 0.9).max() < 0.03
    assert ((dict(zip(p.tolist(), good))[int(votes[0] @ 3 ** np.arange(k - 1, -1, -1))] > 0.5) == truth[0])


def _brute_mix(table, entropy, repeats):
    """Weights by plain bisection and pass counts of each source, from (source, tokens)."""
    p = {s: t / sum(table.values()) for s, t in table.items() if t}
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        times = max(x ** (a - 1) for x in p.values()) / min(x ** (a - 1) for x in p.values())
        low, high = (low, a) if times <= repeats else (a, high)
    z = sum(x**high for x in p.values())
    return {s: x**high / z for s, x in p.items()}, high


def test_mixing(docs, empty):
    plain = docs.drop("epoch").withColumn("n", F.size(split_words(F.col("text"))))
    tokens = {r["source"]: r["t"] for r in plain.groupBy("source").agg(F.sum("n").alias("t")).collect()}
    got = mixing.mix(plain, max_repeats=3.0)
    once = got.where("epoch = 0")
    assert rows(once, "doc_id", "text") == rows(plain, "doc_id", "text")  # nothing is lost
    weights, a = _brute_mix(tokens, None, 3.0)
    whole = max(t / weights[s] for s, t in tokens.items() if t)
    for r in got.groupBy("source").agg(F.sum("n").alias("t"), F.max("epoch").alias("e")).collect():
        if tokens[r["source"]]:
            want = whole * weights[r["source"]]
            assert r["e"] <= 3
            biggest = plain.where(F.col("source").eqNullSafe(r["source"])).agg(F.max("n")).first()[0]
            assert want - 2 * biggest - 1 <= r["t"] <= want + 1, (r, want)
    assert mixing.mix(empty.drop("epoch"), max_repeats=3.0).count() == 0
    natural = mixing.mix(plain, max_repeats=1.0)
    assert natural.count() == plain.count()


def test_mixing_meets_entropy_and_budget(spark):
    table = spark.createDataFrame([(i, s, "w " * 10) for s, n in (("a", 800), ("b", 150), ("c", 50)) for i in range(n)],
                                  "doc_id long, source string, text string")
    got = mixing.mix(table, entropy=0.9, budget=4_000.0)
    t = {r["source"]: r["count"] * 10 for r in got.groupBy("source").count().collect()}
    share = np.array(list(t.values())) / sum(t.values())
    assert 3_900 <= sum(t.values()) <= 4_000
    assert abs(-(share * np.log(share)).sum() / np.log(3) - 0.9) < 0.02
