"""Vectors, conversations, components, and the registered queries against their SQL."""

import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from wardfield.llm import chat, fmindex, registry, topk
from wardfield.llm.graph import components

FOLDER = "/root/testdata/sf0.001"


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * (1 + i % 7)]) for i in range(300)]
    rows += [(50, rows[50][1]), (400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6),
             (450, [0.0] * 6), (500, []), (451, [3.0]), (452, rows[7][1]), (453, [1e5] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top(topk.integers(df)).collect())
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in fine if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)
    assert topk.top(topk.integers(df.where("false"))).count() == 0


def test_pruning_keeps_all_results():
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((500, 8)) * 200).astype(np.int64)
    q = v[:20]
    score = q @ v.T
    for k in (1, 5):
        least = np.sort(score - np.where(np.arange(20)[:, None] == np.arange(500), 10**9, 0), axis=1)[:, -k].astype(float)
        got = topk.search_block(np.arange(500), v, np.arange(20), q, least, k)
        assert len(got) == 20 * k and all(score[r, i] == s >= least[r] for r, i, s in got)


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "ok"),
         (2, 0, "user", "hi"), (2, 1, "assistant", "hello there, friend"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello there, friend"),
         (4, 0, "system", None), (4, None, None, "x"), (5, 0, "assistant", ""), (None, 0, "user", "lost"), (6, 0, "user", "hi"), (6, 0, "user", "hi")]


def test_preferences(spark):
    df = spark.createDataFrame([(*c, "clash") for c in CHATS], "conv_id long, turn long, role string, text string, chosen string")
    got = {(r["kind"], r["chosen_id"], r["rejected_id"]): r for r in chat.format_all(df).collect()}
    # Conversation 3 equals 2, so only 1 and 6 lose to it by opening; 4 and 6 have no assistant turn.
    assert set(got) == {("opening", 2, 1), ("opening", 2, 6), *(("stale", i, i) for i in (1, 2, 3))}
    r = got["opening", 2, 1]
    assert r["prompt_turns"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n"
    assert r["chosen"] == "<|assistant|>\nhello there, friend<|end|>\n" and r["chosen_mask"] == f"-14 +{len('hello there, friend') + 8}"
    assert got["stale", 1, 1]["rejected"] == "<|assistant|>\nhello<|end|>\n"
    assert got["stale", 2, 2]["rejected"] == "<|assistant|>\nhi<|end|>\n"
    assert chat.format_all(df.where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = list(range(60))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1000, 1000 + i) for i in range(1, 80)] + [(2000, 2001), (2001, 2000), (3000, 3000)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [2, 60, 80]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_index_answers_backward_search():
    rng = np.random.default_rng(2)
    window = 4
    passages = [rng.integers(0, 5, rng.integers(4, 9)).astype(np.uint64) for _ in range(60)]
    owners = rng.integers(0, 40, 60)
    index = fmindex.Index(passages, owners, window)
    first = {}
    for p, o in zip(passages, owners):
        for s in range(len(p) - window + 1):
            k = tuple(p[s:s + window])
            first[k] = min(first.get(k, o), o)
    other = [rng.integers(0, 7, 8).astype(np.uint64) for _ in range(40)]  # some windows aren't in the index
    for got, p in zip(index.owners_of(passages + other), passages + other):
        assert got.tolist() == [first.get(tuple(p[s:s + window]), -1) for s in range(len(p) - window + 1)]


@pytest.mark.parametrize("window", [2, 4, 5, 50])
@pytest.mark.parametrize("copies", [1, 2])
def test_index_of_one_short_passage(window, copies):
    for size in range(window, 2 * window + 1):
        for words in (np.arange(size), np.full(size, 9)):  # fewer symbols than the widest step of the suffix order
            passages = [words.astype(np.uint64)] * copies
            index = fmindex.Index(passages, np.arange(copies)[::-1] + 3, window)
            assert [x.tolist() for x in index.owners_of(passages)] == [[3] * (size - window + 1)] * copies


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, FOLDER), con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=repr)
    assert got and got == sorted(want.fetchall(), key=repr)


def test_pipeline(spark, docs, empty, monkeypatch):
    from wardfield.llm import language
    from wardfield.state import written

    monkeypatch.setattr(language, "EPOCHS", 2)
    left, last = docs, None
    for name, stage in corpus_pipeline.STAGES:
        last, left = left, written(stage(spark, left, ""), name)
        if name != "sentencepiece":
            assert left.columns == docs.columns, name
    assert left.where("not round_trip").count() == 0 and left.count() == last.count() > 20
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
