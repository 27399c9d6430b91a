"""Stages of the pipeline against brute force, and the names they must not touch."""

import random

import corpus_pipeline
import pytest

from wardfield.llm import mixing, simhash

from . import data

ROWS = [(r[0], r[1]) for r in data.documents()]


def test_near_duplicate_stage_equals_brute_force(spark, docs, empty):
    rng = random.Random(9)
    base = [w.decode() for w in data.words(ROWS[4][1])]
    texts = list(ROWS)
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(len(words)), i % 4):
            words[at] = "changed"
        texts.append((200 + i, " ".join(words)))
    table = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts], "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert kept.columns == table.columns
    prints = [simhash.fingerprint([w.lower() for w in data.words(t)], 3) for _, t in texts]
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == sorted({c for c in data.components(texts, prints) if c is not None})
    assert corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0


def test_mixture_keeps_columns_with_its_names(spark, docs):
    marked = docs.selectExpr("doc_id", "text", "source", "77 AS epoch", "88 AS block")
    got = corpus_pipeline.mix_sources(spark, marked, "")
    assert got.columns == marked.columns
    assert {(r["epoch"], r["block"]) for r in got.select("epoch", "block").distinct().collect()} == {(77, 88)}
    with pytest.raises(ValueError, match="block"):
        mixing.mix(marked, max_repeats=2.0, epoch="fresh")


def test_mixture_leaves_in_block_order(spark, docs, tmp_path):
    base = docs.select("doc_id", "text", "source")
    order = {}
    for r in mixing.mix(base, **corpus_pipeline.registry.MIXTURE).collect():
        order.setdefault((r["doc_id"], r["text"], r["source"]), []).append(r["block"])
    left = [tuple(r) for r in corpus_pipeline.mix_sources(spark, base, "").collect()]  # partitions come in range order
    assert sorted(left, key=repr) == sorted((k for k, b in order.items() for _ in b), key=repr)
    seen: dict = {}
    at = []
    for r in left:
        seen[r] = seen.get(r, 0) + 1
        at.append(sorted(order[r])[seen[r] - 1])
    assert at == sorted(at)
