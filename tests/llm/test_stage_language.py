"""What the language stage of the pipeline keeps and rejects."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from wardfield.llm import language

SHARED = "/root/testdata/sf0.001"


def test_clean_documents_stay_and_random_letters_go(spark):
    docs = spark.read.parquet(f"{SHARED}/documents.parquet")
    rng = random.Random(1)
    bad = [(10_000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(600))) for i in range(40)]
    bad += [(20_000, None), (20_001, ""), (20_002, "1234 --- ##")]
    rows = spark.createDataFrame(bad, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"),
                                                                       F.lit("bad").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(rows), "")
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = {r["doc_id"] for r in docs.where("text rlike '[a-zA-Z]{3}'").select("doc_id").collect()}
    assert len(clean - ids) <= 0.005 * len(clean)
    assert not ids & {20_000, 20_001, 20_002}
    assert sum(i >= 10_000 for i in ids) < 30
    assert language.UNKNOWN == "und"
