"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardfield.llm import language, mixing, pieces, registry, simhash, substring
from wardfield.llm.common import new_name
from wardfield.state import written

#: A document is rejected if its language is unknown or its mean probability is less than this share of the way from equal
#: probabilities to certainty: 0.4 for four languages. At sf0.01 no document lies below it (the least has 0.44, one in a hundred less
#: than 0.71); of strings of random letters two thirds do, of texts shuffled from several languages one in six.
SURE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without a letter and texts in no learned language go."""
    net = language.learn(docs)
    equal = 1 / len(net.languages) if net else 1.0
    return language.keep_known(docs, net, equal + SURE * (1 - equal))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints, as ``op5_simhash`` links them: three words, three bits."""
    return simhash.keep_one(docs, width=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more stay in the document with the smallest id; ``n_chars`` follows the text."""
    left = substring.without_repeats(docs)
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources repeat, up to the production limits of the mixture.

    The rows are ordered by block, scattered inside one, so that the files written from them hold the sources at their weights
    throughout and passes over a source don't leave as neighbours.
    """
    epoch, block = new_name(docs, "epoch"), new_name(docs, "block")
    mixed = mixing.mix(docs, **registry.MIXTURE, epoch=epoch, block=block)
    order = [F.col(block), F.xxhash64(F.col(epoch), F.col("doc_id"), F.xxhash64("text"))]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with begin and end, their number, and whether they decode to the text."""
    coded = pieces.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), registry.piece_model())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Neural predictions, fingerprints and encodings have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
