"""From raw documents to training tokens, one stage per operator.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``.  A stage works on what its predecessor kept.

All stages read texts whole, however long, keep columns that ``docs`` has besides,
whatever their name, and give an empty result for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, pulearn, samples, simhash, substring
from plumbline.plans.durable import materialise

VOCABULARY = "word_bpe_49k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as empty ones; repeated rows and rows without an id are
    judged each; without any positive label every score is 0.5 and nothing is kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = pulearn.train(docs, labels, samples.remainder(F.col("doc_id"), 4) != 2)
    return docs.where(pulearn.scores(docs["text"], model) >= pulearn.THRESHOLD)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, null ids last.

    Null and empty texts are one group; of repeated rows one stays.
    """
    return simhash.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier.

    Earlier is a smaller id, or an earlier word of the same id; null ids come last.
    """
    return substring.remove_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time a document is taken.

    Null and empty texts are never taken; a null source is a source; repeated rows count each.
    """
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and what they decode to; null texts count as empty."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), keep=("doc_id", "source"))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("substring dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]
#: The classifier and the tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
