"""Corpus pipeline: documents that the quality classifier rejects go, then those in no learned language, then all but one of each
group of near-duplicates; the rest is packed into sequences.

Each stage works on the whole table its predecessor kept and returns the columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldmeter.llm import dedup, language, packing, quality
from goldmeter.llm.common import stored, table, vocabulary

#: Words in a shingle of the near-duplicate stage; op7's contract of two binds that query only.
SHINGLE_WORDS = 5

#: The classifier's scores and the learned languages have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_named(docs, language.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.keep_one(docs, SHINGLE_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_classifier", good_quality), ("language_id", known_language), ("near_duplicates", one_of_each), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is stored and read again, so a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
