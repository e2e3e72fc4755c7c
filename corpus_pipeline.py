"""The corpus pipeline: toxic documents, copies, near copies and benchmark passages go, and the rest is packed.

Each stage works on all rows that the one before left; all but the last keep the columns of ``documents`` as they are, whatever other
columns there are. Null texts count as empty. An empty table goes through all stages and gives an empty result; without labels nothing
is toxic, and without a benchmark nothing is hit. Very long texts are taken whole everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnledger.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from turnledger.llm.queries import vocabulary
from turnledger.llm.text import read_table
from turnledger.session import ship_package, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 2 scores under its threshold; it learns from the labels of this table's documents. Null and empty texts stay;
    repeated rows stay or go together."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id (a null id after all others); of identical rows, one. Null and empty texts are one text."""
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8; the one with the smallest id. Texts without
    words stay; rows that share an id and a text stay or go together."""
    ship_package(spark)
    return near_dedup.keep_one(docs, size=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of ten words, or a whole shorter item. Texts without words stay."""
    ship_package(spark)
    return decontaminate.drop_hit(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, and their places; a document without text is one piece of one token."""
    ship_package(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), limit=2048)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontaminate", drop_benchmark), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the learned toxicity scores or the tokenizer; tests/llm compares with brute force instead.
ORACLE_SQL = None
