"""Corpus pipeline: quality, exact duplicates, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it again as the next
stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm.common import read_table, written
from panelkit.llm.exact_dedup import keep_first
from panelkit.llm.mixing import mix_documents
from panelkit.llm.quality import keep_good
from panelkit.llm.sentencepiece_trie import encode_documents
from panelkit.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (the largest id)."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (the smallest id)."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes (0 to 3)."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    return encode_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("sentencepiece", tokens)]

#: the classifier's fit and the tokeniser have no SQL form; tests/llm checks the rows by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
