"""The corpus pipeline: quality, exact copies, near copies, mixing, encoding.

Each stage gets the documents that its predecessor kept, as a stored table,
and all but the last return documents with all their columns.

Nulls, empty and very long texts, ties, repeated rows, empty tables and columns
with clashing names are treated as the stages' operators state; rows without
words don't reach the mix, and a null identifier is kept like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import bpe, exact_dedup, minhash, mixing, quality
from spindrift.llm.common import Scratch


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, stored=True, with_ids=True)


STAGES = [("quality classifier", good), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mix), ("BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage{i}")
            if i:
                scratch.drop(f"stage{i - 1}")
    return docs


#: Learned and tokenizing stages can't be expressed in SQL; a test holds run() against a sequential rendering of all stages.
ORACLE_SQL = None
