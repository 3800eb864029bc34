"""From documents to packed training sequences, stage by stage.

Each stage takes the session, the rows that the one before kept, and the folder of the other tables;
its result is written as Parquet and read again as the next one's documents. The first three return
the columns of `documents`; the last returns the pieces of the packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import jaccard, packing, quality, tokens, toxicity
from ragloom.llm.prefix import written
from ragloom.session import table_path

VOCABULARY, END_ID, LENGTH = "byte_bpe_50k.json", 50256, 2048


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality: what the base rules and the learned decision list reject goes."""
    return quality.filtered(docs, spark.read.parquet(table_path(sf_dir, "labels")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: what ordinal regression grades as toxic goes."""
    return toxicity.filtered(docs, spark.read.parquet(table_path(sf_dir, "labels")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: of each group of linked documents the one with the smallest id stays."""
    return jaccard.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the token ids of all documents, cut into sequences."""
    return packing.pack(docs, tokens.public(VOCABULARY), END_ID, LENGTH)


STAGES = [("quality", good), ("toxicity", clean), ("near_duplicates", unique), ("packing", packed)]

#: Learned rules, weights and a tokenizer's ids are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
