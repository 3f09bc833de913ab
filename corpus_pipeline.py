"""A small training-data pipeline: toxic documents go, near-duplicates go, sources are mixed, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionweave.llm import mixing, neardup, packing, toxicity
from ionweave.llm.common import prepared
from ionweave.llm.tokens import vocabulary
from ionweave.session import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity, learnt from the labels of the documents at hand."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id."""
    prepared(spark)
    return neardup.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepared(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens."""
    prepared(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

# Learning, signatures and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
