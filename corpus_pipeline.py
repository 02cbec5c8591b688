"""The corpus pipeline: toxicity, exact dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it
kept, and returns a DataFrame with the columns of documents; the last returns
the pieces of packed sequences. Null and empty texts are texts like others: all
but one of them go in exact dedup. Rows without a doc_id are compared with none,
and stay; repeated rows of one doc_id and text stay together, as dedup decides by
doc_id. Extra columns, whatever their names, are kept up to packing. An empty
table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, near_dedup, packing, pii, toxicity
from quillon.llm.common import checkpointed, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in full training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]

#: SQL can't express toxicity, PII and packing; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES, one after the other, over documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
