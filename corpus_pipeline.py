"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns a DataFrame; it is written
as Parquet in the shared folder and read back as the next stage's docs. All stages but the last return the columns of
documents. No stage has an SQL form (fits, fingerprints, tokens), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from envspark.llm import packing, quality, secrets, simhash, toxicity
from envspark.llm.common import documents, labels, write_shared


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.good_only(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below its cut."""
    return toxicity.without_toxic(docs, labels(spark, sf_dir))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return simhash.keep_one(docs)


def secrets_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return secrets.without_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("secrets", secrets_replaced),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
