"""Helpers shared by the operators: table reading, lower-casing of A-Z, batches of texts, and shared-folder cuts."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.session import checkpoint_dir, read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")


def lower_az(c: Column) -> Column:
    """Only A-Z become lower case; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir`` and read back: what follows does not depend on executors."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def python_texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]
