"""Environmental time-series analytics as Spark DataFrame jobs.

Library functions take and return DataFrames; nothing here holds global state beyond the SparkSession.
"""

from envspark.session import get_spark, read_table, checkpoint_dir

__all__ = ["get_spark", "read_table", "checkpoint_dir"]
