"""Global statistics as one scalar subquery.

``global_stats(df, mn=F.min("v"), mx=F.max("v"))`` is a single aggregation job whose one-row result is
inlined as a literal struct; every ``.getField`` of it refers to the same subquery, which Spark executes once
(reused subquery). No join with the data and no driver round trip in user code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def global_stats(df: DataFrame, **aggs: Column) -> Column:
    return df.select(F.struct(*[agg.alias(name) for name, agg in aggs.items()])).scalar()
