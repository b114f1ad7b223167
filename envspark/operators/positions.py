"""Exact values at positions of a series (A13 quartiles, M4 cuts) without sorting the series.

The value at 0-based position p of a sorted series is found by histogram refinement: the rows between the smallest and the
largest candidate are counted in BINS bins of equal width (partial counts in every task, so a series with a third of all rows
is spread like any other), the bin that holds the position becomes the new range with its own smallest and largest value,
and so on until a range has RANKED rows at most or a single value. Only such ranges are ranked. The counts, not the rows,
decide how many rounds it takes; a series of RANKED rows at most takes none.

Order: nulls, -infinity, finite values, infinity, NaN, as Spark sorts. Positions beyond the last row have no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark.session import cut_lineage

BINS, RANKED = 1024, 10_000
_INF = float("inf")


def _class(v: Column) -> Column:
    """0 to 4: null, -infinity, finite, infinity, NaN."""
    return (F.when(v.isNull(), 0).when(F.isnan(v), 4).when(v == -_INF, 1).when(v == _INF, 3).otherwise(2))


def _in_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The finite rows of the series of ``ranges`` that lie in them. A range is a row a series and target at most; Spark
    broadcasts them if they are few, else splits a large series over tasks (skew join)."""
    return rows.join(ranges, "series").where(F.col("v").between(F.col("lo"), F.col("hi")))


def _refined(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """One round: the bin of each range that holds its position."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    share = F.when(hi - lo < _INF, (v - lo) / (hi - lo)).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
    place = F.floor(share * BINS)
    bins = _in_ranges(rows, wide).withColumn("bin", F.least(place, F.lit(BINS - 1)))
    bins = bins.groupBy("series", "name", "pos", "bin").agg(
        F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    up_to = F.sum("c").over(Window.partitionBy("series", "name").orderBy("bin"))  # BINS rows at most
    hit = bins.withColumn("before", up_to - F.col("c")).where(
        (F.col("before") <= F.col("pos")) & (F.col("pos") < F.col("before") + F.col("c")))
    return hit.select("series", "name", (F.col("pos") - F.col("before")).alias("pos"), "c", "lo", "hi")


def positional_values(df: DataFrame, series: str, value: Column, positions: dict[str, Column]) -> DataFrame:
    """(series, n, one column per name): the value at each 0-based position, given as an expression of the row count ``n``."""
    rows = df.select(F.col(series).alias("series"), value.cast("double").alias("v")).withColumn("k", _class(F.col("v")))
    counts = [F.count_if(F.col("k") == c).alias(f"k{c}") for c in range(5)]
    finite = F.when(F.col("k") == 2, F.col("v"))
    whole = cut_lineage(rows.groupBy("series").agg(F.count("*").alias("n"), *counts, F.min(finite).alias("lo"), F.max(finite).alias("hi")))
    rows = rows.where("k = 2").select("series", "v")
    asked = F.array(*[F.struct(F.lit(name).alias("name"), at.cast("bigint").alias("pos")) for name, at in positions.items()])
    targets = whole.select("*", F.explode(asked).alias("t")).select("series", "t.name", F.col("t.pos").alias("at"), *[f"k{c}" for c in range(5)],
                                                                   "lo", "hi")
    below = F.col("k0") + F.col("k1")
    odd = F.when(F.col("at") < F.col("k0"), None).when(F.col("at") < below, -_INF).when(
        F.col("at") < below + F.col("k2") + F.col("k3"), _INF).when(
        F.col("at") < below + F.col("k2") + F.col("k3") + F.col("k4"), float("nan"))
    inside = (F.col("at") >= below) & (F.col("at") < below + F.col("k2"))
    answers = targets.where(~inside).select("series", "name", odd.alias("v"))
    open_ = targets.where(inside).select("series", "name", (F.col("at") - below).alias("pos"), F.col("k2").alias("c"), "lo", "hi")
    is_wide = (F.col("c") > RANKED) & (F.col("lo") < F.col("hi"))
    while not open_.where(is_wide).isEmpty():
        open_ = cut_lineage(open_.where(~is_wide).unionByName(_refined(rows, open_.where(is_wide))))
    single = open_.where("lo = hi").select("series", "name", F.col("lo").alias("v"))
    # targets of one range share its ranking
    ranges = open_.where("lo < hi").groupBy("series", "lo", "hi").agg(F.collect_set("pos").alias("wanted"))
    by_value = Window.partitionBy("series", "lo", "hi").orderBy("v")  # RANKED rows at most
    ranked = _in_ranges(rows, ranges).withColumn("pos", (F.row_number().over(by_value) - 1).cast("bigint")).where(
        F.array_contains("wanted", F.col("pos"))).select("series", "lo", "hi", "pos", "v")
    found = open_.where("lo < hi").join(ranked, ["series", "lo", "hi", "pos"]).select("series", "name", "v")
    every = answers.unionByName(single).unionByName(found)
    wide = every.groupBy("series").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in positions])
    return whole.select("series", "n").join(wide, "series", "left")
