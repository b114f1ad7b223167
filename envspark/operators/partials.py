"""Hourly partials: one row per (station, variable, hour) with n, sum, min, max and sum of squares.

Everything that a mean, sum, minimum or maximum over hours or coarser buckets needs is in them, so the time-series outputs
of an analysis read a table that is smaller than the facts by the number of measurements an hour. ``hourly`` makes them from
rows; ``refresh`` keeps them beside a load table: it makes the partials of those (variable, month) partitions anew whose
folder is not the one they were made of, so a load costs what it changed, and a run that failed between the two tables is
made good by the next. The functions below are A1, A4, A7, A9, A11 and A21 of ``timeseries``, with equal results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark import vocab
from envspark.functions.timefmt import bucket_key, day_string, truncate_hour, weekday_index, weekday_name
from envspark.operators import timeseries as A
from envspark.sources import versions as V

PARTITIONS = ["variable_code", "observed_month"]
COLUMNS = ["station_code", "variable_code", "hour", "n", "s", "mn", "mx", "ss"]


def hourly(rows: DataFrame, ts: str = "observed_at", value: str = "value") -> DataFrame:
    """The partials of measurement rows; nulls among the values are not counted."""
    v = F.col(value)
    return rows.groupBy("station_code", "variable_code", truncate_hour(ts).alias("hour")).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.min(v).alias("mn"), F.max(v).alias("mx"), F.sum(v * v).alias("ss"))


def refresh(spark: SparkSession, table: str, partials: str) -> int:
    """Brings the partials of a load table up to date; returns how many partitions were made anew."""
    facts = V.manifest(spark, table)
    if facts is None:
        return 0
    held = V.manifest(spark, partials) or {"version": 0, "partitions": []}
    made_of = {json.dumps(p["values"]): p for p in held["partitions"]}
    current = {json.dumps(p["values"]): p["folder"] for p in facts["partitions"]}
    stale = [p for p in facts["partitions"] if made_of.get(json.dumps(p["values"]), {}).get("of") != p["folder"]]
    if not stale and set(made_of) <= set(current):
        return 0
    columns = V.read(spark, table).select("station_code", *PARTITIONS, "observed_at", "value").schema
    rows = hourly(V.read_parts(spark, table, columns, stale)).withColumn("observed_month", F.trunc(F.to_date("hour"), "month"))
    rows = rows.hint("rebalance", *[F.col(c) for c in PARTITIONS]).sortWithinPartitions("station_code", "hour")
    schema, fresh = V.write_data(rows, partials, PARTITIONS)
    again = {json.dumps(p["values"]) for p in stale}
    kept = [p for k, p in made_of.items() if k in current and k not in again]
    V.publish(spark, partials, PARTITIONS, schema, kept + [p | {"of": current[json.dumps(p["values"])]} for p in fresh], held["version"])
    return len(stale)


def _mean() -> Column:
    return F.sum("s") / F.sum("n")


def resample(parts: DataFrame, granularity: str, series: str | None = "variable_code", agg: str = "avg",
             with_overall: bool = True) -> DataFrame:
    """A1 from partials."""
    if agg not in ("avg", "sum", "min", "max"):
        raise ValueError("agg must be avg, sum, min or max")
    how = {"avg": _mean(), "sum": F.sum("s"), "min": F.min("mn"), "max": F.max("mx")}[agg].alias("value")
    key = bucket_key("hour", granularity).alias("bucket")
    over = parts.groupBy(key).agg(how, F.sum("n").alias("n")).select("bucket", F.lit(A.OVERALL).alias("series"), "value", "n")
    if series is None:
        return over
    out = parts.groupBy(key, F.col(series).cast("string").alias("series")).agg(how, F.sum("n").alias("n")).select(
        "bucket", "series", "value", "n")
    return out.unionByName(over) if with_overall else out


def station_means(parts: DataFrame, station: str = "station_code") -> DataFrame:
    """A4 from partials."""
    return parts.groupBy(station).agg(_mean().alias("avg_value"), F.sum("n").alias("n")).orderBy(
        F.col("avg_value").desc(), F.col(station))


def heatmap(parts: DataFrame, n_days: int = vocab.HEATMAP_DAYS) -> DataFrame:
    """A7 from partials: the last days are found first, so only their partials are summed."""
    days = parts.select(day_string("hour").alias("day")).distinct().orderBy(F.col("day").desc()).limit(n_days)
    cells = parts.withColumn("day", day_string("hour")).join(F.broadcast(days), "day", "left_semi")  # n_days rows
    return cells.groupBy("day", F.hour("hour").alias("hour")).agg(_mean().alias("mean_value"), F.sum("n").alias("n"))


def summary_trend(parts: DataFrame, points: DataFrame) -> DataFrame:
    """A9 from partials: the summary over their sums, the trend as ``timeseries.summary_trend`` finds it."""
    ends = points.where(F.col("series") == A.OVERALL).agg(
        F.min_by("value", "bucket").alias("first"), F.max_by("value", "bucket").alias("last"), F.count("*").alias("k"))
    stats = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.coalesce(_mean(), F.lit(0.0)).alias("mean"),
                      F.coalesce(F.min("mn"), F.lit(0.0)).alias("min"), F.coalesce(F.max("mx"), F.lit(0.0)).alias("max"))
    g = ends.select(F.struct("first", "last", "k")).scalar()
    moved = g.getField("last") - g.getField("first")
    enough = F.abs(moved) > F.greatest(F.lit(0.05), F.abs(F.col("mean")) * 0.02)
    trend = F.when((F.col("samples") > 0) & (g.getField("k") >= 2) & enough,
                   F.when(moved > 0, F.lit("Rising")).otherwise(F.lit("Falling"))).otherwise(F.lit("Stable"))
    return stats.withColumn("trend", trend)


def seasonal_profile(parts: DataFrame, mode: str) -> DataFrame:
    """A11 from partials."""
    keys = {"weekday": (weekday_name("hour"), weekday_index("hour")), "month": (F.lpad(F.month("hour").cast("string"), 2, "0"), F.month("hour")),
            "hour": (F.lpad(F.hour("hour").cast("string"), 2, "0"), F.hour("hour"))}
    if mode not in keys:
        raise ValueError("mode must be weekday, month or hour")
    key, order = keys[mode]
    return parts.groupBy(key.alias("bucket"), order.alias("sort_key")).agg(_mean().alias("value"), F.sum("n").alias("n"))


def diurnal_composite(parts: DataFrame, variables: list[str], block_hours: int = 4) -> DataFrame:
    """A21 from partials."""
    block = (F.floor(F.hour("hour") / block_hours) * block_hours).cast("int").alias("block")
    of = lambda c, v: F.sum(F.when(F.col("variable_code") == v, F.col(c)))
    return parts.groupBy(block).agg(*[(of("s", v) / of("n", v)).alias(v) for v in variables])
