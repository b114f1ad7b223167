"""The analytics job contract (metric, stations, date range, aggregation -> typed result).

Result types: ``timeseries`` (bucket start, mean), ``distribution`` (A6 histogram), ``correlation_matrix``
(A18 over the selected stations, hourly aligned) and ``trend`` (least-squares slope per day plus the A9 label).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.functions.timefmt import truncate_hour, week_start
from envspark.operators import timeseries as A

# Contract metric -> variable code.
METRICS = {"pm25": "PM25", "pm10": "PM10", "o3": "O3", "no2": "NO2", "so2": "SO2", "co": "CO",
           "temperature": "TMP", "humidity": "HUM"}
AGGREGATIONS = ("hourly", "daily", "weekly", "monthly")


def bucket_start(ts: Column | str, aggregation: str) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    if aggregation == "hourly":
        return truncate_hour(t)
    if aggregation == "daily":
        return F.to_date(t).cast("timestamp_ntz")
    if aggregation == "weekly":
        return week_start(t).cast("timestamp_ntz")
    if aggregation == "monthly":
        return F.trunc(F.to_date(t), "month").cast("timestamp_ntz")
    raise ValueError(f"aggregation must be one of {AGGREGATIONS}")


def ntz_literal(value: datetime) -> Column:
    """A naive datetime as a TIMESTAMP_NTZ literal (a Python datetime literal would be zoned)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def select_rows(facts: DataFrame, metric: str, station_codes: list[str] | None, date_from: datetime,
                date_to: datetime) -> DataFrame:
    code = METRICS[metric]
    rows = facts.where((F.col("variable_code") == code) & (F.col("observed_at") >= ntz_literal(date_from))
                       & (F.col("observed_at") <= ntz_literal(date_to)))
    if station_codes:
        rows = rows.where(F.col("station_code").isin(list(station_codes)))
    return rows


def run_contract(facts: DataFrame, metric: str, station_codes: list[str] | None, date_from: datetime,
                 date_to: datetime, aggregation: str, result_type: str = "timeseries") -> DataFrame:
    rows = select_rows(facts, metric, station_codes, date_from, date_to)
    if result_type == "timeseries":
        return (rows.groupBy(bucket_start("observed_at", aggregation).alias("timestamp"))
                .agg(F.avg("value").alias("value"), F.count("*").alias("n")))
    if result_type == "distribution":
        return A.histogram(rows)
    if result_type == "trend":
        daily = A.resample(rows, "day", None).select("bucket", "series", "value")
        slope = A.trend_slope(daily)
        label = A.summary_trend(rows, daily.withColumn("series", F.lit(A.OVERALL)))
        g = slope.select(F.struct("slope", "n")).scalar()
        return label.select("samples", "mean", "trend", g.getField("slope").alias("slope"),
                            g.getField("n").alias("n_days"))
    if result_type == "correlation_matrix":
        wide = facts.where(F.col("observed_at").between(ntz_literal(date_from), ntz_literal(date_to)))
        if station_codes:
            wide = wide.where(F.col("station_code").isin(list(station_codes)))
        present = sorted(set(METRICS.values()))
        return A.correlation_matrix(wide, present, ["station_code"], "hour")
    raise ValueError("result_type must be timeseries, distribution, correlation_matrix or trend")
