"""Hourly partials follow their table, partition by partition, and the outputs made of them equal those made of rows."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from envspark import binding as B
from envspark.operators import partials as P
from envspark.operators import queries as Q
from envspark.operators import timeseries as A
from envspark.plans.load_job import load_measurements
from envspark.sources import versions as V


def test_refresh_makes_only_changed_partitions_anew(spark):
    work = tempfile.mkdtemp(prefix="partials-", dir="/tmp")
    table, parts = os.path.join(work, "table"), os.path.join(work, "hourly")
    assert P.refresh(spark, table, parts) == 0
    h = B.hourly(spark, SMALL)
    load_measurements(spark, h, table)
    n = P.refresh(spark, table, parts)
    assert n == len(V.manifest(spark, table)["partitions"]) > 3 and P.refresh(spark, table, parts) == 0
    load_measurements(spark, h.where("variable_code = 'O3'").withColumn("value", F.col("value") + 1), table)
    assert P.refresh(spark, table, parts) == len([p for p in V.manifest(spark, table)["partitions"] if p["values"][0] == "O3"])
    total = lambda df, n, s: tuple(round(x, 6) for x in df.agg(F.sum(n), F.sum(s)).first())
    facts = V.read(spark, table).withColumn("one", F.lit(1))
    assert total(V.read(spark, parts), "n", "s") == total(facts, "one", "value")


@pytest.mark.parametrize("agg", ["avg", "sum", "min", "max"])
def test_series_of_partials_equal_series_of_rows(spark, agg):
    m = B.measurements(spark, SMALL)
    parts = P.hourly(m)
    for granularity, series in (("day", "station_code"), ("hour", None), ("year", "variable_code")):
        rounded = lambda df: sorted((r.bucket, r.series, round(r.value * 1e4), r.n) for r in df.collect())
        assert rounded(P.resample(parts, granularity, series, agg)) == rounded(A.resample(m, granularity, series, agg))
    with pytest.raises(ValueError):
        P.resample(parts, "day", agg="median")


def test_summary_of_no_rows(spark):
    none = P.hourly(B.measurements(spark, SMALL).limit(0))
    assert tuple(P.summary_trend(none, P.resample(none, "day")).first()) == (0, 0.0, 0.0, 0.0, "Stable")


@pytest.mark.parametrize("low,high", [(0, 100), (25, 60), (80, 20), (-5, 140), (33.3, 66.6), (50, 50)])
def test_zoom_columns_equal_zoomed_days(spark, low, high):
    from datetime import date

    spans = [(date(2024, 1, 1), date(2024, 1, 31)), (date(2023, 12, 31), date(2024, 3, 1)), (date(2024, 1, 1), date(2024, 1, 1)),
             (date(2024, 2, 1), date(2024, 1, 1))]
    df = spark.createDataFrame(spans, "f date, l date")
    got = df.select("f", "l", *Q.zoom_bounds(F.col("f"), F.col("l"), low, high)).collect()
    assert [(r[2], r[3]) for r in got] == [Q.zoomed_days(f, last, low, high) for f, last in spans]
    assert Q.zoomed_days(None, date(2024, 1, 1), low, high) == (None, date(2024, 1, 1))
