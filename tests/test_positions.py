"""Positional values by refinement, as-of alignment and crossed variables against plain models."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from envspark.operators import features as M
from envspark.operators import positions as P
from envspark.operators import timeseries as A


def sort_key(v):
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)


@pytest.mark.parametrize("ranked,bins", [(10_000, 1024), (5, 4), (0, 2)])
def test_positional_values_equal_a_sort(spark, monkeypatch, ranked, bins):
    monkeypatch.setattr(P, "RANKED", ranked)
    monkeypatch.setattr(P, "BINS", bins)
    r = random.Random(ranked)
    series = {"hot": [r.gauss(0, 1) for _ in range(300)], "ties": [r.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(60)], "one": [3.5],
              "flat": [7.0] * 40, "scales": [r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300) for _ in range(80)],
              "odd": [None, None, math.nan, math.inf, -math.inf, 1.0, 2.0, math.nan, math.inf], "nulls": [None] * 4,
              "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 5e-324]}
    df = spark.createDataFrame([(s, v) for s, vs in series.items() for v in vs], "s string, v double").repartition(6)
    n = F.col("n")
    asked = {"q1": F.floor(n * 0.25), "q3": F.floor(n * 0.75), "first": F.lit(0), "last": n - 1, "beyond": n}
    got = {x.series: x for x in P.positional_values(df, "s", F.col("v"), asked).collect()}
    assert set(got) == set(series)
    for s, vs in series.items():
        order, k = sorted(vs, key=sort_key), len(vs)
        want = [order[k // 4], order[math.floor(k * 0.75)], order[0], order[-1], None]
        assert got[s].n == k
        for a, b in zip((got[s].q1, got[s].q3, got[s].first, got[s].last, got[s].beyond), want):
            assert a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b)), (s, got[s], want)


def test_no_window_over_a_whole_series(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 20)
    points = spark.range(5000).select(F.lit("overall").alias("series"), F.col("id").cast("string").alias("bucket"),
                                      (F.hash("id") % 1000).cast("double").alias("value"))
    out = A.iqr_anomalies(points)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan  # of the ranges of 20 rows only
    values = sorted(r.value for r in out.collect())
    q1, q3 = values[1250], values[3750]
    assert out.agg(F.max("upper"), F.min("lower")).first() == (q3 + 1.5 * (q3 - q1), q1 - 1.5 * (q3 - q1))


@pytest.mark.parametrize("ratio", [0.0, 0.5, 0.8, 1.0])
def test_chronological_split(spark, ratio):
    at = datetime(2024, 1, 1)
    rows = [(s, at + timedelta(minutes=k * 7)) for s, n in (("a", 31), ("b", 1), ("c", 10)) for k in range(n)]
    got = M.chrono_split(spark.createDataFrame(rows, "station_id string, bucket timestamp_ntz"), ratio).collect()
    train = defaultdict(list)
    for r in got:
        train[r.station_id].append((r.bucket, r.split))
    for s, n in (("a", 31), ("b", 1), ("c", 10)):
        assert [x for _, x in sorted(train[s])] == ["train"] * math.floor(n * ratio) + ["test"] * (n - math.floor(n * ratio))


def test_as_of_takes_the_last_earlier_row_within_the_tolerance(spark):
    r = random.Random(5)
    at = datetime(1969, 12, 31, 20)
    rows = [(s, at + timedelta(seconds=r.randint(0, 40_000)), r.choice(["VEL", "DIR", "DIR", "CO"]), r.choice([None, *range(9)]), k)
            for k, s in enumerate(r.choices(["a", "b", "b", None], k=700))]
    rows = [(s, t, c, None if v is None else float(v), k) for s, t, c, v, k in rows]
    df = spark.createDataFrame(rows, "station_id string, observed_at timestamp_ntz, variable_code string, value double, measurement_id int")
    got = sorted((x.station_id, x.observed_at, x.left, x.right) for x in A.as_of(df, "VEL", "DIR", 300).collect())
    want = []
    for s, t, c, v, _ in rows:
        if s and c == "VEL" and v is not None:
            earlier = [(t2, k2, v2) for s2, t2, c2, v2, k2 in rows
                       if s2 == s and c2 == "DIR" and v2 is not None and t2 <= t and (t - t2).total_seconds() <= 300]
            if earlier:
                want.append((s, t, v, max(earlier)[2]))
    assert got == sorted(want) and 30 < len(want)


def test_variables_are_crossed(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, "NO2", at, 1.0), (1, "NO2", at + timedelta(minutes=5), 3.0), (2, "O3", at, 10.0), (2, "NO2", at, 4.0), (2, "O3", at + timedelta(hours=1), 5.0)]
    m = spark.createDataFrame(rows, "station_id int, variable_code string, observed_at timestamp_ntz, value double")
    pairs = spark.createDataFrame([(1, 2, 3.5)], "a int, b int, distance_km double")
    got = sorted(tuple(r) for r in A.crossed_variables(m, pairs).collect())
    assert got == [(1, 2, 3.5, "NO2", "NO2", 1, 2.0, 4.0, 2.0), (1, 2, 3.5, "NO2", "O3", 1, 2.0, 10.0, 8.0)]
