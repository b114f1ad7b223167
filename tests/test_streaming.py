"""Streaming ingest is incremental and idempotent: two files arriving in two runs give the batch result;
re-running with nothing new changes nothing."""

import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from envspark import catalog
from envspark.functions.timefmt import truncate_hour
from envspark.operators import load as L
from envspark.sources import versions as V
from envspark.streaming import ingest as STR


def test_two_arrivals_equal_one_batch(spark):
    work = tempfile.mkdtemp(prefix="envspark-stream-", dir="/tmp")
    src = os.path.join(work, "in")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    half = events.select(F.max("event_id")).first()[0] // 2
    events.where(F.col("event_id") <= half).coalesce(1).write.parquet(os.path.join(src, "part1"))
    schema = events.schema

    def run():
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(src))
        m = catalog._event_measurements(stream)
        hourly = m.select("station_code", "variable_code", truncate_hour("observed_at").alias("observed_at"),
                          "value", "unit", "source_file_id", F.col("measurement_id").alias("load_order"))
        return STR.stream_upsert(hourly, os.path.join(work, "table"), work)

    run()
    first = STR.read_table_dir(spark, os.path.join(work, "table")).count()
    events.where(F.col("event_id") > half).coalesce(1).write.parquet(os.path.join(src, "part2"))
    run()
    run()  # nothing new: no change
    got = STR.read_table_dir(spark, os.path.join(work, "table"))
    from envspark import binding as B

    want = L.dedup_last_wins(B.hourly(spark, SMALL)).drop("load_order")
    assert first < want.count()
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def _arrival(spark, work, k, rows, schema="station_id int, variable_id int, observed_at timestamp_ntz, value double, measurement_id long, unit string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(work, "in", f"a{k}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(os.path.join(work, "in"))


def _row(station, day, hour, value, i):
    return (station, 1, datetime(2024, 1, day, hour), float(value), i, "u")


def test_append_windows_close_once_and_keep_late_rows(spark, monkeypatch):
    work = tempfile.mkdtemp(prefix="envspark-append-", dir="/tmp")

    def run(k, *rows):
        stream = _arrival(spark, work, k, [_row(1, d, h, v, i) for d, h, v, i in rows])
        STR.stream_window_append(stream, "1 day", None, ["station_id"], "1 day", work)
        return sorted((r.window_start.day, r.n, r.mean_value, r.closed) for r in STR.read_windows(spark, work).collect())

    assert run(0, (1, 1, 2, 1), (1, 2, 4, 2), (2, 0, 1, 3)) == [(1, 2, 3.0, False), (2, 1, 1.0, False)]
    assert run(1, (1, 5, 6, 4), (4, 0, 9, 5)) == [(1, 3, 4.0, True), (2, 1, 1.0, True), (4, 1, 9.0, False)]  # day 1 was late, not too late
    done = V.publish
    for fails in (True, False):  # a batch that fails before its last step and is run again counts once
        if fails:
            monkeypatch.setattr(V, "publish", lambda spark, table, *a: done(spark, table, *a) if table.endswith("late") else 1 / 0)
            with pytest.raises(Exception):
                run(2, (1, 7, 100, 6), (4, 1, 1, 7), (9, 0, 5, 8))
            monkeypatch.undo()
    STR.stream_window_append(spark.readStream.schema("station_id int, variable_id int, observed_at timestamp_ntz, value double, measurement_id long, unit string")
                             .option("recursiveFileLookup", "true").parquet(os.path.join(work, "in")), "1 day", None, ["station_id"], "1 day", work)
    got = sorted((r.window_start.day, r.n, r.mean_value, r.closed) for r in STR.read_windows(spark, work).collect())
    assert got == [(1, 3, 4.0, True), (2, 1, 1.0, True), (4, 2, 5.0, True), (9, 1, 5.0, False)]
    assert [(r.observed_at.day, r.value, r.epoch) for r in STR.read_late(spark, work).collect()] == [(1, 100.0, 2)]
    state = V.read(spark, os.path.join(work, "windows"), keep=lambda values: values[0] == "open")
    assert state.where("window_start IS NOT NULL").count() == 1  # the open window alone


def test_latest_state_does_not_grow_with_batches(spark):
    work = tempfile.mkdtemp(prefix="envspark-latest-", dir="/tmp")
    sizes = []
    for k in range(4):
        stream = _arrival(spark, work, k, [_row(s, k + 1, s, 10 * k + s, 10 * k + s) for s in range(3)] + [_row(0, 1, 0, -1, 100 + k)])
        STR.stream_latest(stream, os.path.join(work, "table"), work)
        sizes.append(len(os.listdir(os.path.join(work, "table", "data"))))
    assert sizes == [1, 2, 2, 2]
    got = sorted((r.station_id, r.value) for r in STR.read_latest_state(spark, os.path.join(work, "table")).collect())
    assert got == [(0, 30.0), (1, 31.0), (2, 32.0)]
