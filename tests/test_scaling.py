"""Ingest and streaming steps whose time must follow the rows: no conversion of windows a row, tasks for all cores, rows joined
where they were read, plain timestamps without the rewriting patterns, blank cells not parsed."""

import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from envspark.functions import timeparse as TP
from envspark.operators.normalize import normalize_frame
from envspark.sources import blocks as B
from envspark.sources import files as S
from envspark.streaming import ingest as STR


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_append_windows_are_made_of_the_ntz_value(spark, monkeypatch):
    def fails(*args):
        raise AssertionError("converted a row")

    monkeypatch.setattr(STR, "instant_as_utc_ntz", fails)
    monkeypatch.setattr(STR, "ntz_as_utc_instant", fails)
    work = tempfile.mkdtemp(prefix="envspark-ntz-", dir="/tmp")
    schema = "station_id int, observed_at timestamp_ntz, value double"
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 2024-03-10 02:30 is in its gap
        for k, rows in enumerate([[(1, datetime(2024, 3, 10, 2, 30), 1.0), (1, datetime(2024, 3, 10, 23, 59, 59, 999999), 3.0), (1, None, 9.0)],
                                  [(1, datetime(2024, 3, 13), 5.0)], [(1, datetime(2024, 3, 10, 3), 7.0)]]):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(work, "in", f"a{k}"))
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(os.path.join(work, "in"))
            STR.stream_window_append(stream, "1 day", None, ["station_id"], "1 day", work)
        got = sorted((r.window_start, r.window_end, r.n, r.mean_value, r.closed) for r in STR.read_windows(spark, work).collect())
        assert got == [(datetime(2024, 3, 10), datetime(2024, 3, 11), 2, 2.0, True), (datetime(2024, 3, 13), datetime(2024, 3, 14), 1, 5.0, False)]
        assert [(r.observed_at, r.value) for r in STR.read_late(spark, work).collect()] == [(datetime(2024, 3, 10, 3), 7.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_members_are_dealt_to_all_cores(spark):
    members = [("file:///a.zip", k, 8 << 20) for k in range(8)]  # far less than TASK_BYTES
    assert B.zip_chunks(spark, members).rdd.getNumPartitions() == min(8, spark.sparkContext.defaultParallelism)


def test_row_numbers_leave_rows_where_they_were_read(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = S.with_row_index(spark.range(0, 1000, 1, 4).select(F.floor(F.col("id") / 500).alias("_file"), "id"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted((r._file, r._row) for r in rows.collect()) == [(f, k) for f in (0, 1) for k in range(500)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


TEXTS = ["2024-01-05 10:11:12", " 2024-01-05T10:11:12.5 ", "2024-01-05 10:11:12.123456", "2024-01-05 10:11:12.1234567", "2024-01-05 10:11:60",
         "2024-02-30 10:11:12", "2024-01-05 24:00:00", "0000-01-05 10:11:12", "2024-01-05 10:11:12Z", "2024-01-05 10:11:12+02:00", "20240105", "20240105 10", "2024-01",
         "1/5/2024 3:04 pm", "5 Jan 2024", "12", "12.5", "-3.", "", " ", "1234567", "12345678", "12345678.5", "never", "2024/01/05 10:11:12", "2024-1-5 1:02", None]


def test_plain_timestamps_skip_the_rewriting(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    short = {r.k: r.o for r in TP.with_parsed_datetime(df, F.col("t"), "o").selectExpr("k", "cast(o AS string) AS o").collect()}
    with monkeypatch.context() as m:  # all texts through the patterns
        m.setattr(TP, "PLAIN", "^never a text$")
        m.setattr(TP, "SHORT_NUMBER", "^never a text$")
        whole = {r.k: r.o for r in TP.with_parsed_datetime(df, F.col("t"), "o").selectExpr("k", "cast(o AS string) AS o").collect()}
    assert short == whole and short[0] == "2024-01-05 10:11:12" and sum(v is not None for v in short.values()) >= 12
    with monkeypatch.context() as m:  # without them, the plain ones are read
        m.setattr(TP, "canonical", lambda df, col, out: df.withColumn(out, F.lit(None).cast("string")).withColumn(f"{out}_half", F.lit(None).cast("string")))
        plain = {r.k: r.o for r in TP.with_parsed_datetime(df, F.col("t"), "o").selectExpr("k", "cast(o AS string) AS o").collect()}
    assert [k for k in plain if plain[k] is not None] == [k for k in range(8) if short[k] is not None and k not in (3, 4)]


def test_blank_cells_are_dropped_before_they_are_parsed(spark):
    rows = [(f"2024-01-{d:02d} 00:00:00", "1,5" if d == 3 else str(d), " " if d % 2 else "7", "f", d - 1) for d in range(1, 11)]
    wide = spark.createDataFrame(rows, "fecha string, A string, B string, _file string, _row int")
    got = normalize_frame(wide, "data", "NO2.csv", file_col="_file", rejects=True)
    exploded = [line for line in _plan(got).splitlines() if "Generate explode" in line]
    assert exploded and not any("RLIKE" in line for line in exploded)
    found = sorted((r.station_code or "", r.value if r.value is not None else -1.0, r.reject or "") for r in got.collect())
    assert found == sorted([("A", float(d), "") if d != 3 else ("A", -1.0, "value") for d in range(1, 11)] + [("B", 7.0, "")] * 5)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
