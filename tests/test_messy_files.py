"""Awkward delimited files, timestamp layouts, limits and the table sink."""

import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from envspark.functions.timeparse import with_parsed_datetime
from envspark.operators import load, queries
from envspark.sources.files import read_delimited, write_measurements
from envspark.session import checkpoint_dir
from envspark.sources import versions

STAMPS = {
    "2024-02-03": (2024, 2, 3), "2024-02-03 04:05": (2024, 2, 3, 4, 5), "2024-02-03T04:05:06.5Z": (2024, 2, 3, 4, 5, 6, 500000),
    "03-02-2024": (2024, 3, 2), "15-01-2024": (2024, 1, 15), "03/02/2024 1:02": (2024, 3, 2, 1, 2), "15.01.2024": (2024, 1, 15),
    "20240115": (2024, 1, 15), "20240115 08:30": (2024, 1, 15, 8, 30), "Jan 15, 2024 08:00": (2024, 1, 15, 8),
    "15 March 2024": (2024, 3, 15), "Jan 1 2024 08:00": (2024, 1, 1, 8), "2024-01-15T08": (2024, 1, 15, 8), "2024-01": (2024, 1, 1),
    "2024-01-15 08:00 PM": (2024, 1, 15, 20), "2024-01-15 12:30 am": (2024, 1, 15, 0, 30), "1/15/24": (2024, 1, 15),
    "2024-01-15 08:00 UTC": (2024, 1, 15, 8), "2024-01-15 08:00+02:00": (2024, 1, 15, 6), "12": None, "31.5": None, "x": None, "": None,
    "2024-13-40": None, "2024-01-15 13:00 PM": None, "may": None,
}


def test_timestamp_layouts(spark):
    df = spark.createDataFrame([(s,) for s in STAMPS], "s string")
    got = {r.s: r.t for r in with_parsed_datetime(df, F.col("s"), "t").select("s", "t").collect()}
    assert got == {s: None if t is None else datetime(*t) for s, t in STAMPS.items()}


def read(spark, **files):
    root = tempfile.mkdtemp(prefix="messy-", dir="/tmp")
    paths = []
    for name, text in files.items():
        paths.append(os.path.join(root, f"{name}.csv"))
        with open(paths[-1], "w", encoding="utf-8") as f:
            f.write(text)
    return sorted(map(tuple, read_delimited(spark, paths).select("source_workbook", "observed_at", "variable_code", "value", "station_code",
                                                                 "unit").collect()))


def test_blank_first_lines_and_missing_tokens(spark):
    rows = read(spark, a="\n\ndatetime,station,variable,value,unit\n2024-01-01 00:00,NA,CO,1.5,N/A\n2024-01-01 01:00,x,null,2,m\n")
    assert rows == [("a.csv", datetime(2024, 1, 1), "CO", 1.5, "UNKNOWN_STATION", rows[0][5])] and rows[0][5] not in ("N/A", None)


def test_each_file_finds_its_own_timestamp_column(spark):
    head = "when;other;variable;value\n"
    bad = head + "".join(f"?;2024-02-{d:02d};CO;1\n" for d in range(1, 29))
    good = head + "".join(f"Jan {d} 2024 08:00;-;CO;{d}\n" for d in range(1, 17))
    rows = read(spark, a_bad=bad, b_good=good)
    assert sum(r[0] == "b_good.csv" for r in rows) == 16 and sum(r[0] == "a_bad.csv" for r in rows) == 28


@pytest.mark.parametrize("limit", [0, 201])
def test_run_list_limit(spark, limit):
    with pytest.raises(ValueError):
        queries.run_list(spark.range(1).selectExpr("id", "id as started_at"), limit)


def test_skipped_rows_with_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), ("a", 1), ("a", 2)], "k string, j int")
    assert load.dedup_skipped(rows, ["k", "j"]).first().skipped == 1


def test_replace_removes_variables_without_fresh_rows(spark):
    table = tempfile.mkdtemp(prefix="sink-", dir="/tmp") + "/facts"
    cols = "station_code string, variable_code string, observed_at string, value double"
    write_measurements(spark.createDataFrame([("s", "NO2", "a", 1.0), ("s", "CO", "a", 1.0), ("s", "O3", "a", 1.0)], cols), table)
    write_measurements(spark.createDataFrame([("s", "CO", "b", 2.0)], cols), table, ["NO2", "CO"])
    got = sorted((r.variable_code, r.value) for r in versions.read(spark, table).collect())
    assert got == [("CO", 2.0), ("O3", 1.0)]
    assert [d for d in os.listdir(os.path.dirname(table)) if "staging" in d] == []


def test_checkpoint_folder_is_read_from_the_session(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_zip_partition_packs_bounded_archives():
    import io
    import zipfile

    import pandas as pd

    from envspark import catalog

    rows = [f"S1;2024-01-01 00:00:00;PM25;{i};u" for i in range(2 * catalog.ARCHIVE_LINES + 5)]
    batches = (pd.DataFrame({"line": rows[i:i + 7000]}) for i in range(0, len(rows), 7000))
    archives = [a for pdf in catalog._zip_partition(batches) for a in pdf.itertuples()]
    members = [zipfile.ZipFile(io.BytesIO(a.content)).read("data/part.csv").decode().splitlines()[1:] for a in archives]
    assert [x for m in members for x in m] == rows and len({a.path for a in archives}) == 3
    assert max(map(len, members)) <= catalog.ARCHIVE_LINES
