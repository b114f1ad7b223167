"""Results do not depend on the session time zone (NTZ fields only; a DST zone exercises the gaps)."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from tools.check_oracle import rows_of

NAMES = ["series_hour", "record_hash", "dedup_last_wins", "stream_window", "contract_weekly", "heatmap"]


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Kolkata"])
def test_zone_independent(spark, zone):
    con = duckdb.connect()
    for t in ["events", "nation", "region", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name in NAMES:
            got = entry.queries()[name](spark, SMALL).toPandas()
            want = con.execute(entry.oracle_sql()[name]).df()
            assert rows_of(got) == rows_of(want), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_parse_in_dst_gap(spark):
    from pyspark.sql import functions as F

    from envspark.functions.timeparse import parse_datetime

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = spark.createDataFrame([("2024-03-10 02:30",)], "s string").select(
            parse_datetime(F.col("s")).cast("string").alias("t")).first().t
        assert got == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
