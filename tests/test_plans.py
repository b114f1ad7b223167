"""Plan shape checks: pushed filters, pruned columns, no single-partition windows on series."""

from conftest import SMALL
import __spark_entry__ as entry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_is_pushed_to_the_scan(spark):
    p = plan(entry.queries()["date_range"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p


def test_star_query_joins_broadcast_small_dimensions(spark):
    p = plan(entry.queries()["star_query"](spark, SMALL))
    assert p.count("BroadcastHashJoin") >= 3


def test_scan_reads_only_needed_columns(spark):
    p = plan(entry.queries()["series_day"](spark, SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in p


def test_series_windows_are_partitioned(spark):
    for name in ("rolling_band_by_series", "autocorrelation_by_series", "iqr_anomalies_by_series"):
        p = plan(entry.queries()[name](spark, SMALL))
        assert "SinglePartition" not in p, name


def test_latest_and_dedup_combine_before_the_shuffle(spark):
    for name in ("latest_values", "dedup_last_wins"):
        p = plan(entry.queries()[name](spark, SMALL))
        assert "partial_max_by" in p, name


def test_resample_partials_are_shuffled_once(spark):
    df = entry.queries()["series_day"](spark, SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final


def test_hot_key_third_of_rows(spark):
    """One (station, variable, hour) key holding a third of the batch: dedup keeps exactly one row for it and
    the result equals the plain per-key maximum of the load order."""
    from pyspark.sql import functions as F

    from envspark import binding as B
    from envspark.operators import load as L

    h = B.hourly(spark, SMALL)
    n = h.count()
    hot = h.limit(n // 2).select(F.lit("ST00").alias("station_code"), F.lit("PM25").alias("variable_code"),
                                 F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("observed_at"),
                                 "value", "unit", "source_file_id", (F.col("load_order") + 10**9).alias("load_order"))
    batch = h.unionByName(hot).repartition(8)
    out = L.dedup_last_wins(batch)
    key = out.where("station_code = 'ST00' AND variable_code = 'PM25' AND observed_at = '2024-01-01 00:00:00'")
    assert key.count() == 1
    want = batch.groupBy(*L.KEY).agg(F.max("load_order").alias("m"))
    got = out.select(*L.KEY, F.col("load_order").alias("m"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
