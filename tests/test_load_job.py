"""End-to-end keyed load into a partitioned Parquet table: idempotent, last wins, untouched partitions kept."""

import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import SMALL
from envspark import binding as B
from envspark.operators import load as L
from envspark.plans.load_job import load_measurements, read_measurements
from envspark.session import checkpoint_dir
from envspark.sources import versions


def test_load_twice_then_update_one_variable(spark):
    table = os.path.join(tempfile.mkdtemp(prefix="envspark-table-", dir="/tmp"), "measurements")
    h = B.hourly(spark, SMALL)
    first = load_measurements(spark, h, table)
    n_keys = L.dedup_last_wins(h).count()
    assert first["inserted"] == n_keys and first["updated"] == 0
    again = load_measurements(spark, h, table)
    assert again["inserted"] == 0 and again["updated"] == 0
    assert versions.read(spark, table).count() == n_keys

    pm = h.where(F.col("variable_code") == "PM25").withColumn("value", F.col("value") + 1)
    third = load_measurements(spark, pm, table)
    assert third["inserted"] == 0 and third["updated"] == L.dedup_last_wins(pm).count()
    t = versions.read(spark, table)
    assert t.count() == n_keys
    want = L.dedup_last_wins(h).drop("load_order")
    joined = t.join(want.select(*L.KEY, F.col("value").alias("v0")), L.KEY)
    diff = joined.groupBy("variable_code").agg(F.max(F.abs(F.col("value") - F.col("v0") - F.when(
        F.col("variable_code") == "PM25", 1.0).otherwise(0.0))).alias("d")).collect()
    assert all(r.d < 1e-9 for r in diff)


def test_small_batch_leaves_other_partitions_and_no_stages(spark):
    root = tempfile.mkdtemp(prefix="envspark-table-", dir="/tmp")
    table = os.path.join(root, "measurements")
    h = B.hourly(spark, SMALL)
    load_measurements(spark, h, table)

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(table) for f in names if f.endswith(".parquet")}

    before = files()
    load_measurements(spark, h, table)
    assert files() == before  # nothing new or changed: no file is rewritten

    one = L.dedup_last_wins(h).orderBy(*L.KEY).limit(1).withColumn("value", F.col("value") + 1)
    assert load_measurements(spark, one, table) == {"inserted": 0, "updated": 1, "skipped": 0, "row_count": 1}
    touched = {os.path.dirname(f) for f in before ^ files()}
    assert len(touched) == 1 and len({os.path.dirname(f) for f in before}) > 1
    t = versions.read(spark, table)
    assert t.where(F.col("observed_date").isNull() | F.col("record_hash").isNull()).count() == 0
    assert t.where("observed_month <> trunc(observed_date, 'month')").count() == 0
    stages = [f for f in os.listdir(checkpoint_dir(spark)) if f.startswith("load-")]
    assert not stages


def test_rows_without_a_timestamp_are_rejected_and_counted(spark):
    table = os.path.join(tempfile.mkdtemp(prefix="envspark-table-", dir="/tmp"), "measurements")
    schema = "station_code string, variable_code string, observed_at timestamp_ntz, value double, unit string, " \
             "source_file_id int, load_order int"
    at = datetime(2024, 1, 1)
    rows = [("1", "10", None, 1.0, None, 1, 1), ("1", "10", at, 2.0, None, 1, 2), ("1", "10", at, 3.0, None, 1, 3)]
    for inserted, same in ((1, 1), (0, 2)):
        got = load_measurements(spark, spark.createDataFrame(rows, schema), table)
        assert got == {"inserted": inserted, "updated": 0, "skipped": same, "row_count": inserted, "rejected": 1}
    empty = load_measurements(spark, spark.createDataFrame([], schema), table)
    assert empty["row_count"] == 0 and versions.read(spark, table).count() == 1


def test_days_and_variables_leave_out_files_and_row_groups(spark):
    table = os.path.join(tempfile.mkdtemp(prefix="envspark-table-", dir="/tmp"), "measurements")
    h = B.hourly(spark, SMALL)
    load_measurements(spark, h, table)
    every = read_measurements(spark, table)
    day = every.agg(F.min("observed_date")).first()[0]
    some = read_measurements(spark, table, start=day, end=day + timedelta(days=2), variables=["PM25"])
    want = L.dedup_last_wins(h).where((F.col("variable_code") == "PM25") & F.to_date("observed_at").between(day, day + timedelta(days=2)))
    assert some.count() == want.count() > 0
    assert len(some.inputFiles()) < len(every.inputFiles()) / 4
    scan = [line for line in some._jdf.queryExecution().executedPlan().toString().split("\n") if "PushedFilters" in line]
    assert all("observed_date" in line for line in scan)
    some.collect()
    scanned = 0
    leaves = some._jdf.queryExecution().executedPlan().collectLeaves()
    for i in range(leaves.size()):
        plan = leaves.apply(i)
        plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "Adaptive" in plan.nodeName() else plan
        if plan.metrics().contains("numOutputRows"):
            scanned += plan.metrics().apply("numOutputRows").value()
    assert 0 < scanned < every.count() / 4  # rows that the scan itself put out
