"""Binding of the given test tables to the measurement model (see FIXTURES.md §1).

Every table here is derived from the given parquet tables by Spark, so its size follows theirs:

* ``measurements``   (E)  one fact per ``events`` row; station = user_id mod 25, variable = event type.
* ``measurements_li`` (LI) one fact per ``lineitem`` row: a long daily history (1995-2001).
* ``stations``        the stations present in the facts, named after ``nation`` / ``region``.
* ``variables``       the variables present in the facts, with category and default unit.
* ``source_files``    one ledger row per block of 100 consecutive event ids (a "file").
* ``etl_runs``        one ledger row per 10 files.

The same definitions are written as SQL in ``envspark.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.functions.text import category, default_unit
from envspark.functions.timefmt import truncate_hour
from envspark.session import read_table

N_STATIONS = 25
EVENTS_PER_FILE = 100
FILES_PER_RUN = 10

# Event type -> (variable id, variable code).
EVENT_VARIABLES = (("click", 1, "PM25"), ("view", 2, "PM10"), ("purchase", 3, "NO2"), ("signup", 4, "O3"))
OTHER_VARIABLE = (5, "CO")
# Lineitem return flag -> variable code.
RETURNFLAG_VARIABLES = (("A", "PM25"), ("N", "PM10"))
OTHER_RETURNFLAG_VARIABLE = "NO2"
# L9 input, station codes for nation keys 0..8.
REFERENCE_CODES = ("SANANTONIO", "CAR", "COT", "BEL", "TUM", "CEN", "EL_CAMAL", "CHI", "GUA")


def station_code_of(key: Column) -> Column:
    return F.concat(F.lit("ST"), F.lpad(key.cast("string"), 2, "0"))


def _case(col: Column, pairs, other) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(other))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    st = (F.col("user_id") % N_STATIONS).cast("int")
    et = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("measurement_id"),
        st.alias("station_id"),
        station_code_of(st).alias("station_code"),
        _case(et, [(e, i) for e, i, _ in EVENT_VARIABLES], OTHER_VARIABLE[0]).alias("variable_id"),
        _case(et, [(e, c) for e, _, c in EVENT_VARIABLES], OTHER_VARIABLE[1]).alias("variable_code"),
        F.col("ts").alias("observed_at"),
        F.col("value"),
        F.when(et == "error", F.lit("mg/m3")).otherwise(F.lit("ug/m3")).alias("unit"),
        (F.floor(F.col("event_id") / EVENTS_PER_FILE).cast("int") + 1).alias("source_file_id"),
    )


def measurements_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    st = (F.col("l_suppkey") % N_STATIONS).cast("int")
    return li.select(
        st.alias("station_id"),
        station_code_of(st).alias("station_code"),
        _case(F.col("l_returnflag"), RETURNFLAG_VARIABLES, OTHER_RETURNFLAG_VARIABLE).alias("variable_code"),
        F.col("l_shipdate").alias("observed_at"),
        F.col("l_quantity").alias("value"),
    )


def _stations_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distinct station ids of the facts (partial aggregation, tiny result) named from nation/region.
    present = measurements(spark, sf_dir).select("station_id").distinct()
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    no_coords = (k % 5) == 4
    return (present.join(nation, present.station_id == nation.n_nationkey, "inner")
            .join(region, nation.n_regionkey == region.r_regionkey, "inner")
            .select(
                k.alias("station_id"),
                F.col("n_name").alias("name"),
                F.when(no_coords, F.lit(None).cast("double"))
                .otherwise(k.cast("double") / 50 - F.lit(0.4)).alias("latitude"),
                F.when(no_coords, F.lit(None).cast("double"))
                .otherwise(k.cast("double") / 100 - F.lit(78.6)).alias("longitude"),
                F.col("r_name").alias("region"),
                F.lit(True).alias("is_active"),
            ))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most N_STATIONS rows by construction (ids are user_id mod 25), hence the broadcast hint: derived from
    the facts, the planner would otherwise estimate it at the size of the whole events table."""
    b = _stations_base(spark, sf_dir)
    return F.broadcast(b.select("station_id", station_code_of(F.col("station_id")).alias("code"), "name",
                                "latitude", "longitude", "region", "is_active"))


def stations_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations whose codes for keys 0..8 name reference stations (input of L9 and of the region lookup);
    at most N_STATIONS rows, like ``stations``."""
    b = _stations_base(spark, sf_dir)
    k = F.col("station_id")
    code = _case(k, list(enumerate(REFERENCE_CODES)), None)
    code = F.coalesce(code, station_code_of(k))
    return F.broadcast(b.select(
        "station_id", code.alias("code"),
        F.when((k < len(REFERENCE_CODES)) & (k % 2 == 0), code).otherwise(F.col("name")).alias("name"),
        "latitude", "longitude", "region", "is_active"))


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five rows by construction (one per event-type mapping), hence the broadcast hint."""
    m = measurements(spark, sf_dir).select("variable_id", "variable_code").distinct()
    return F.broadcast(m.select(
        "variable_id",
        F.col("variable_code").alias("code"),
        F.col("variable_code").alias("display_name"),
        category("variable_code").alias("category"),
        default_unit(F.col("variable_code")).alias("default_unit"),
    ))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = (measurements(spark, sf_dir).groupBy("source_file_id")
         .agg(F.max("observed_at").alias("downloaded_at"), F.count("*").alias("row_count")))
    sid = F.col("source_file_id")
    run_no = F.floor((sid - 1) / FILES_PER_RUN).cast("int") + 1
    return f.select(
        "source_file_id",
        F.concat(F.lit("run-"), F.lpad(run_no.cast("string"), 3, "0")).alias("etl_run_id"),
        F.when(sid % 3 == 0, F.lit("manual")).otherwise(F.lit("automatic")).alias("source_type"),
        F.concat(F.lit("file_"), F.lpad(sid.cast("string"), 5, "0"), F.lit(".csv")).alias("original_name"),
        F.when(sid % 13 == 0, F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        "downloaded_at",
        "row_count",
    )


def etl_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = source_files(spark, sf_dir)
    return f.groupBy(F.col("etl_run_id").alias("id")).agg(
        F.min("source_type").alias("trigger_type"),
        F.when(F.max(F.when(F.col("status") == "failed", 1).otherwise(0)) == 1, F.lit("failed"))
        .otherwise(F.lit("completed")).alias("status"),
        F.min("downloaded_at").alias("started_at"),
        F.max("downloaded_at").alias("finished_at"),
        F.count("*").alias("archives_processed"),
        F.sum("row_count").alias("records_inserted"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E at hourly grain: the staging batch of the load operators (load order = event id)."""
    m = measurements(spark, sf_dir)
    return m.select(
        "station_code", "variable_code",
        truncate_hour("observed_at").alias("observed_at"),
        "value", "unit", "source_file_id",
        F.col("measurement_id").alias("load_order"),
    )
