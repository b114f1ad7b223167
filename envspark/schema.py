"""StructTypes of the measurement model and of the staging rows between normalise and load."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
_TS = T.TimestampNTZType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, typ, nullable) for name, typ, nullable in fields])


STATIONS = _struct(("station_id", _I, False), ("code", _S, False), ("name", _S, True), ("latitude", _D, True),
                   ("longitude", _D, True), ("region", _S, True), ("is_active", _B, True))

VARIABLES = _struct(("variable_id", _I, False), ("code", _S, False), ("display_name", _S, True),
                    ("category", _S, True), ("default_unit", _S, True))

# The stored fact table (partitioned by variable_code; unique key station_code, variable_code, observed_at).
MEASUREMENTS = _struct(("station_code", _S, False), ("variable_code", _S, False), ("observed_at", _TS, False),
                       ("value", _D, True), ("unit", _S, True), ("source_file_id", _I, True))

SOURCE_FILES = _struct(("source_file_id", _I, False), ("etl_run_id", _S, True), ("source_type", _S, True),
                       ("original_name", _S, True), ("status", _S, True), ("downloaded_at", _TS, True),
                       ("row_count", _L, True))

ETL_RUNS = _struct(("id", _S, False), ("trigger_type", _S, True), ("status", _S, True), ("started_at", _TS, True),
                   ("finished_at", _TS, True), ("archives_processed", _L, True), ("records_inserted", _L, True))

# Rows between normalisation and load; sheet / row / workbook give the load order.
STAGING = _struct(("station_code", _S, True), ("observed_at", _TS, True), ("variable_code", _S, True),
                  ("value", _D, True), ("unit", _S, True), ("source_sheet", _S, True),
                  ("source_row_number", _L, True), ("source_workbook", _S, True))


def same_shape(df_schema: T.StructType, model: T.StructType) -> bool:
    """Same column names and types in the same order (nullability ignored)."""
    return [(f.name, f.dataType) for f in df_schema.fields] == [(f.name, f.dataType) for f in model.fields]
