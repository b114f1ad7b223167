"""File fixtures (FIXTURES.md §2): layouts, quirks R1-R6, encodings, archives, format gate."""

from datetime import datetime

from pyspark.sql import functions as F

from envspark.operators.normalize import STAGING_COLUMNS, validation_report
from envspark.sources import files as S


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_long_layout(spark, fixture_dir):
    p, _ = fixture_dir
    df = S.read_delimited(spark, [p["long.csv"]])
    assert df.columns == STAGING_COLUMNS
    got = rows(df, "station_code", "variable_code", "value", "unit", "source_row_number")
    assert got == [("BELISARIO", "PM25", 30.0, "ug/m3", 3), ("BELISARIO", "PM25", 35.2, "µg/m3", 2),
                   ("BELISARIO", "PM25", 36.0, "µg/m3", 4), ("UNKNOWN_STATION", "O3", 12.5, "ug/m3", 6)]


def test_wide_layout_units_row_and_stem(spark, fixture_dir):
    p, _ = fixture_dir
    df = S.read_delimited(spark, [p["PM2.5.csv"]])
    assert rows(df, "station_code", "variable_code", "value") == [
        ("BELISARIO", "PM25", 33.0), ("BELISARIO", "PM25", 35.2), ("CARAPUNGO", "PM25", 20.5), ("ELCAMAL", "PM25", 12.0)]
    assert {r[0] for r in df.select("unit").collect()} == {"ug/m3"}


def test_date_and_time_columns_keep_hours(spark, fixture_dir):
    p, _ = fixture_dir
    df = S.read_delimited(spark, [p["fecha_hora_split.csv"]])
    assert df.select("observed_at").distinct().count() == 4


def test_value_without_variable_gives_no_rows(spark, fixture_dir):
    p, _ = fixture_dir
    assert S.read_delimited(spark, [p["value_no_variable.csv"]]).count() == 0


def test_wide_by_variable_default_axis_and_option(spark, fixture_dir):
    p, _ = fixture_dir
    df = S.read_delimited(spark, [p["wide_by_variable.csv"]])
    assert {r[0] for r in df.select("station_code").distinct().collect()} == {"PM25", "PM10", "TEMP"}
    df2 = S.read_delimited(spark, [p["wide_by_variable.csv"]], wide_axis="variable")
    assert {r[0] for r in df2.select("variable_code").distinct().collect()} == {"PM25", "PM10", "TEMP"}
    # Header "stationId" normalises to "stationid", which is not a station synonym
    assert {r[0] for r in df2.select("station_code").distinct().collect()} == {"UNKNOWN_STATION"}


def test_validation_report(spark, fixture_dir):
    p, _ = fixture_dir
    raw = spark.read.option("header", "true").csv(p["wide_by_variable.csv"])
    raw = S.with_row_index(raw.withColumn("_file", F.col("_metadata.file_path")))
    bad = validation_report(raw, {"date": "timestamp", "pm25": "float", "pm10": "float"})
    assert rows(bad, "row_number", "column") == [(3, "pm25"), (5, "date"), (6, "pm10")]


def test_latin1_semicolon_and_bom(spark, fixture_dir):
    p, _ = fixture_dir
    df = S.read_delimited(spark, [p["semicolon_latin1.txt"]])
    assert rows(df, "station_code", "value") == [("GUAMANÍ", 4.0)]
    assert S.read_delimited(spark, [p["bom.csv"]]).count() == 4


def test_offsets_and_day_first(spark, fixture_dir):
    p, _ = fixture_dir
    got = rows(S.read_delimited(spark, [p["offsets.csv"]]), "value", "observed_at")
    assert got == [(1.0, datetime(2024, 1, 15, 8)), (2.0, datetime(2024, 1, 15, 13)), (3.0, datetime(2024, 1, 15, 9)),
                   (4.0, datetime(2024, 1, 15)), (5.0, datetime(2024, 3, 2))]


def test_empty_files(spark, fixture_dir):
    p, _ = fixture_dir
    assert S.read_delimited(spark, [p["allnull.csv"], p["empty.csv"]]).count() == 0


def test_many_files_one_scan_per_layout(spark, fixture_dir):
    p, _ = fixture_dir
    df = S.read_delimited(spark, [p["long.csv"], p["bom.csv"], p["fecha_hora_split.csv"], p["PM2.5.csv"]])
    assert df.count() == 4 + 4 + 4 + 4


def test_zip_gate_and_magic(spark, fixture_dir):
    _, root = fixture_dir
    members = rows(S.expand_zip(spark, root), "member")
    assert members == [("a/b.csv",), ("long.csv",)]
    gate = S.format_gate(S.list_files(spark, root), "manual")
    rejected = {r[0] for r in gate.where("NOT accepted").select("name").collect()}
    assert rejected == {"bundle.zip", "notes.pdf", "x.bin"}
    auto = S.format_gate(S.list_files(spark, root), "automatic")
    assert {r[0] for r in auto.where("accepted").select("name").collect()} == {"bundle.zip"}
    types = dict(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
                 .select(F.regexp_extract("path", "([^/]+)$", 1), S.detect_type(F.col("content"))).collect())
    assert types["bundle.zip"] == ".zip" and types["x.bin"] == ".bin"


def test_row_index_independent_of_split_size(spark, fixture_dir):
    p, _ = fixture_dir
    raw = spark.read.option("header", "true").csv(p["wide_by_variable.csv"]).repartition(3)
    raw = raw.withColumn("_file", F.lit("f"))
    idx = S.with_row_index(raw)
    assert sorted(r[0] for r in idx.select("_row").collect()) == list(range(8))


def test_zip_members_parsed_without_landing(spark, fixture_dir):
    _, root = fixture_dir
    df = S.read_zip_members(spark, root)
    assert df.columns == STAGING_COLUMNS
    got = rows(df, "source_workbook", "station_code", "value")
    assert len(got) == 8
    assert ("long.csv", "UNKNOWN_STATION", 12.5) in got and ("b.csv", "BEL", 13.0) in got


def test_numeric_first_column_is_not_the_timestamp(spark, fixture_dir):
    # R2 fix: the guess skips numeric columns and takes the date column under an unknown header
    p, _ = fixture_dir
    df = S.read_delimited(spark, [p["station_first_numeric.csv"]])
    got = rows(df, "observed_at", "value")
    assert got == [(datetime(2024, 1, 15, 8), 1.0), (datetime(2024, 1, 15, 9), 2.0), (datetime(2024, 1, 15, 11), 4.0)]


def test_quoted_field_spanning_lines(spark, tmp_path):
    p = tmp_path / "multi.csv"
    p.write_text('estacion,fecha_hora,variable,valor,nota\nBEL,2024-01-15 08:00,PM10,5,"line one\nline two"\n'
                 'BEL,2024-01-15 09:00,PM10,6,ok\n')
    df = S.read_delimited(spark, [str(p)], multi_line=True)
    assert rows(df, "value") == [(5.0,), (6.0,)]


def test_staging_and_model_schemas(spark, fixture_dir):
    from envspark import binding as B
    from envspark.plans.load_job import TABLE_COLUMNS
    from envspark.schema import MEASUREMENTS, SOURCE_FILES, STAGING, STATIONS, VARIABLES, same_shape

    p, _ = fixture_dir
    assert same_shape(S.read_delimited(spark, [p["long.csv"]]).schema, STAGING)
    assert same_shape(S.read_delimited(spark, [p["allnull.csv"]]).schema, STAGING)
    assert same_shape(B.stations(spark, "/root/testdata/sf0.001").schema, STATIONS)
    assert same_shape(B.variables(spark, "/root/testdata/sf0.001").schema, VARIABLES)
    assert same_shape(B.source_files(spark, "/root/testdata/sf0.001").schema, SOURCE_FILES)
    assert [f.name for f in MEASUREMENTS.fields] == TABLE_COLUMNS
