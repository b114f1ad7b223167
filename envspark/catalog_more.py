"""Further registered queries: zoom, nested snapshot, contract results, presets, wide ingestion, cell types, model inputs,
hourly partials. Same form as ``catalog``: (spark, sf_dir) -> DataFrame, with the DuckDB statement beside it."""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import functions as F

from envspark import binding as B
from envspark.catalog import (CONTRACT, CONTRACT_WHERE, E_VARS, FEATURES_SQL, HEAT_CELLS, HIST_SQL, SQL_BUCKET, _features, _points_sql,
                              _resample, _resample_sql, _seasonal_sql, _sql_with, _with_latest, r6, register)
from envspark.operators import features as M
from envspark.operators import partials as P
from envspark.operators import queries as Q
from envspark.oracle import R6, sql
from envspark.plans import contract as C
from envspark.plans.sqlguard import serialized
from envspark.streaming.ingest import _work_dir

# ---- Q18, Q9, Q11 --------------------------------------------------------------------------------------------------

ZOOM = (25.0, 60.0)


@register("range_zoom", _sql_with(f"""
span AS (SELECT variable_code, min(CAST(observed_at AS DATE)) AS f, max(CAST(observed_at AS DATE)) AS l FROM measurements GROUP BY 1),
zoom AS (SELECT variable_code, f + CAST(floor((l - f) * {ZOOM[0]} / 100) AS INT) AS date_from,
                f + CAST(floor((l - f) * {ZOOM[1]} / 100) AS INT) AS date_to FROM span)
SELECT z.variable_code, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to, count(*) AS n
FROM zoom z JOIN measurements m ON m.variable_code = z.variable_code AND CAST(observed_at AS DATE) BETWEEN date_from AND date_to
GROUP BY 1, 2, 3""", "measurements"))
def range_zoom(spark, d):
    m = B.measurements(spark, d).withColumn("day", F.to_date("observed_at"))
    span = m.groupBy("variable_code").agg(F.min("day").alias("f"), F.max("day").alias("l"))
    low, high = Q.zoom_bounds(F.col("f"), F.col("l"), *ZOOM)
    zoom = span.select("variable_code", low.alias("date_from"), high.alias("date_to"))  # a row a variable
    shown = m.join(zoom, "variable_code").where(F.col("day").between(F.col("date_from"), F.col("date_to")))
    days = [F.col(c).cast("string").alias(c) for c in ("date_from", "date_to")]
    return shown.groupBy("variable_code", *days).agg(F.count("*").alias("n"))


_ITEM_SQL = ("variable_code || '=' || CAST(CAST(floor(value * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' ' || coalesce(unit, '-') || ' ' || "
             "strftime(observed_at, '%Y-%m-%d %H:%M:%S')")


@register("live_snapshot_nested", _with_latest(f"""
SELECT station_code, count(*) AS n_variables, string_agg({_ITEM_SQL}, '; ' ORDER BY variable_code) AS variables,
       max(observed_at) AS latest_observed_at, count(*) OVER () AS total, max(max(observed_at)) OVER () AS global_latest_observed_at
FROM latest GROUP BY station_code""", "stations_ref"))
def live_snapshot_nested(spark, d):
    st = B.stations_ref(spark, d)
    nested = Q.live_snapshot(Q.latest_values(B.measurements(spark, d), st, B.variables(spark, d)), st, nested=True)
    stamp = lambda t: F.concat_ws(" ", F.to_date(t).cast("string"), F.concat_ws(
        ":", *[F.lpad(part(t).cast("string"), 2, "0") for part in (F.hour, F.minute, F.second)]))
    item = lambda v: F.concat(v["variable_code"], F.lit("="), F.floor(v["value"] * 1000 + 0.5).cast("string"), F.lit(" "),
                              F.coalesce(v["unit"], F.lit("-")), F.lit(" "), stamp(v["observed_at"]))
    return nested.select("station_code", "n_variables", F.array_join(F.transform("variables", item), "; ").alias("variables"),
                         "latest_observed_at", "total", "global_latest_observed_at")


@register("serialised_rows", sql("""
SELECT measurement_id, CASE WHEN microsecond(observed_at) % 1000000 = 0 THEN strftime(observed_at, '%Y-%m-%dT%H:%M:%S')
                            ELSE strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%f') END AS observed_at,
       strftime(observed_at, '%Y-%m-%d') AS day, CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS amount, station_code AS code
FROM measurements""", "measurements"))
def serialised_rows(spark, d):
    m = B.measurements(spark, d)
    return serialized(m.select("measurement_id", "observed_at", F.to_date("observed_at").alias("day"),
                               F.col("value").cast("decimal(18,2)").alias("amount"), F.col("station_code").cast("binary").alias("code")))


# ---- A17: the contract's other results -------------------------------------------------------------------------------


def _contract_sql(bucket: str) -> str:
    return sql(f"SELECT CAST({bucket} AS TIMESTAMP) AS timestamp, {R6('avg(value)')} AS value, count(*) AS n "
               f"FROM measurements WHERE {CONTRACT_WHERE} GROUP BY 1", "measurements")


@register("contract_hourly", _contract_sql("date_trunc('hour', observed_at)"))
def contract_hourly(spark, d):
    return r6(C.run_contract(B.measurements(spark, d), aggregation="hourly", **CONTRACT), "value")


@register("contract_daily", _contract_sql("date_trunc('day', observed_at)"))
def contract_daily(spark, d):
    return r6(C.run_contract(B.measurements(spark, d), aggregation="daily", **CONTRACT), "value")


@register("contract_distribution", _sql_with(HIST_SQL.replace("FROM measurements", f"FROM (SELECT * FROM measurements WHERE {CONTRACT_WHERE})"),
                                             "measurements"))
def contract_distribution(spark, d):
    out = C.run_contract(B.measurements(spark, d), aggregation="daily", result_type="distribution", **CONTRACT)
    return r6(out, "bin_start", "bin_end")


def _contract_corr_sql() -> str:
    codes = sorted(set(C.METRICS.values()))
    means = ", ".join(f"avg(CASE WHEN variable_code = '{v}' THEN value END) AS {v}" for v in codes)
    pairs = "\nUNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, {R6(f'corr({a}, {b})')} AS corr, CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) "
        "AS n FROM w" for i, a in enumerate(codes) for b in codes[i + 1:])
    where = CONTRACT_WHERE.replace("variable_code = 'PM25' AND ", "")
    return _sql_with(f"""
w AS (SELECT station_code, strftime(observed_at, '%Y-%m-%d %H:00') AS bucket, {means} FROM measurements WHERE {where} GROUP BY 1, 2)
{pairs}""", "measurements")


@register("contract_correlation", _contract_corr_sql())
def contract_correlation(spark, d):
    out = C.run_contract(B.measurements(spark, d), aggregation="hourly", result_type="correlation_matrix", **CONTRACT)
    return r6(out, "corr")


# ---- A19: the other choices ------------------------------------------------------------------------------------------

_NEWEST = "(SELECT CAST(max(observed_at) AS DATE) FROM measurements_li)"


@register("agg_choice_min_day_90d", sql(_resample_sql(
    f"(SELECT * FROM measurements_li WHERE CAST(observed_at AS DATE) >= {_NEWEST} - 89)", SQL_BUCKET["day"], agg="min"), "measurements_li"))
def agg_choice_min_day_90d(spark, d):
    li = B.measurements_li(spark, d)
    return _resample(Q.apply_preset(li, li, "90d"), "day", agg="min")


@register("agg_choice_avg_month_this_year", sql(_resample_sql(
    f"(SELECT * FROM measurements_li WHERE CAST(observed_at AS DATE) >= date_trunc('year', {_NEWEST}))", SQL_BUCKET["month"]), "measurements_li"))
def agg_choice_avg_month_this_year(spark, d):
    li = B.measurements_li(spark, d)
    return _resample(Q.apply_preset(li, li, "this_year"), "month")


# ---- S1, N4, N5, N7, N8: wide files end to end -------------------------------------------------------------------------

WIDE_LINES = 5_000


def _written_wide_files(folder: str, stations: list[str]):
    """Wide files of at most WIDE_LINES lines, named by their variable (PM2.5 with its dot), in folders named by their
    content: a blank header over the timestamps, a units row, one column a station. A repeated task writes the same files."""
    def run(batches):
        import hashlib

        import pandas as pd
        import pyarrow.fs as pafs

        head = ";".join(["", *stations])
        held: dict[tuple, list[str]] = {}

        def written(variable: str, unit: str, lines: list[str]) -> pd.DataFrame:
            text = "\n".join([head, ";".join(["Fecha / Unidad", *[unit] * len(stations)]), *lines]) + "\n"
            name = f"{int(hashlib.sha256(text.encode()).hexdigest()[:12], 16)}/{'PM2.5' if variable == 'PM25' else variable}.csv"
            fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(text.encode())
            return pd.DataFrame({"path": [name]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                cells = [""] * len(stations)
                cells[stations.index(r.station_code)] = r.v
                lines = held.setdefault((r.variable_code, r.unit), [])
                lines.append(";".join([r.at, *cells]))
                if len(lines) >= WIDE_LINES:
                    yield written(r.variable_code, r.unit, held.pop((r.variable_code, r.unit)))
        for (variable, unit), lines in held.items():
            yield written(variable, unit, lines)
    return run


@register("wide_ingest", sql("SELECT station_code, observed_at, variable_code, value, unit FROM measurements", "measurements"))
def wide_ingest(spark, d):
    from envspark.functions.timefmt import iso_datetime
    from envspark.sources import files as S

    work = _work_dir(spark, "wide ingest")
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{work}/files/.folder")  # the folder, on whatever file system it is
    uri = (work if "://" in work else f"file://{work}").replace(" ", "%20")
    m = B.measurements(spark, d).select("station_code", "variable_code", "unit", F.col("value").cast("string").alias("v"),
                                        F.replace(iso_datetime("observed_at", True), F.lit("T"), F.lit(" ")).alias("at"))
    stations = [B.station_code_of(F.lit(k)) for k in range(B.N_STATIONS)]
    names = list(spark.range(1).select(*stations).first())
    m.mapInPandas(_written_wide_files(f"{uri}/files", names), "path string").write.format("noop").mode("overwrite").save()
    paths = [r["path"] for r in S.located(spark, f"{work}/files").where("suffix = '.csv'").select("path").collect()]
    return S.read_delimited(spark, paths).select("station_code", "observed_at", "variable_code", "value", "unit")


# ---- S4: file types of downloads without a usable name ------------------------------------------------------------------


@register("file_types", sql("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '.rar' WHEN 1 THEN '.zip' WHEN 2 THEN '.xlsx' ELSE '.bin' END AS suffix FROM documents"""))
def file_types(spark, d):
    from envspark.session import read_table
    from envspark.sources import files as S

    k = F.col("doc_id") % 4
    magic = F.when(k == 0, F.lit(bytearray(S.RAR_MAGIC))).when(k == 1, F.lit(bytearray(S.ZIP_MAGIC))).otherwise(F.lit(bytearray(b"")))
    kind = F.when(k == 2, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet").when(k == 0, "application/vnd.ms-excel").otherwise("text/html")
    docs = read_table(spark, d, "documents").select("doc_id", F.concat(magic, F.coalesce("text", F.lit("")).cast("binary")).alias("content"),
                                                    kind.alias("content_type"))
    return docs.select("doc_id", S.detect_type(F.col("content"), F.col("content_type")).alias("suffix"))


# ---- N19: the other cell types -----------------------------------------------------------------------------------------

_CELLS_SQL = ("(SELECT measurement_id, CASE measurement_id % 6 WHEN 0 THEN CAST(measurement_id AS VARCHAR) WHEN 1 THEN '1.5' WHEN 2 THEN ' -7 ' "
              "WHEN 3 THEN 'x' WHEN 4 THEN '' ELSE NULL END AS k, CASE measurement_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'no' WHEN 2 THEN '0' "
              "WHEN 3 THEN 'maybe' ELSE ' ' END AS flag FROM measurements)")


@register("cell_validation_types", sql(f"""
SELECT measurement_id + 2 AS row_number, 'k' AS "column", 'Expected Integer' AS error, k AS cell FROM {_CELLS_SQL}
WHERE trim(k) <> '' AND NOT regexp_matches(trim(k), '^[+-]?[0-9]+$')
UNION ALL SELECT measurement_id + 2, 'flag', 'Expected Boolean', flag FROM {_CELLS_SQL}
WHERE trim(flag) <> '' AND lower(trim(flag)) NOT IN ('true', 'false', 'yes', 'no', '1', '0')""", "measurements"))
def cell_validation_types(spark, d):
    from envspark.operators.normalize import validation_report

    i = F.col("measurement_id")
    k = F.when(i % 6 == 0, i.cast("string")).when(i % 6 == 1, "1.5").when(i % 6 == 2, " -7 ").when(i % 6 == 3, "x").when(i % 6 == 4, "")
    flag = F.when(i % 5 == 0, "True").when(i % 5 == 1, "no").when(i % 5 == 2, "0").when(i % 5 == 3, "maybe").otherwise(" ")
    cells = B.measurements(spark, d).select(i.alias("_row"), k.alias("k"), flag.alias("flag"))
    return validation_report(cells, {"k": "integer", "flag": "boolean"})


# ---- M2, M3, M5 --------------------------------------------------------------------------------------------------------

STEPS = 24
_LOW = [v.lower() for v in E_VARS]


@register("sequence_windows", _sql_with(FEATURES_SQL + f""",
w AS (SELECT station_id, bucket, pm25 AS target, row_number() OVER s AS rn, {', '.join(
    f'sum({v}) OVER b AS {v}_sum, first_value({v}) OVER b AS {v}_first, last_value({v}) OVER b AS {v}_last' for v in _LOW)}
  FROM feat WINDOW s AS (PARTITION BY station_id ORDER BY bucket),
                   b AS (PARTITION BY station_id ORDER BY bucket ROWS BETWEEN {STEPS} PRECEDING AND 1 PRECEDING))
SELECT station_id, bucket, {R6('target')} AS target, CAST({STEPS} AS INTEGER) AS n_steps, {', '.join(
    f'{R6(f"{v}_{how}")} AS {v}_{how}' for v in _LOW for how in ('sum', 'first', 'last'))}
FROM w WHERE rn > {STEPS} AND target IS NOT NULL""", "measurements"))
def sequence_windows(spark, d):
    rows = M.sequence_windows(_features(spark, d), _LOW, "pm25", STEPS)
    total = lambda v: F.aggregate(F.filter("sequence", lambda x: x[v].isNotNull()), F.lit(0.0), lambda a, x: a + x[v])
    some = lambda v: F.exists("sequence", lambda x: x[v].isNotNull())
    out = rows.select("station_id", "bucket", "target", F.size("sequence").alias("n_steps"), *[
        c for v in _LOW for c in (F.when(some(v), total(v)).alias(f"{v}_sum"), F.element_at("sequence", 1)[v].alias(f"{v}_first"),
                                  F.element_at("sequence", -1)[v].alias(f"{v}_last"))])
    return r6(out, "target", *[f"{v}_{how}" for v in _LOW for how in ("sum", "first", "last")])


@register("minmax_scaled_by_train", _sql_with(FEATURES_SQL + f""",
cut AS (SELECT station_id, bucket, pm25, pm10, row_number() OVER (PARTITION BY station_id ORDER BY bucket)
               <= floor(count(*) OVER (PARTITION BY station_id) * 0.8) AS train FROM feat),
fit AS (SELECT min(pm25) AS a, max(pm25) AS b, min(pm10) AS c, max(pm10) AS e FROM cut WHERE train)
SELECT station_id, bucket, CASE WHEN train THEN 'train' ELSE 'test' END AS split,
       {R6('CASE WHEN b > a THEN (pm25 - a) / (b - a) ELSE 0.0 END')} AS pm25_scaled,
       {R6('CASE WHEN e > c THEN (pm10 - c) / (e - c) ELSE 0.0 END')} AS pm10_scaled
FROM cut, fit""", "measurements"))
def minmax_scaled_by_train(spark, d):
    rows = M.chrono_split(_features(spark, d).select("station_id", "bucket", "pm25", "pm10"), 0.8)
    fit = M.minmax_fit(rows.where("split = 'train'"), ["pm25", "pm10"])
    return r6(M.minmax_transform(rows, fit, ["pm25", "pm10"], ["station_id", "bucket", "split"]), "pm25_scaled", "pm10_scaled")


@register("regressor_summary", _sql_with(FEATURES_SQL + """
SELECT kind, count(*) AS n, CAST(6 AS INTEGER) AS n_features, CAST(1 AS DOUBLE) AS importance_sum, true AS better_than_mean
FROM feat, (VALUES ('forest'), ('boosting')) k(kind) WHERE pm25 IS NOT NULL GROUP BY kind""", "measurements"))
def regressor_summary(spark, d):
    f = _features(spark, d)
    inputs = ["pm10", "no2", "o3", "co", "hour", "dow"]
    out = M.regressor_summary(f, "pm25", inputs, "forest").unionByName(
        M.regressor_summary(f, "pm25", inputs, "boosting", num_trees=10, max_depth=5))
    return r6(out.drop("rmse"), "importance_sum")


# ---- Hourly partials kept beside the load table (two loads), and read by A1, A4, A7, A9, A11, A21 ---------------------------

_LOADED = """
loaded AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_code, variable_code, observed_at
                                                                  ORDER BY measurement_id DESC) AS rn FROM measurements) WHERE rn = 1)"""


def _loaded_sql(body: str) -> str:
    return _sql_with(_LOADED + body, "measurements")


def _kept_partials(spark, d):
    """The partials of a table that two loads filled, each followed by a refresh."""
    from envspark.plans.load_job import load_measurements
    from envspark.sources import versions as V

    work = _work_dir(spark, "partials")
    rows = B.measurements(spark, d).withColumn("load_order", F.col("measurement_id"))
    for half in (rows.where("measurement_id % 2 = 0"), rows.where("measurement_id % 2 = 1")):
        load_measurements(spark, half, os.path.join(work, "table"))
        P.refresh(spark, os.path.join(work, "table"), os.path.join(work, "hourly"))
    return V.read(spark, os.path.join(work, "hourly"))


@register("partials_series_day", _loaded_sql(_resample_sql("loaded", SQL_BUCKET["day"])))
def partials_series_day(spark, d):
    return r6(P.resample(_kept_partials(spark, d), "day"), "value")


@register("partials_heatmap", _loaded_sql("," + HEAT_CELLS.format(n=14).replace("FROM measurements", "FROM loaded") + f"""
SELECT day, hour, {R6('mean_value')} AS mean_value, n FROM hm"""))
def partials_heatmap(spark, d):
    return r6(P.heatmap(_kept_partials(spark, d), 14), "mean_value")


# Q3 + Q17 over the stored table: the day range and the variables leave out whole folders, the DATE column row groups.
RANGE = (date(2024, 1, 9), date(2024, 1, 17))


@register("stored_range", _loaded_sql(f"""
SELECT station_code, variable_code, observed_at, value FROM loaded
WHERE CAST(observed_at AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' AND variable_code IN ('NO2', 'O3')"""))
def stored_range(spark, d):
    from envspark.plans.load_job import load_measurements, read_measurements

    table = os.path.join(_work_dir(spark, "stored"), "table")
    load_measurements(spark, B.measurements(spark, d).withColumn("load_order", F.col("measurement_id")), table)
    rows = read_measurements(spark, table, *RANGE, variables=["NO2", "O3"])
    return Q.apply_filters(rows, Q.Filters(date_from=RANGE[0], date_to=RANGE[1])).select(
        "station_code", "variable_code", "observed_at", "value")


def _fresh_partials(spark, d):
    return P.hourly(B.measurements(spark, d))


@register("partials_series_week_max", sql(_resample_sql("measurements", SQL_BUCKET["week"], agg="max"), "measurements"))
def partials_series_week_max(spark, d):
    return r6(P.resample(_fresh_partials(spark, d), "week", agg="max"), "value")


@register("partials_seasonal_weekday", sql(_seasonal_sql("measurements", "weekday"), "measurements"))
def partials_seasonal_weekday(spark, d):
    return r6(P.seasonal_profile(_fresh_partials(spark, d), "weekday"), "value")


@register("partials_station_means", sql(f"""
SELECT station_code, {R6('avg(value)')} AS avg_value, count(*) AS n FROM measurements GROUP BY station_code""", "measurements"))
def partials_station_means(spark, d):
    return r6(P.station_means(_fresh_partials(spark, d)), "avg_value")


@register("partials_summary", _sql_with(f"""
p AS ({_points_sql('measurements', SQL_BUCKET['day'], None)}),
ends AS (SELECT arg_max(value, bucket) - arg_min(value, bucket) AS delta FROM p)
SELECT count(value) AS samples, {R6('avg(value)')} AS mean, min(value) AS min, max(value) AS max,
       CASE WHEN max(abs(delta)) <= greatest(0.05, abs(avg(value)) * 0.02) THEN 'Stable' WHEN max(delta) > 0 THEN 'Rising' ELSE 'Falling' END AS trend
FROM measurements, ends""", "measurements"))
def partials_summary(spark, d):
    parts = _fresh_partials(spark, d)
    return r6(P.summary_trend(parts, P.resample(parts, "day")), "mean")


@register("partials_diurnal", sql(f"""
SELECT CAST(floor(hour(observed_at) / 4) * 4 AS INT) AS block,
       {', '.join(R6(f"avg(CASE WHEN variable_code = '{v}' THEN value END)") + f' AS {v}' for v in E_VARS)}
FROM measurements GROUP BY 1""", "measurements"))
def partials_diurnal(spark, d):
    return r6(P.diurnal_composite(_fresh_partials(spark, d), E_VARS), *E_VARS)
