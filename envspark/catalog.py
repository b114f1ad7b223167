"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with the DuckDB statement of each.

Every query reads the given tables through ``envspark.binding`` (or data Spark derives from them), over the
whole tables. Float outputs are rounded half-up to 6 decimals (same rule in the SQL) so both engines agree.
"""

from __future__ import annotations

import os
from datetime import date
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark import binding as B
from envspark.functions.text import round6
from envspark.oracle import R6, sql
from envspark.operators import queries as Q
from envspark.operators import timeseries as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

E_VARS = ["PM25", "PM10", "NO2", "O3", "CO"]


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[round6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def _dims(spark, d):
    return (B.measurements(spark, d), B.stations(spark, d), B.variables(spark, d), B.source_files(spark, d))


def _star(spark, d):
    return Q.star(*_dims(spark, d))


STAR_SQL_COLS = ("measurement_id, observed_at, value, unit, station_code, station_name, variable_code, "
                 "variable_name, source_file_id, source_file_name, source_type")

# ---------------------------------------------------------------------------------------------------------
# Q1-Q4
# ---------------------------------------------------------------------------------------------------------


@register("star_query", sql(f"SELECT {STAR_SQL_COLS} FROM star", "star"))
def star_query(spark, d):
    return _star(spark, d)


IN_FILTERS = Q.Filters(source_file_ids=[1, 2, 3, 5, 8, 13, 21, 34], station_codes=["ST01", "ST03", "ST07", "ST12"],
                       variable_codes=["PM25", "NO2"])


@register("in_filters", sql(f"""SELECT {STAR_SQL_COLS} FROM star
WHERE source_file_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND station_code IN ('ST01', 'ST03', 'ST07', 'ST12')
  AND variable_code IN ('PM25', 'NO2')""", "star"))
def in_filters(spark, d):
    return Q.apply_filters(_star(spark, d), IN_FILTERS)


DATE_RANGE = Q.Filters(date_from=date(2024, 1, 12), date_to=date(2024, 1, 5))  # reversed on purpose (Q19)


@register("date_range", sql(f"""SELECT {STAR_SQL_COLS} FROM star
WHERE observed_at >= TIMESTAMP '2024-01-05 00:00:00' AND observed_at < TIMESTAMP '2024-01-13 00:00:00'""", "star"))
def date_range(spark, d):
    return Q.apply_filters(_star(spark, d), DATE_RANGE)


CAPPED_FILES = [2, 3]


@register("capped_query", sql(f"""
SELECT {STAR_SQL_COLS}, truncated FROM (
  SELECT *, row_number() OVER (ORDER BY observed_at, station_code, variable_code, measurement_id) AS rn,
         count(*) OVER () > (SELECT CASE WHEN c > 0 THEN least(100, c) ELSE 100 END
                             FROM (SELECT count(*) AS c FROM measurements WHERE source_file_id IN (2, 3))) AS truncated
  FROM star WHERE source_file_id IN (2, 3) AND station_code <> 'ST00')
WHERE rn <= (SELECT CASE WHEN c > 0 THEN least(100, c) ELSE 100 END
             FROM (SELECT count(*) AS c FROM measurements WHERE source_file_id IN (2, 3)))""", "star", "measurements"))
def capped_query(spark, d):
    facts = B.measurements(spark, d)
    cap = Q.dataset_cap(facts, CAPPED_FILES, 100)
    rows = Q.apply_filters(_star(spark, d), Q.Filters(source_file_ids=CAPPED_FILES))
    return Q.capped(rows.where(F.col("station_code") != "ST00"), cap)


# ---------------------------------------------------------------------------------------------------------
# Q5-Q9
# ---------------------------------------------------------------------------------------------------------

@register("filter_sources", sql("""
SELECT f.source_file_id, original_name, source_type, etl_run_id, downloaded_at, c.measurement_count
FROM source_files f JOIN (SELECT source_file_id, count(*) AS measurement_count FROM measurements
                          GROUP BY source_file_id) c ON f.source_file_id = c.source_file_id
WHERE status = 'completed' AND c.measurement_count > 0
ORDER BY downloaded_at DESC, measurement_count DESC, f.source_file_id DESC LIMIT 300""",
                                "source_files", "measurements"))
def filter_sources(spark, d):
    return Q.filter_sources(B.measurements(spark, d), B.source_files(spark, d))


@register("filter_stations", sql("""
SELECT s.code, s.name, s.latitude, s.longitude, r.ref_region AS region
FROM stations_ref s LEFT JOIN resolved_ref x ON s.station_id = x.station_id
LEFT JOIN ref_stations r ON x.ref_order = r.ref_order""", "stations_ref", "resolved_ref", "ref_stations"))
def filter_stations(spark, d):
    return Q.filter_stations(B.stations_ref(spark, d))


@register("filter_variables", sql("SELECT code, display_name AS name FROM variables", "variables"))
def filter_variables(spark, d):
    return Q.filter_variables(B.variables(spark, d))


@register("time_extent", sql("SELECT min(observed_at) AS min_observed_at, max(observed_at) AS max_observed_at "
                             "FROM measurements", "measurements"))
def time_extent(spark, d):
    return Q.time_extent(B.measurements(spark, d))


LATEST_SQL = """
latest AS (
  SELECT s.code AS station_code, s.name AS station_name, s.latitude, s.longitude, v.code AS variable_code,
         v.display_name AS variable_name, m.value, m.unit, m.observed_at
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id, variable_id
                                     ORDER BY observed_at DESC, measurement_id DESC) AS rn
        FROM measurements) m
  JOIN {st} s ON m.station_id = s.station_id JOIN variables v ON m.variable_id = v.variable_id
  WHERE rn = 1)"""


def _with_latest(body: str, stations: str, *names: str) -> str:
    base = sql("SELECT 1", "measurements", "variables", stations, *names)
    head = base[: base.rindex("\nSELECT 1")]
    return head + ",\n" + LATEST_SQL.format(st=stations).strip() + "\n" + body.strip()


@register("latest_values", _with_latest("SELECT * FROM latest", "stations"))
def latest_values(spark, d):
    return Q.latest_values(B.measurements(spark, d), B.stations(spark, d), B.variables(spark, d))


@register("live_snapshot", _with_latest("""
SELECT l.station_code, l.station_name, coalesce(l.latitude, r.ref_latitude) AS latitude,
       coalesce(l.longitude, r.ref_longitude) AS longitude, r.ref_region AS region,
       l.n_variables, l.latest_observed_at, count(*) OVER () AS total,
       max(l.latest_observed_at) OVER () AS global_latest_observed_at
FROM (SELECT station_code, station_name, latitude, longitude, count(*) AS n_variables,
             max(observed_at) AS latest_observed_at
      FROM latest GROUP BY station_code, station_name, latitude, longitude) l
LEFT JOIN resolved_ref x ON l.station_code = x.code LEFT JOIN ref_stations r ON x.ref_order = r.ref_order""",
                                        "stations_ref", "resolved_ref", "ref_stations"))
def live_snapshot(spark, d):
    st = B.stations_ref(spark, d)
    latest = Q.latest_values(B.measurements(spark, d), st, B.variables(spark, d))
    return Q.live_snapshot(latest, st)


# ---------------------------------------------------------------------------------------------------------
# Q10-Q20, S10
# ---------------------------------------------------------------------------------------------------------

PREVIEW_SQL = ("SELECT station_code, variable_code, count(*) AS n FROM measurements "
               "GROUP BY station_code, variable_code ORDER BY station_code, variable_code;")


def register_views(spark: SparkSession, d: str) -> None:
    """Expose the bound model tables as temp views (for SQL preview)."""
    B.measurements(spark, d).createOrReplaceTempView("measurements")
    B.stations(spark, d).createOrReplaceTempView("stations")
    B.variables(spark, d).createOrReplaceTempView("variables")
    B.source_files(spark, d).createOrReplaceTempView("source_files")
    B.etl_runs(spark, d).createOrReplaceTempView("etl_runs")


@register("sql_preview", sql("""
SELECT station_code, variable_code, n, (SELECT count(*) FROM (SELECT DISTINCT station_code, variable_code
                                                              FROM measurements)) > 120 AS truncated
FROM (SELECT station_code, variable_code, count(*) AS n FROM measurements GROUP BY station_code, variable_code
      ORDER BY station_code, variable_code LIMIT 120)""", "measurements"))
def sql_preview(spark, d):
    from envspark.plans.sqlguard import preview

    register_views(spark, d)
    return preview(spark, PREVIEW_SQL, 120)


@register("table_samples", sql("""
SELECT measurement_id, station_id, station_code, variable_id, variable_code, observed_at, value, unit, source_file_id
FROM measurements ORDER BY observed_at DESC, measurement_id DESC LIMIT 120""", "measurements"))
def table_samples(spark, d):
    return Q.table_sample(B.measurements(spark, d), "measurements")


@register("station_list", sql("""
SELECT station_id, code, name, coalesce(latitude, 0.0) AS latitude, coalesce(longitude, 0.0) AS longitude,
       count(*) OVER () AS total FROM stations""", "stations"))
def station_list(spark, d):
    return Q.station_list(B.stations(spark, d))


@register("run_list", sql("SELECT * FROM etl_runs ORDER BY started_at DESC, id DESC LIMIT 20", "etl_runs"))
def run_list(spark, d):
    return Q.run_list(B.etl_runs(spark, d), 20)


@register("store_metrics", sql("""
SELECT (SELECT count(*) FROM measurements) AS total_measurements, (SELECT count(*) FROM stations) AS total_stations,
       (SELECT count(*) FROM variables) AS total_variables,
       coalesce((SELECT status FROM etl_runs ORDER BY started_at DESC, id DESC LIMIT 1), 'never-run')
         AS last_run_status""", "measurements", "stations", "variables", "etl_runs"))
def store_metrics(spark, d):
    return Q.store_metrics(B.measurements(spark, d), B.stations(spark, d), B.variables(spark, d),
                           B.etl_runs(spark, d))


@register("run_preview", sql(f"""
SELECT {STAR_SQL_COLS} FROM star
WHERE source_file_id IN (SELECT source_file_id FROM source_files
                         WHERE etl_run_id = (SELECT id FROM etl_runs ORDER BY started_at DESC, id DESC LIMIT 1))
ORDER BY observed_at DESC, station_code, variable_code, measurement_id DESC LIMIT 100""",
                             "star", "etl_runs"))
def run_preview(spark, d):
    m, s, v, f = _dims(spark, d)
    return Q.run_preview(m, s, v, f, B.etl_runs(spark, d), None, 100)


@register("source_search", sql("""
SELECT * FROM source_files
WHERE contains(lower(concat_ws(' ', original_name, source_type, etl_run_id)), 'manual')""", "source_files"))
def source_search(spark, d):
    return Q.source_search(B.source_files(spark, d), "  Manual ")


@register("range_preset_7d", sql(f"""
SELECT {STAR_SQL_COLS} FROM star
WHERE CAST(observed_at AS DATE) >= greatest((SELECT CAST(max(observed_at) AS DATE) FROM measurements) - 6,
                                            (SELECT CAST(min(observed_at) AS DATE) FROM measurements))
  AND CAST(observed_at AS DATE) <= (SELECT CAST(max(observed_at) AS DATE) FROM measurements)""",
                                 "star", "measurements"))
def range_preset_7d(spark, d):
    return Q.apply_preset(_star(spark, d), B.measurements(spark, d), "7d")


@register("first_rows", sql(f"""
SELECT {STAR_SQL_COLS} FROM star ORDER BY observed_at, station_code, variable_code, measurement_id LIMIT 180""",
                            "star"))
def first_rows(spark, d):
    return Q.first_rows(_star(spark, d), 180)


# ---------------------------------------------------------------------------------------------------------
# A1-A3
# ---------------------------------------------------------------------------------------------------------

def _resample_sql(src: str, bucket: str, series: str = "variable_code", agg: str = "avg") -> str:
    return f"""
SELECT bucket, series, {R6('value')} AS value, n FROM (
  SELECT {bucket} AS bucket, {series} AS series, {agg}(value) AS value, count(value) AS n
  FROM {src} GROUP BY 1, 2
  UNION ALL
  SELECT {bucket} AS bucket, 'overall' AS series, {agg}(value) AS value, count(value) AS n
  FROM {src} GROUP BY 1)"""


SQL_BUCKET = {
    "hour": "strftime(observed_at, '%Y-%m-%d %H:00')",
    "day": "strftime(observed_at, '%Y-%m-%d')",
    "week": "strftime(date_trunc('week', observed_at), '%Y-%m-%d')",
    "month": "strftime(observed_at, '%Y-%m')",
    "year": "strftime(observed_at, '%Y')",
}


def _resample(df, gran, series="variable_code", agg="avg"):
    return r6(A.resample(df, gran, series, agg), "value")


@register("series_hour", sql(_resample_sql("measurements", SQL_BUCKET["hour"]), "measurements"))
def series_hour(spark, d):
    return _resample(B.measurements(spark, d), "hour")


@register("series_day", sql(_resample_sql("measurements", SQL_BUCKET["day"]), "measurements"))
def series_day(spark, d):
    return _resample(B.measurements(spark, d), "day")


@register("series_month", sql(_resample_sql("measurements_li", SQL_BUCKET["month"]), "measurements_li"))
def series_month(spark, d):
    return _resample(B.measurements_li(spark, d), "month")


@register("series_year", sql(_resample_sql("measurements_li", SQL_BUCKET["year"]), "measurements_li"))
def series_year(spark, d):
    return _resample(B.measurements_li(spark, d), "year")


@register("series_by_station", sql(_resample_sql("measurements", SQL_BUCKET["day"], "station_code"),
                                   "measurements"))
def series_by_station(spark, d):
    return _resample(B.measurements(spark, d), "day", "station_code")


@register("series_topk", sql("""
SELECT series, n FROM (SELECT variable_code AS series, count(*) AS n, min(observed_at) AS first_seen
                       FROM measurements GROUP BY 1 ORDER BY n DESC, first_seen, series LIMIT 4)""",
                             "measurements"))
def series_topk(spark, d):
    return A.series_rank(B.measurements(spark, d), "variable_code", 4)


@register("series_pivot", sql(f"""
SELECT {SQL_BUCKET['day']} AS bucket,
       {', '.join(f"{R6(f'avg(CASE WHEN variable_code = {chr(39)}{v}{chr(39)} THEN value END)')} AS {v}" for v in E_VARS)},
       {R6('avg(value)')} AS overall
FROM measurements GROUP BY 1""", "measurements"))
def series_pivot(spark, d):
    return r6(A.series_pivot(B.measurements(spark, d), "day", "variable_code", E_VARS), *E_VARS, "overall")


# ---------------------------------------------------------------------------------------------------------
# A4-A8, A14
# ---------------------------------------------------------------------------------------------------------

@register("station_means", sql(f"""
SELECT station_code, {R6('avg(value)')} AS avg_value, count(*) AS n FROM measurements GROUP BY station_code""",
                               "measurements"))
def station_means(spark, d):
    return r6(A.station_means(B.measurements(spark, d)), "avg_value")


@register("hour_scatter", sql(f"""
SELECT station_code, floor((hour(observed_at) + minute(observed_at) / 60.0) * 100 + 0.5) / 100 AS hour, value,
       observed_at, variable_code, measurement_id
FROM star ORDER BY observed_at, station_code, variable_code, measurement_id LIMIT 4000""", "star"))
def hour_scatter(spark, d):
    return A.hour_scatter(_star(spark, d), Q.ORDER_KEYS)


HIST_SQL = f"""
st AS (SELECT min(value) AS mn, max(value) AS mx, count(value) AS n FROM measurements),
b AS (SELECT CASE WHEN abs(mx - mn) < 1e-9 THEN 0
                  ELSE least(15, CAST(floor((value - mn) / ((mx - mn) / 16.0)) AS INT)) END AS bin
      FROM measurements, st WHERE value IS NOT NULL),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin)
SELECT CAST(g.bin AS INT) AS bin,
       {R6("CASE WHEN abs(mx - mn) < 1e-9 THEN mn ELSE mn + ((mx - mn) / 16.0) * g.bin END")} AS bin_start,
       {R6("CASE WHEN abs(mx - mn) < 1e-9 THEN mx ELSE mn + ((mx - mn) / 16.0) * g.bin + ((mx - mn) / 16.0) END")} AS bin_end,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INT) AS bin FROM range(16)) g CROSS JOIN st LEFT JOIN c ON g.bin = c.bin
WHERE (abs(mx - mn) >= 1e-9 OR g.bin = 0) AND n > 0"""


def _sql_with(extra: str, *names: str) -> str:
    if not names:
        return "WITH " + extra.strip()
    base = sql("SELECT 1", *names)
    head = base[: base.rindex("\nSELECT 1")]
    return head + ",\n" + extra.strip()


@register("histogram", _sql_with(HIST_SQL, "measurements"))
def histogram(spark, d):
    return r6(A.histogram(B.measurements(spark, d)), "bin_start", "bin_end")


HEAT_CELLS = """
cells AS (SELECT strftime(observed_at, '%Y-%m-%d') AS day, CAST(hour(observed_at) AS INT) AS hour,
                 avg(value) AS mean_value, count(*) AS n FROM measurements GROUP BY 1, 2),
days AS (SELECT day FROM (SELECT DISTINCT day FROM cells) ORDER BY day DESC LIMIT {n}),
hm AS (SELECT * FROM cells WHERE day IN (SELECT day FROM days))"""


@register("heatmap", _sql_with(HEAT_CELLS.format(n=14) + f"""
SELECT day, hour, {R6('mean_value')} AS mean_value, n FROM hm""", "measurements"))
def heatmap(spark, d):
    return r6(A.heatmap(B.measurements(spark, d), 14), "mean_value")


@register("heatmap_page", _sql_with(HEAT_CELLS.format(n=30) + f""",
tot AS (SELECT count(*) AS total FROM (SELECT DISTINCT day FROM hm)),
rk AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS r FROM (SELECT DISTINCT day FROM hm)),
off AS (SELECT least(3, greatest(0, total - 10)) AS o FROM tot)
SELECT day, hour, {R6('mean_value')} AS mean_value, n FROM hm
WHERE day IN (SELECT day FROM rk, off WHERE r > o AND r <= o + 10)""", "measurements"))
def heatmap_page(spark, d):
    return r6(A.heatmap_page(B.measurements(spark, d), window_days=10, offset=3, n_days=30), "mean_value")


@register("heat_scale", _sql_with(HEAT_CELLS.format(n=14) + f"""
SELECT day, hour, {R6('mean_value')} AS mean_value, n,
       {R6("CASE WHEN (SELECT max(mean_value) FROM hm) <= (SELECT min(mean_value) FROM hm) THEN 0.0 ELSE "
           "(mean_value - (SELECT min(mean_value) FROM hm)) / ((SELECT max(mean_value) FROM hm) - "
           "(SELECT min(mean_value) FROM hm)) END")} AS intensity
FROM hm""", "measurements"))
def heat_scale(spark, d):
    cells = A.heatmap(B.measurements(spark, d), 14)
    return r6(A.heat_scale(cells), "mean_value", "intensity")


# ---------------------------------------------------------------------------------------------------------
# A9-A13
# ---------------------------------------------------------------------------------------------------------

def _points_sql(src: str, bucket: str, series: str | None) -> str:
    """Points (bucket, series, value) in SQL: per-series means, or the overall series alone."""
    if series:
        return f"SELECT {bucket} AS bucket, {series} AS series, avg(value) AS value FROM {src} GROUP BY 1, 2"
    return f"SELECT {bucket} AS bucket, 'overall' AS series, avg(value) AS value FROM {src} GROUP BY 1"


def _points(df, gran, series):
    pts = A.resample(df, gran, series, with_overall=series is None)
    return pts.select("bucket", "series", "value")


@register("summary_trend", _sql_with(f"""
p AS ({_points_sql('measurements', SQL_BUCKET['day'], None)}),
ends AS (SELECT count(*) AS n_points, arg_max(value, bucket) - arg_min(value, bucket) AS delta FROM p)
SELECT count(value) AS samples, {R6('coalesce(avg(value), 0.0)')} AS mean, coalesce(min(value), 0.0) AS min,
       coalesce(max(value), 0.0) AS max,
       CASE WHEN count(value) = 0 OR max(n_points) < 2 THEN 'Stable'
            WHEN max(delta) > greatest(0.05, abs(avg(value)) * 0.02) THEN 'Rising'
            WHEN max(delta) < -greatest(0.05, abs(avg(value)) * 0.02) THEN 'Falling'
            ELSE 'Stable' END AS trend
FROM measurements, ends""", "measurements"))
def summary_trend(spark, d):
    m = B.measurements(spark, d)
    return r6(A.summary_trend(m, A.resample(m, "day", "variable_code")), "mean")


def _rolling_sql(src: str, bucket: str, series: str | None, w: int) -> str:
    return f"""
SELECT bucket, series, {R6('value')} AS value, {R6('mean')} AS mean, {R6('mean + sd')} AS upper,
       {R6('mean - sd')} AS lower FROM (
  SELECT bucket, series, value,
         avg(value) OVER (PARTITION BY series ORDER BY bucket ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS mean,
         stddev_pop(value) OVER (PARTITION BY series ORDER BY bucket ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS sd
  FROM ({_points_sql(src, bucket, series)}))"""


def _rolling(df, gran, series, w):
    return r6(A.rolling_band(_points(df, gran, series), w), "value", "mean", "upper", "lower")


@register("rolling_band", sql(_rolling_sql("measurements_li", SQL_BUCKET["day"], None, 14), "measurements_li"))
def rolling_band(spark, d):
    return _rolling(B.measurements_li(spark, d), "day", None, 14)


@register("rolling_band_by_series", sql(_rolling_sql("measurements", SQL_BUCKET["hour"], "station_code", 24),
                                        "measurements"))
def rolling_band_by_series(spark, d):
    return _rolling(B.measurements(spark, d), "hour", "station_code", 24)


SEASONAL_SQL = {
    "weekday": ("(['Sun','Mon','Tue','Wed','Thu','Fri','Sat'])[dayofweek(observed_at) + 1]", "dayofweek(observed_at)"),
    "month": ("strftime(observed_at, '%m')", "month(observed_at)"),
    "hour": ("strftime(observed_at, '%H')", "hour(observed_at)"),
}


def _seasonal_sql(src: str, mode: str) -> str:
    key, order = SEASONAL_SQL[mode]
    return (f"SELECT {key} AS bucket, CAST({order} AS INT) AS sort_key, {R6('avg(value)')} AS value, "
            f"count(*) AS n FROM {src} GROUP BY 1, 2")


@register("seasonal_weekday", sql(_seasonal_sql("measurements", "weekday"), "measurements"))
def seasonal_weekday(spark, d):
    return r6(A.seasonal_profile(B.measurements(spark, d), "weekday"), "value")


@register("seasonal_month", sql(_seasonal_sql("measurements_li", "month"), "measurements_li"))
def seasonal_month(spark, d):
    return r6(A.seasonal_profile(B.measurements_li(spark, d), "month"), "value")


@register("seasonal_hour", sql(_seasonal_sql("measurements", "hour"), "measurements"))
def seasonal_hour(spark, d):
    return r6(A.seasonal_profile(B.measurements(spark, d), "hour"), "value")


def _acf_sql(src: str, bucket: str, series: str | None) -> str:
    return f"""
WITH_P AS_P
SELECT x.series, CAST(k.lag AS INT) AS lag, {R6('sum(x.d * y.d) / max(s.den)')} AS acf
FROM c x JOIN (SELECT range AS lag FROM range(1, 31)) k ON true
JOIN c y ON y.series = x.series AND y.idx = x.idx - k.lag
JOIN s ON s.series = x.series
WHERE s.n >= 3 AND s.den > 1e-12 AND k.lag <= s.n - 2
GROUP BY x.series, k.lag"""


def _acf_full_sql(src: str, bucket: str, series: str | None, *ctes: str) -> str:
    body = _acf_sql(src, bucket, series).replace("WITH_P AS_P", "")
    extra = f"""
p AS ({_points_sql(src, bucket, series)}),
c AS (SELECT series, bucket, value - avg(value) OVER (PARTITION BY series) AS d,
             row_number() OVER (PARTITION BY series ORDER BY bucket) AS idx FROM p),
s AS (SELECT series, count(*) AS n, sum(d * d) AS den FROM c GROUP BY series)"""
    return _sql_with(extra + "\n" + body.strip(), *ctes)


def _acf(df, gran, series):
    return r6(A.autocorrelation(_points(df, gran, series), 30), "acf")


@register("autocorrelation", _acf_full_sql("measurements_li", SQL_BUCKET["day"], None, "measurements_li"))
def autocorrelation(spark, d):
    return _acf(B.measurements_li(spark, d), "day", None)


@register("autocorrelation_by_series", _acf_full_sql("measurements", SQL_BUCKET["day"], "station_code",
                                                     "measurements"))
def autocorrelation_by_series(spark, d):
    return _acf(B.measurements(spark, d), "day", "station_code")


def _iqr_sql(src: str, bucket: str, series: str | None, *ctes: str) -> str:
    extra = f"""
p AS ({_points_sql(src, bucket, series)}),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value) AS rn,
             count(*) OVER (PARTITION BY series) AS n FROM p),
q AS (SELECT series, max(CASE WHEN rn = floor(n * 0.25) + 1 THEN value END) AS q1,
             max(CASE WHEN rn = floor(n * 0.75) + 1 THEN value END) AS q3, max(n) AS n FROM r GROUP BY series),
f AS (SELECT p.bucket, p.series, p.value, q.n, q.q1 - (q.q3 - q.q1) * 1.5 AS lo, q.q3 + (q.q3 - q.q1) * 1.5 AS hi
      FROM p JOIN q ON p.series = q.series)
SELECT bucket, series, {R6('value')} AS value,
       CASE WHEN n >= 5 THEN CAST(value < lo OR value > hi AS INT) END AS is_anomaly,
       CASE WHEN n >= 5 AND (value < lo OR value > hi) THEN {R6('value')} END AS anomaly_value,
       CASE WHEN n >= 5 THEN {R6('lo')} END AS lower, CASE WHEN n >= 5 THEN {R6('hi')} END AS upper
FROM f"""
    return _sql_with(extra, *ctes)


def _iqr(df, gran, series):
    return r6(A.iqr_anomalies(_points(df, gran, series)), "value", "anomaly_value", "lower", "upper")


@register("iqr_anomalies", _iqr_sql("measurements_li", SQL_BUCKET["day"], None, "measurements_li"))
def iqr_anomalies(spark, d):
    return _iqr(B.measurements_li(spark, d), "day", None)


@register("iqr_anomalies_by_series", _iqr_sql("measurements", SQL_BUCKET["hour"],
                                              "concat(station_code, '/', variable_code)", "measurements"))
def iqr_anomalies_by_series(spark, d):
    m = B.measurements(spark, d).withColumn("series_key", F.concat_ws("/", "station_code", "variable_code"))
    return _iqr(m, "hour", "series_key")


# ---------------------------------------------------------------------------------------------------------
# A15-A22
# ---------------------------------------------------------------------------------------------------------

@register("pollution_band", _with_latest(f"""
SELECT station_code, pm25, pm10, no2, o3, {R6('score')} AS score,
       CASE WHEN score <= 1.5 THEN 'green' WHEN score <= 3.0 THEN 'yellow' WHEN score <= 4.5 THEN 'orange'
            ELSE 'red' END AS band
FROM (SELECT *, (coalesce(pm25, 0.0) * 1.0 + coalesce(pm10, 0.0) * 0.5 + coalesce(no2, 0.0) * 0.5
                 + coalesce(o3, 0.0) * 0.3) / 50.0 AS score
      FROM (SELECT station_code, max(CASE WHEN variable_code = 'PM25' THEN value END) AS pm25,
                   max(CASE WHEN variable_code = 'PM10' THEN value END) AS pm10,
                   max(CASE WHEN variable_code = 'NO2' THEN value END) AS no2,
                   max(CASE WHEN variable_code = 'O3' THEN value END) AS o3
            FROM latest GROUP BY station_code))""", "stations"))
def pollution_band(spark, d):
    latest = Q.latest_values(B.measurements(spark, d), B.stations(spark, d), B.variables(spark, d))
    return r6(A.pollution_band(latest), "score")


@register("aqi_band", sql("""
SELECT station_code, count(*) AS n, CAST(count_if(aqi <= 50) AS BIGINT) AS n_good,
       CAST(count_if(aqi > 50 AND aqi <= 100) AS BIGINT) AS n_moderate, CAST(count_if(aqi > 100) AS BIGINT) AS n_unhealthy,
       CAST(count_if(aqi > 50) AS BIGINT) AS n_alerts
FROM (SELECT station_code, strftime(observed_at, '%Y-%m-%d %H:00') AS bucket, avg(value) AS aqi
      FROM measurements WHERE variable_code = 'PM25' GROUP BY 1, 2)
GROUP BY station_code""", "measurements"))
def aqi_band(spark, d):
    m = B.measurements(spark, d).where(F.col("variable_code") == "PM25")
    idx = A.resample(m, "hour", "station_code", with_overall=False).select(
        F.col("series").alias("station_code"), F.col("value").alias("aqi"))
    return A.aqi_alerts(idx)


@register("series_week", sql(_resample_sql("measurements", SQL_BUCKET["week"]), "measurements"))
def series_week(spark, d):
    return _resample(B.measurements(spark, d), "week")


def _corr_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(E_VARS) for b in E_VARS[i + 1:]]
    wide = ", ".join(f"avg(CASE WHEN variable_code = '{v}' THEN value END) AS {v}" for v in E_VARS)
    sel = "\nUNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, {R6(f'corr({a}, {b})')} AS corr, "
        f"CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n FROM w" for a, b in pairs)
    return _sql_with(f"""
w AS (SELECT station_code, strftime(observed_at, '%Y-%m-%d %H:00') AS bucket, {wide}
      FROM measurements GROUP BY 1, 2)
{sel}""", "measurements")


@register("correlation_matrix", _corr_sql())
def correlation_matrix(spark, d):
    return r6(A.correlation_matrix(B.measurements(spark, d), E_VARS, ["station_code"], "hour"), "corr")


@register("trend_slope", sql(f"""
SELECT series, {R6('regr_slope(value, CAST(CAST(bucket AS DATE) - DATE \'1970-01-01\' AS DOUBLE))')} AS slope,
       count(*) AS n
FROM ({_points_sql('measurements_li', SQL_BUCKET['day'], 'variable_code')}) GROUP BY series""", "measurements_li"))
def trend_slope(spark, d):
    return r6(A.trend_slope(_points(B.measurements_li(spark, d), "day", "variable_code")), "slope")


@register("agg_choice_max_day", sql(_resample_sql(
    "(SELECT m.* FROM measurements m JOIN variables v ON m.variable_id = v.variable_id WHERE v.category = 'pollutant')",
    SQL_BUCKET["day"], agg="max"), "measurements", "variables"))
def agg_choice_max_day(spark, d):
    m = B.measurements(spark, d)
    pol = m.join(B.variables(spark, d).where(F.col("category") == "pollutant").select("variable_id"), "variable_id",
                 "left_semi")
    return _resample(pol, "day", agg="max")


# Direction and speed are two measured series of E (PM10 read as degrees, PM25 as tenths of the speed), whose times do not
# meet; each speed takes the last direction of its station within the hour before it.
WIND_TOLERANCE_S = 3600


@register("wind_rose", _sql_with(f"""
dir AS (SELECT station_id, observed_at, arg_max(value, measurement_id) AS deg FROM measurements
        WHERE variable_code = 'PM10' AND value IS NOT NULL GROUP BY 1, 2),
vel AS (SELECT station_id, observed_at, value FROM measurements WHERE variable_code = 'PM25' AND value IS NOT NULL),
met AS (SELECT dir.deg - floor(dir.deg / 360) * 360 AS dir_deg, vel.value / 10 AS speed
        FROM vel ASOF JOIN dir ON vel.station_id = dir.station_id AND vel.observed_at >= dir.observed_at
        WHERE vel.observed_at - dir.observed_at <= INTERVAL {WIND_TOLERANCE_S} SECONDS),
n AS (SELECT CAST(floor((dir_deg + 11.25) / 22.5) % 16 AS INT) AS sector,
       CASE WHEN speed < 2 THEN '0-2' WHEN speed < 4 THEN '2-4' WHEN speed < 6 THEN '4-6' ELSE '6+' END AS speed_class,
       count(*) AS n FROM met GROUP BY 1, 2)
SELECT sector, speed_class, n, {R6('n / (SELECT sum(n) FROM n)')} AS share FROM n""", "measurements"))
def wind_rose(spark, d):
    met = A.as_of(B.measurements(spark, d), "PM25", "PM10", WIND_TOLERANCE_S)
    m = met.select((F.col("right") - F.floor(F.col("right") / 360) * 360).alias("dir_deg"), (F.col("left") / 10).alias("speed"))
    return r6(A.wind_rose(m), "share")


@register("diurnal_composite", sql(f"""
SELECT CAST(floor(hour(observed_at) / 4) * 4 AS INT) AS block,
       {', '.join(R6(f"avg(CASE WHEN variable_code = '{v}' THEN value END)") + f' AS {v}' for v in E_VARS)}
FROM measurements GROUP BY 1""", "measurements"))
def diurnal_composite(spark, d):
    return r6(A.diurnal_composite(B.measurements(spark, d), E_VARS, 4), *E_VARS)


RADIUS_KM = 5.0


def _haversine_sql(a: str, b: str) -> str:
    return (f"2 * 6371.0 * asin(sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + "
            f"cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * "
            f"pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)))")


@register("radius_join", _sql_with(f"""
pairs AS (SELECT x.station_id AS a, y.station_id AS b, {_haversine_sql('x', 'y')} AS distance_km
          FROM stations x JOIN stations y ON x.station_id < y.station_id
          WHERE x.latitude IS NOT NULL AND y.latitude IS NOT NULL AND x.longitude IS NOT NULL
            AND y.longitude IS NOT NULL AND {_haversine_sql('x', 'y')} <= {RADIUS_KM}),
h AS (SELECT station_id, variable_code, strftime(observed_at, '%Y-%m-%d %H:00') AS bucket, avg(value) AS v
      FROM measurements GROUP BY 1, 2, 3)
SELECT p.a, p.b, {R6('p.distance_km')} AS distance_km, ha.variable_code AS variable_a, hb.variable_code AS variable_b,
       count(*) AS n_hours, {R6('avg(ha.v)')} AS mean_a, {R6('avg(hb.v)')} AS mean_b, {R6('avg(abs(ha.v - hb.v))')} AS mean_abs_diff
FROM pairs p JOIN h ha ON ha.station_id = p.a JOIN h hb ON hb.station_id = p.b AND hb.bucket = ha.bucket
GROUP BY p.a, p.b, p.distance_km, ha.variable_code, hb.variable_code""", "measurements", "stations"))
def radius_join(spark, d):
    pairs = A.radius_pairs(B.stations(spark, d), RADIUS_KM)
    return r6(A.crossed_variables(B.measurements(spark, d), pairs), "distance_km", "mean_a", "mean_b", "mean_abs_diff")


# ---------------------------------------------------------------------------------------------------------
# N2, N7, N10, N13-N17 normalisation expressions over derived raw columns
# ---------------------------------------------------------------------------------------------------------

from envspark.functions import text as N  # noqa: E402
from envspark.oracle import NORM  # noqa: E402

WS = "' \\t\\n\\r\\x0b\\x0c'"


def SQL_CODE(x: str) -> str:
    core = f"replace(upper(trim({x}, ' \t\n\r\x0b\x0c')), ' ', '')"
    return f"(CASE WHEN {core} IN ('PM2.5', 'PM2_5', 'PM2-5') THEN 'PM25' ELSE {core} END)"


RAW_CODE_SQL = ("CASE measurement_id % 4 WHEN 0 THEN lower(variable_code) WHEN 1 THEN concat(' ', variable_code, ' ') "
                "WHEN 2 THEN replace(variable_code, 'PM25', 'pm2.5') ELSE replace(variable_code, 'PM25', 'PM 2_5') END")


def _raw_code(m):
    k = F.col("measurement_id") % 4
    v = F.col("variable_code")
    return (F.when(k == 0, F.lower(v)).when(k == 1, F.concat(F.lit(" "), v, F.lit(" ")))
            .when(k == 2, F.replace(v, F.lit("PM25"), F.lit("pm2.5")))
            .otherwise(F.replace(v, F.lit("PM25"), F.lit("PM 2_5"))))


@register("code_normalise", sql(f"""
SELECT measurement_id, raw, {SQL_CODE('raw')} AS code FROM (SELECT measurement_id, {RAW_CODE_SQL} AS raw
                                                           FROM measurements)""", "measurements"))
def code_normalise(spark, d):
    m = B.measurements(spark, d).select("measurement_id", _raw_code(B.measurements(spark, d)).alias("raw"))
    return m.select("measurement_id", "raw", N.normalize_code("raw").alias("code"))


@register("part_code_normalise", sql(f"SELECT p_partkey, {SQL_CODE('p_name')} AS code FROM part"))
def part_code_normalise(spark, d):
    from envspark.session import read_table

    return read_table(spark, d, "part").select("p_partkey", N.normalize_code("p_name").alias("code"))


@register("text_normalise", sql(f"SELECT doc_id, {NORM('text')} AS normalized FROM documents"))
def text_normalise(spark, d):
    from envspark.session import read_table

    return read_table(spark, d, "documents").select("doc_id", N.normalize_text("text").alias("normalized"))


@register("unit_resolve", sql("""
SELECT measurement_id, variable_code,
       coalesce(CASE WHEN raw_unit IS NULL OR trim(raw_unit, ' \t\n\r\x0b\x0c') = '' OR lower(raw_unit) = 'nan'
                     THEN NULL ELSE trim(raw_unit, ' \t\n\r\x0b\x0c') END,
                CASE variable_code WHEN 'CO' THEN 'mg/m3' ELSE 'ug/m3' END) AS unit
FROM (SELECT measurement_id, variable_code,
             CASE WHEN measurement_id % 2 = 0 THEN '' WHEN measurement_id % 5 = 1 THEN ' nan' ELSE unit END AS raw_unit
      FROM measurements)""", "measurements"))
def unit_resolve(spark, d):
    m = B.measurements(spark, d)
    k = F.col("measurement_id")
    raw = F.when(k % 2 == 0, F.lit("")).when(k % 5 == 1, F.lit(" nan")).otherwise(F.col("unit"))
    return m.select("measurement_id", "variable_code", N.resolve_unit(raw, "variable_code").alias("unit"))


@register("category", sql("""
SELECT v.category, count(*) AS n FROM measurements m JOIN variables v ON m.variable_id = v.variable_id
GROUP BY v.category""", "measurements", "variables"))
def category_counts(spark, d):
    m = B.measurements(spark, d)
    return m.groupBy(N.category("variable_code").alias("category")).agg(F.count("*").alias("n"))


ISO_SQL = ("strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(observed_at) % 1000000 = 0 THEN '' "
           "ELSE '.' || lpad(CAST(epoch_us(observed_at) % 1000000 AS VARCHAR), 6, '0') END")


@register("record_hash", sql(f"""
SELECT measurement_id, sha256(station_code || '|' || variable_code || '|' || {ISO_SQL}) AS record_hash
FROM measurements""", "measurements"))
def record_hash(spark, d):
    m = B.measurements(spark, d)
    return m.select("measurement_id", N.record_hash("station_code", "variable_code", "observed_at").alias("record_hash"))


NUMERIC_SQL_RE = r"^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


@register("numeric_coercion", sql(f"""
SELECT measurement_id, raw,
       CASE WHEN regexp_matches(raw, '{NUMERIC_SQL_RE}') THEN TRY_CAST(trim(raw) AS DOUBLE) END AS value_num
FROM (SELECT measurement_id,
             CASE measurement_id % 10 WHEN 0 THEN concat(CAST(value AS VARCHAR), 'x') WHEN 1 THEN 'NaN'
                                      WHEN 2 THEN '1d' WHEN 3 THEN ' 1,5' ELSE CAST(value AS VARCHAR) END AS raw
      FROM measurements)""", "measurements"))
def numeric_coercion(spark, d):
    m = B.measurements(spark, d)
    k = F.col("measurement_id") % 10
    txt = F.col("value").cast("string")
    raw = (F.when(k == 0, F.concat(txt, F.lit("x"))).when(k == 1, F.lit("NaN")).when(k == 2, F.lit("1d"))
           .when(k == 3, F.lit(" 1,5")).otherwise(txt))
    return m.select("measurement_id", raw.alias("raw")).select("measurement_id", "raw",
                                                               N.to_number("raw").alias("value_num"))


STATIONS_25 = [f"ST{i:02d}" for i in range(25)]


@register("wide_unpivot", sql(f"""
SELECT strftime(observed_at, '%Y-%m-%d %H:00') AS bucket, station_code, {R6('avg(value)')} AS value
FROM measurements GROUP BY 1, 2""", "measurements"))
def wide_unpivot(spark, d):
    """N7 round trip: E pivoted to one column per station (rows = hour), then unpivoted, nulls dropped."""
    from envspark.operators.normalize import unpivot_wide

    m = B.measurements(spark, d)
    wide = A.series_pivot(m, "hour", "station_code", STATIONS_25).drop("overall")
    long = unpivot_wide(wide, ["bucket"], STATIONS_25, "station_code", "value")
    return r6(long, "value")


@register("station_fallback", sql(f"""
SELECT measurement_id,
       CASE WHEN raw IS NULL OR trim(raw, ' \t\n\r\x0b\x0c') = '' OR lower(raw) = 'nan' THEN 'UNKNOWN_STATION'
            ELSE {SQL_CODE('raw')} END AS station_code
FROM (SELECT measurement_id, CASE measurement_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN NULL
                                  WHEN 3 THEN lower(station_code) ELSE concat(' ', station_code, '\t') END AS raw
      FROM measurements)""", "measurements"))
def station_fallback(spark, d):
    m = B.measurements(spark, d)
    k = F.col("measurement_id") % 5
    raw = (F.when(k == 0, F.lit("")).when(k == 1, F.lit("nan")).when(k == 2, F.lit(None).cast("string"))
           .when(k == 3, F.lower("station_code")).otherwise(F.concat(F.lit(" "), F.col("station_code"), F.lit("\t"))))
    return m.select("measurement_id", N.station_code(raw).alias("station_code"))


# ---------------------------------------------------------------------------------------------------------
# L1-L9 keyed load
# ---------------------------------------------------------------------------------------------------------

from envspark.operators import load as L  # noqa: E402

LOAD_CTES = """
dd_t AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_code, variable_code, observed_at
                                                        ORDER BY load_order DESC) AS rn
                        FROM hourly WHERE load_order % 2 = 0) WHERE rn = 1),
dd_b AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_code, variable_code, observed_at
                                                        ORDER BY load_order DESC) AS rn
                        FROM hourly) WHERE rn = 1),
bat AS (SELECT station_code, variable_code, observed_at,
               CASE WHEN load_order % 3 = 0 THEN value + 1 ELSE value END AS value,
               CASE WHEN load_order % 7 = 0 THEN NULL ELSE unit END AS unit, source_file_id, load_order FROM dd_b),
act AS (SELECT coalesce(b.station_code, t.station_code) AS station_code,
               coalesce(b.variable_code, t.variable_code) AS variable_code,
               coalesce(b.observed_at, t.observed_at) AS observed_at,
               t.value AS old_value, t.unit AS old_unit, t.source_file_id AS old_source_file_id,
               b.value, b.unit, b.source_file_id,
               CASE WHEN b.station_code IS NULL THEN 'keep' WHEN t.station_code IS NULL THEN 'insert'
                    WHEN (b.value IS DISTINCT FROM t.value AND NOT isnan(abs(b.value - t.value))
                          AND abs(b.value - t.value) > 1e-9)
                         OR coalesce(b.unit, '') <> coalesce(t.unit, '') THEN 'update'
                    ELSE 'skip' END AS action
        FROM dd_t t FULL OUTER JOIN bat b ON t.station_code = b.station_code AND t.variable_code = b.variable_code
                                         AND t.observed_at = b.observed_at)"""


def _load_sql(body: str) -> str:
    return _sql_with(LOAD_CTES + "\n" + body.strip(), "hourly")


def _target_batch(spark, d):
    h = B.hourly(spark, d)
    target = L.dedup_last_wins(h.where(F.col("load_order") % 2 == 0)).drop("load_order")
    b = L.dedup_last_wins(h)
    k = F.col("load_order")
    batch = (b.withColumn("value", F.when(k % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))
             .withColumn("unit", F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("unit"))))
    return target, batch


@register("dedup_last_wins", _sql_with("""
SELECT station_code, variable_code, observed_at, value, unit, source_file_id, load_order
FROM (SELECT *, row_number() OVER (PARTITION BY station_code, variable_code, observed_at ORDER BY load_order DESC) AS rn
      FROM hourly) WHERE rn = 1""", "hourly"))
def dedup_last_wins(spark, d):
    return L.dedup_last_wins(B.hourly(spark, d))


@register("dedup_skipped", sql("""
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT station_code, variable_code, observed_at FROM hourly))
       AS skipped FROM hourly""", "hourly"))
def dedup_skipped(spark, d):
    return L.dedup_skipped(B.hourly(spark, d))


@register("upsert_actions", _load_sql("SELECT station_code, variable_code, observed_at, action FROM act"))
def upsert_actions(spark, d):
    t, b = _target_batch(spark, d)
    return L.upsert_actions(t, b).select("station_code", "variable_code", "observed_at", "action")


@register("upsert_result", _load_sql(f"""
SELECT station_code, variable_code, observed_at,
       CASE WHEN action IN ('insert', 'update') THEN value ELSE old_value END AS value,
       CASE WHEN action IN ('insert', 'update') THEN unit ELSE old_unit END AS unit,
       CASE WHEN action IN ('insert', 'update') THEN source_file_id ELSE old_source_file_id END AS source_file_id,
       sha256(station_code || '|' || variable_code || '|' || {ISO_SQL}) AS record_hash
FROM act"""))
def upsert_result(spark, d):
    t, b = _target_batch(spark, d)
    return L.upsert_result(L.upsert_actions(t, b))


@register("upsert_counts", _load_sql("SELECT action, count(*) AS n FROM act GROUP BY action"))
def upsert_counts(spark, d):
    t, b = _target_batch(spark, d)
    return L.upsert_counts(L.upsert_actions(t, b))


@register("dim_new_codes", sql("""
SELECT CAST((SELECT max(station_id) FROM stations) + row_number() OVER (ORDER BY code) AS INT) AS station_id,
       code, code AS name
FROM (SELECT DISTINCT concat('ST', lpad(CAST(user_id % 30 AS VARCHAR), 2, '0')) AS code FROM events)
WHERE code NOT IN (SELECT code FROM stations)""", "stations"))
def dim_new_codes(spark, d):
    from envspark.session import read_table

    ev = read_table(spark, d, "events")
    codes = ev.select(B.station_code_of((F.col("user_id") % 30).cast("int")).alias("code"))
    return L.new_dimension_members(codes, B.stations(spark, d))


@register("default_unit_backfill", sql("""
SELECT v.variable_id, v.code, v.display_name, v.category, coalesce(v.default_unit, f.first_unit) AS default_unit
FROM (SELECT variable_id, code, display_name, category,
             CASE WHEN code IN ('O3', 'CO') THEN NULL ELSE default_unit END AS default_unit FROM variables) v
LEFT JOIN (SELECT variable_code AS code, arg_min(trim(unit), measurement_id) AS first_unit
           FROM (SELECT variable_code, measurement_id,
                        CASE WHEN measurement_id % 2 = 0 THEN '' ELSE unit END AS unit FROM measurements)
           WHERE unit IS NOT NULL AND trim(unit) <> '' AND lower(unit) <> 'nan' GROUP BY variable_code) f
ON v.code = f.code""", "variables", "measurements"))
def default_unit_backfill(spark, d):
    v = B.variables(spark, d)
    v = v.withColumn("default_unit", F.when(F.col("code").isin("O3", "CO"), F.lit(None).cast("string"))
                     .otherwise(F.col("default_unit")))
    m = B.measurements(spark, d)
    cu = m.select("variable_code", F.when(F.col("measurement_id") % 2 == 0, F.lit("")).otherwise(F.col("unit"))
                  .alias("unit"), F.col("measurement_id").alias("load_order"))
    return L.backfill_default_unit(v, cu)


@register("delete_by_variable", sql("""
SELECT variable_code, count(*) AS n_deleted FROM measurements WHERE variable_code IN ('NO2', 'CO')
GROUP BY variable_code""", "measurements"))
def delete_by_variable(spark, d):
    _, deleted = L.delete_by_variable(B.measurements(spark, d), ["no2", " co"])
    return deleted


@register("delete_remaining", sql("""
SELECT variable_code, count(*) AS n FROM measurements WHERE variable_code NOT IN ('NO2', 'CO')
GROUP BY variable_code""", "measurements"))
def delete_remaining(spark, d):
    remaining, _ = L.delete_by_variable(B.measurements(spark, d), ["no2", " co"])
    return remaining.groupBy("variable_code").agg(F.count("*").alias("n"))


@register("replace_by_variable", _load_sql("""
SELECT station_code, variable_code, observed_at, value, unit, source_file_id FROM dd_t
WHERE variable_code NOT IN ('PM25', 'O3')
UNION ALL
SELECT station_code, variable_code, observed_at, value, unit, source_file_id FROM bat
WHERE variable_code IN ('PM25', 'O3')"""))
def replace_by_variable(spark, d):
    t, b = _target_batch(spark, d)
    return L.replace_by_variable(t, b.drop("load_order"), ["pm2.5", "o3"])


# S11 + L6: facts of E, hourly, in a versioned sink; two variables are replaced by the batch and one of them, without fresh
# rows, disappears; a writer that fails before its manifest changes nothing.
@register("replace_sink", _load_sql("""
SELECT station_code, variable_code, observed_at, value, unit, source_file_id FROM dd_t WHERE variable_code NOT IN ('PM25', 'O3')
UNION ALL
SELECT station_code, variable_code, observed_at, value, unit, source_file_id FROM bat WHERE variable_code = 'PM25'"""))
def replace_sink(spark, d):
    from envspark.sources import files as S
    from envspark.sources import versions as V

    target, batch = _target_batch(spark, d)
    table = os.path.join(STR._work_dir(spark, "sink"), "facts")
    S.write_measurements(target, table)
    S.write_measurements(batch.drop("load_order").where("variable_code <> 'O3'"), table, ["PM25", "O3"])
    V.write_data(batch.drop("load_order"), table, ["variable_code"])  # written, never published
    return V.read(spark, table)


@register("station_enrichment", sql("""
SELECT s.station_id, s.code,
       CASE WHEN x.ref_order IS NOT NULL AND (trim(coalesce(s.name, '')) = ''
                 OR replace(regexp_replace(lower(trim(coalesce(s.name, ''))), '[^a-z0-9_]+', '', 'g'), '_', '')
                    IN ('unknownstation', replace(regexp_replace(lower(s.code), '[^a-z0-9_]+', '', 'g'), '_', '')))
            THEN r.ref_name ELSE s.name END AS name,
       CASE WHEN x.ref_order IS NOT NULL AND (s.latitude IS NULL OR abs(s.latitude - r.ref_latitude) > 1e-9)
            THEN r.ref_latitude ELSE s.latitude END AS latitude,
       CASE WHEN x.ref_order IS NOT NULL AND (s.longitude IS NULL OR abs(s.longitude - r.ref_longitude) > 1e-9)
            THEN r.ref_longitude ELSE s.longitude END AS longitude,
       r.ref_region AS region,
       coalesce(x.ref_order IS NOT NULL AND (s.latitude IS NULL OR abs(s.latitude - r.ref_latitude) > 1e-9
                OR s.longitude IS NULL OR abs(s.longitude - r.ref_longitude) > 1e-9 OR trim(coalesce(s.name, '')) = ''
                OR replace(regexp_replace(lower(trim(coalesce(s.name, ''))), '[^a-z0-9_]+', '', 'g'), '_', '')
                   IN ('unknownstation', replace(regexp_replace(lower(s.code), '[^a-z0-9_]+', '', 'g'), '_', ''))),
                false) AS changed
FROM stations_ref s LEFT JOIN resolved_ref x ON s.station_id = x.station_id
LEFT JOIN ref_stations r ON x.ref_order = r.ref_order""", "stations_ref", "resolved_ref", "ref_stations"))
def station_enrichment(spark, d):
    return L.enrich_stations(B.stations_ref(spark, d))


@register("run_state", sql("""
SELECT etl_run_id AS run_id, arg_max(status, (downloaded_at, status)) AS status, max(downloaded_at) AS updated_at,
       min(downloaded_at) AS started_at, count(*) AS n_events, CAST(sum(row_count) AS BIGINT) AS records
FROM source_files GROUP BY etl_run_id""", "source_files"))
def run_state(spark, d):
    f = B.source_files(spark, d)
    events = f.select(F.col("etl_run_id").alias("run_id"), F.col("downloaded_at").alias("ts"), "status",
                      F.col("row_count").alias("records"))
    return L.run_state(events)


# ---------------------------------------------------------------------------------------------------------
# S6-S9, O1 over documents and pages
# ---------------------------------------------------------------------------------------------------------

from envspark.sources import ledger as LG  # noqa: E402
from envspark.sources import links as LK  # noqa: E402


@register("checksum_skip", sql("""
SELECT d.doc_id, d.checksum_sha256, CASE WHEN l.m IS NOT NULL THEN 'skip' ELSE 'process' END AS action,
       CAST(coalesce(l.m, 0) AS BIGINT) AS skipped_rows
FROM (SELECT doc_id, sha256(text) AS checksum_sha256 FROM documents) d
LEFT JOIN (SELECT sha256(text) AS checksum_sha256, max(doc_id % 2) AS m FROM documents
           WHERE doc_id % 3 = 0 AND doc_id % 2 > 0 GROUP BY 1) l ON d.checksum_sha256 = l.checksum_sha256"""))
def checksum_skip(spark, d):
    from envspark.session import read_table

    docs = read_table(spark, d, "documents")
    files = docs.select("doc_id", LG.fingerprint(F.col("text")).alias("checksum_sha256"))
    ledger = docs.where(F.col("doc_id") % 3 == 0).select(
        LG.fingerprint(F.col("text")).alias("checksum_sha256"), F.lit("completed").alias("status"),
        (F.col("doc_id") % 2).alias("row_count"))
    return LG.skip_loaded(files, ledger)


EXTRA_HINTS = {"PM25": ("the",), "NO2": ("der",), "O3": ("los",), "CO": ("was",)}
LINK_VARIABLES = ["pm2.5", "NO2", "o3", "CO"]


def _anchors_sql() -> str:
    # an opening tag may hold quoted attributes of both kinds; an href is double-quoted, single-quoted or bare
    tag = """<a\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
    href = """(?is)^<a(?:[^>"'']|"[^"]*"|''[^'']*'')*?\\shref\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)"""

    def decoded(x: str) -> str:
        for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
            x = f"replace({x}, '{ent}', '{ch}')"
        return x

    text = decoded(f"regexp_replace(regexp_extract(a, '(?is)^{tag}(.*)</a>$', 1), '<[^>]*>', ' ', 'g')")
    url = decoded(f"""regexp_replace(regexp_extract(a, '{href}', 1), '^["'']|["'']$', '', 'g')""")
    return f"""
anc AS (SELECT page_id, page_url, CAST(pos - 1 AS INT) AS pos, trim({url}) AS href,
               trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS text
        FROM (SELECT page_id, page_url, unnest(links) AS a, unnest(range(1, len(links) + 1)) AS pos
              FROM (SELECT page_id, url AS page_url,
                           list_filter(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|$)', '', 'g'), '(?is){tag}.*?</a>'),
                                       lambda x: regexp_matches(x, '{href}')) AS links FROM pages))),
res AS (SELECT *, regexp_replace(CASE
          WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href
          WHEN starts_with(href, '//') THEN regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) || ':' || href
          WHEN starts_with(href, '/') THEN regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || href
          WHEN starts_with(href, '?') THEN regexp_replace(page_url, '[?#].*$', '') || href
          WHEN starts_with(href, '#') OR href = '' THEN page_url
          WHEN regexp_replace(page_url, '[?#].*$', '') = regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)
            THEN regexp_replace(page_url, '[?#].*$', '') || '/' || href
          ELSE regexp_replace(regexp_replace(page_url, '[?#].*$', ''), '/[^/]*$', '/') || href END, '#.*$', '') AS url
        FROM anc),
cls AS (SELECT *, coalesce(
          list_filter(list_transform(regexp_extract_all(lower(text), '\\(([a-z0-9\\.\\-]+)\\)', 1),
                      lambda c: map_extract_value(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in __import__('envspark.vocab', fromlist=['x']).VARIABLE_ALIASES.items())}}},
                                        replace(trim(c), '-', ''))), lambda c: c IS NOT NULL)[1],
          {_hint_case_sql()}) AS variable_code
        FROM (SELECT *, concat_ws(' ', {NORM('text')}, {NORM('href')}, {NORM('url')}) AS hay FROM res))"""


def _hint_case_sql() -> str:
    from envspark import vocab as V

    hints = {c: tuple(h) for c, h in V.VARIABLE_HINTS.items()}
    for c, more in EXTRA_HINTS.items():
        hints[c] = hints[c] + more
    parts = []
    for code in V.VARIABLE_CODES:
        cond = " OR ".join(f"contains(hay, '{h}')" for h in hints[code])
        parts.append(f"WHEN {cond} THEN '{code}'")
    return "CASE " + " ".join(parts) + " END"


@register("variable_classifier", _sql_with(_anchors_sql() + "\nSELECT page_id, pos, href, url, variable_code FROM cls"))
def variable_classifier(spark, d):
    from envspark.session import read_table

    c = LK.classified_anchors(read_table(spark, d, "pages"), EXTRA_HINTS)
    return c.select("page_id", "pos", "href", "url", "variable_code")


def _link_catalogue_sql() -> str:
    body = _sql_with(_anchors_sql() + """,
ok AS (SELECT * FROM cls WHERE NOT starts_with(href, 'javascript:') AND NOT starts_with(href, 'mailto:')
         AND regexp_matches(lower(url), '^https?://') AND starts_with(lower(url), 'http')
         AND variable_code IN ('PM25', 'NO2', 'O3', 'CO')),
c AS (SELECT page_id, pos, url, text AS label, variable_code,
             row_number() OVER (PARTITION BY page_id ORDER BY pos) AS idx FROM ok),
walk AS (SELECT page_id, CAST(0 AS BIGINT) AS idx, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS vars,
                CAST([] AS INTEGER[]) AS taken
         FROM (SELECT DISTINCT page_id FROM c)
         UNION ALL
         SELECT w.page_id, w.idx + 1,
                CASE WHEN a THEN list_append(w.urls, c.url) ELSE w.urls END,
                CASE WHEN a THEN list_append(w.vars, c.variable_code) ELSE w.vars END,
                CASE WHEN a THEN list_append(w.taken, c.pos) ELSE w.taken END
         FROM walk w JOIN (SELECT * FROM c) c ON c.page_id = w.page_id AND c.idx = w.idx + 1,
              LATERAL (SELECT NOT list_contains(w.urls, c.url) AND NOT list_contains(w.vars, c.variable_code)
                              AND len(w.taken) < 4 AS a)),
fin AS (SELECT page_id, arg_max(taken, idx) AS taken FROM walk GROUP BY page_id)
SELECT c.page_id, CAST(c.pos AS INT) AS pos, c.url, c.label, c.variable_code
FROM fin, unnest(fin.taken) AS t(p) JOIN c ON c.page_id = fin.page_id AND c.pos = t.p""")
    return "WITH RECURSIVE " + body[len("WITH "):]


@register("link_catalogue", _link_catalogue_sql())
def link_catalogue(spark, d):
    from envspark.session import read_table

    return LK.link_catalogue(read_table(spark, d, "pages"), "http", LINK_VARIABLES, None, EXTRA_HINTS)


# ---------------------------------------------------------------------------------------------------------
# M1-M7 model features and evaluation (E at hourly station grain; target PM25)
# ---------------------------------------------------------------------------------------------------------

from envspark.operators import features as M  # noqa: E402

FEATURES_SQL = f"""
feat AS (SELECT station_id, CAST(date_trunc('hour', observed_at) AS TIMESTAMP) AS bucket,
                {', '.join(f"avg(CASE WHEN variable_code = '{v}' THEN value END) AS {v.lower()}" for v in E_VARS)}
         FROM measurements GROUP BY 1, 2),
ser AS (SELECT station_id, bucket, pm25 AS actual,
               lag(pm25, 1) OVER (PARTITION BY station_id ORDER BY bucket) AS predicted,
               row_number() OVER (PARTITION BY station_id ORDER BY bucket) AS rn,
               count(*) OVER (PARTITION BY station_id) AS n
        FROM feat WHERE pm25 IS NOT NULL),
pred AS (SELECT station_id, bucket, actual, predicted FROM ser WHERE rn > floor(n * 0.8) AND predicted IS NOT NULL)"""


def _features(spark, d):
    return M.feature_table(B.measurements(spark, d), E_VARS)


@register("lag_features", _sql_with(FEATURES_SQL + f"""
SELECT station_id, bucket, {R6('pm25')} AS pm25,
       {', '.join(R6(f'lag(pm25, {k}) OVER (PARTITION BY station_id ORDER BY bucket)') + f' AS lag_{k}' for k in range(1, 25))}
FROM feat""", "measurements"))
def lag_features(spark, d):
    lf = M.lag_features(_features(spark, d), "pm25", 24)
    return r6(lf, "pm25", *[f"lag_{k}" for k in range(1, 25)])


@register("feature_table", _sql_with(FEATURES_SQL + f"""
SELECT station_id, bucket, {', '.join(R6(v.lower()) + ' AS ' + v.lower() for v in E_VARS)},
       CAST(hour(bucket) AS INT) AS hour, CAST(isodow(bucket) - 1 AS INT) AS dow FROM feat""", "measurements"))
def feature_table(spark, d):
    return r6(_features(spark, d), *[v.lower() for v in E_VARS])


@register("minmax_scaled", _sql_with(FEATURES_SQL + f""",
fit AS (SELECT min(pm25) AS a, max(pm25) AS b, min(pm10) AS c, max(pm10) AS e FROM feat)
SELECT station_id, bucket,
       {R6('CASE WHEN b > a THEN (pm25 - a) / (b - a) ELSE 0.0 END')} AS pm25_scaled,
       {R6('CASE WHEN e > c THEN (pm10 - c) / (e - c) ELSE 0.0 END')} AS pm10_scaled
FROM feat, fit""", "measurements"))
def minmax_scaled(spark, d):
    f = _features(spark, d)
    fit = M.minmax_fit(f, ["pm25", "pm10"])
    return r6(M.minmax_transform(f, fit, ["pm25", "pm10"], ["station_id", "bucket"]), "pm25_scaled", "pm10_scaled")


@register("chrono_split", _sql_with(FEATURES_SQL + """
SELECT station_id, bucket, CASE WHEN row_number() OVER (PARTITION BY station_id ORDER BY bucket)
                                     <= floor(count(*) OVER (PARTITION BY station_id) * 0.8)
                                THEN 'train' ELSE 'test' END AS split FROM feat""", "measurements"))
def chrono_split(spark, d):
    return M.chrono_split(_features(spark, d).select("station_id", "bucket"), 0.8)


@register("regression_metrics", _sql_with(FEATURES_SQL + f"""
SELECT count(*) AS n, {R6('avg(abs(actual - predicted))')} AS mae, {R6('sqrt(avg((actual - predicted) ^ 2))')} AS rmse,
       {R6('avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) END) * 100')} AS mape,
       {R6('1.0 - sum((actual - predicted) ^ 2) / sum((actual - (SELECT avg(actual) FROM pred)) ^ 2)')} AS r2
FROM pred""", "measurements"))
def regression_metrics(spark, d):
    pred = M.persistence_predictions(_features(spark, d), "pm25", 0.8)
    return r6(M.regression_metrics(pred), "mae", "rmse", "mape", "r2")


@register("prediction_errors", _sql_with(FEATURES_SQL + f"""
SELECT station_id, bucket, {R6('actual')} AS actual, {R6('predicted')} AS predicted,
       {R6('actual - predicted')} AS error,
       {R6('CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) * 100 END')} AS error_pct
FROM pred""", "measurements"))
def prediction_errors(spark, d):
    pred = M.persistence_predictions(_features(spark, d), "pm25", 0.8)
    return r6(M.prediction_errors(pred).drop("split"), "actual", "predicted", "error", "error_pct")


@register("forest_importance")
def forest_importance(spark, d):
    return M.forest_importance(_features(spark, d), "pm25", ["pm10", "no2", "o3", "co", "hour", "dow"])


# ---------------------------------------------------------------------------------------------------------
# T-S1..T-S4 streaming (availableNow over the events file; outputs in the shared checkpoint folder)
# ---------------------------------------------------------------------------------------------------------

from envspark.streaming import ingest as STR  # noqa: E402


def _event_measurements(stream: DataFrame) -> DataFrame:
    """The E binding applied to a stream of ``events`` rows."""
    st = (F.col("user_id") % B.N_STATIONS).cast("int")
    et = F.col("event_type")
    return stream.select(
        F.col("event_id").alias("measurement_id"), st.alias("station_id"),
        B.station_code_of(st).alias("station_code"),
        B._case(et, [(e, i) for e, i, _ in B.EVENT_VARIABLES], B.OTHER_VARIABLE[0]).alias("variable_id"),
        B._case(et, [(e, c) for e, _, c in B.EVENT_VARIABLES], B.OTHER_VARIABLE[1]).alias("variable_code"),
        F.col("ts").alias("observed_at"), "value",
        F.when(et == "error", F.lit("mg/m3")).otherwise(F.lit("ug/m3")).alias("unit"),
        (F.floor(F.col("event_id") / B.EVENTS_PER_FILE).cast("int") + 1).alias("source_file_id"))


@register("stream_ingest", _sql_with("""
SELECT station_code, variable_code, observed_at, value, unit, source_file_id
FROM (SELECT *, row_number() OVER (PARTITION BY station_code, variable_code, observed_at ORDER BY load_order DESC) AS rn
      FROM hourly) WHERE rn = 1""", "hourly"))
def stream_ingest(spark, d):
    from envspark.functions.timefmt import truncate_hour

    work = STR._work_dir(spark, "stream-ingest")
    m = _event_measurements(STR.file_stream(spark, d, "events"))
    hourly = m.select("station_code", "variable_code", truncate_hour("observed_at").alias("observed_at"), "value",
                      "unit", "source_file_id", F.col("measurement_id").alias("load_order"))
    target = STR.stream_upsert(hourly, os.path.join(work, "table"), work)
    return STR.read_table_dir(spark, target)


@register("stream_window", sql(f"""
SELECT time_bucket(INTERVAL 1 HOUR, observed_at) AS window_start,
       time_bucket(INTERVAL 1 HOUR, observed_at) + INTERVAL 1 HOUR AS window_end, variable_code,
       count(*) AS n, {R6('avg(value)')} AS mean_value
FROM measurements GROUP BY 1, 2, 3""", "measurements"))
def stream_window(spark, d):
    work = STR._work_dir(spark, "stream-window")
    m = _event_measurements(STR.file_stream(spark, d, "events"))
    out = STR.stream_window(m, "1 hour", None, ["variable_code"], "2 hours", work)
    return r6(spark.read.parquet(out), "mean_value")


STREAM_BATCHES, STREAM_DELAY = 4, "3 days"


def _arrivals(spark, d, work, again: int | None = None):
    """The events in STREAM_BATCHES arrivals by event id, every tenth one an arrival later than its neighbours and the one
    after it two later; one streaming run after each. Every ``again``-th event of an arrival is sent once more with the
    next one. Yields the stream to run."""
    events = spark.read.parquet(f"{d.rstrip('/')}/events.parquet")
    total = events.agg(F.max("event_id")).first()[0] + 1
    behind = F.when(F.col("event_id") % 10 < 2, F.col("event_id") % 10 + 1).otherwise(0)
    part = F.least(F.floor(F.col("event_id") * STREAM_BATCHES / total) + behind, F.lit(STREAM_BATCHES - 1))
    folder = os.path.join(work, "in")
    for k in range(STREAM_BATCHES):
        rows = events.where(part == k)
        if again and k:
            rows = rows.unionByName(events.where((part == k - 1) & (F.col("event_id") % again == 0)))
        rows.write.parquet(os.path.join(folder, f"arrival-{k}"))
        yield _event_measurements(spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(folder))


_ARRIVALS_SQL = f"""
arrived AS (SELECT *, least({STREAM_BATCHES - 1}, CAST(floor(measurement_id * {STREAM_BATCHES} / (SELECT max(measurement_id) + 1 FROM measurements)) AS INT)
                     + CASE WHEN measurement_id % 10 < 2 THEN measurement_id % 10 + 1 ELSE 0 END) AS part,
                   time_bucket(INTERVAL 1 DAY, observed_at) AS window_start, time_bucket(INTERVAL 1 DAY, observed_at) + INTERVAL 1 DAY AS window_end
            FROM measurements),
newest AS (SELECT part, max(observed_at) AS t FROM arrived GROUP BY part),
mark AS (SELECT p.part, max(q.t) - INTERVAL {STREAM_DELAY} AS w FROM newest p LEFT JOIN newest q ON q.part < p.part GROUP BY p.part),
judged AS (SELECT a.*, coalesce(a.window_end <= m.w, false) AS too_late FROM arrived a JOIN mark m USING (part))"""


@register("stream_window_append", _sql_with(_ARRIVALS_SQL + f"""
SELECT window_start, window_end, variable_code, count(*) AS n, {R6('avg(value)')} AS mean_value,
       window_end <= (SELECT max(t) - INTERVAL {STREAM_DELAY} FROM newest) AS closed
FROM judged WHERE NOT too_late GROUP BY 1, 2, 3""", "measurements"))
def stream_window_append(spark, d):
    work = STR._work_dir(spark, "stream-append")
    for stream in _arrivals(spark, d, work):
        STR.stream_window_append(stream, "1 day", None, ["variable_code"], STREAM_DELAY, work)
    return r6(STR.read_windows(spark, work), "mean_value")


@register("stream_late_rows", _sql_with(_ARRIVALS_SQL + """
SELECT variable_code, count(*) AS n_late, min(observed_at) AS oldest, sum(measurement_id)::BIGINT AS id_sum FROM judged WHERE too_late GROUP BY 1""", "measurements"))
def stream_late_rows(spark, d):
    work = STR._work_dir(spark, "stream-late")
    for stream in _arrivals(spark, d, work):
        STR.stream_window_append(stream, "1 day", None, ["variable_code"], STREAM_DELAY, work)
    return STR.read_late(spark, work).groupBy("variable_code").agg(
        F.count("*").alias("n_late"), F.min("observed_at").alias("oldest"), F.sum("measurement_id").alias("id_sum"))


# T-S3 over several arrivals in which every seventh event comes twice
@register("stream_dedup_resent", sql("""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY measurement_id ORDER BY observed_at) AS rn FROM measurements)
WHERE rn = 1""", "measurements"))
def stream_dedup_resent(spark, d):
    work = STR._work_dir(spark, "stream-resent")
    for stream in _arrivals(spark, d, work, again=7):
        STR.stream_dedup(stream, ["measurement_id"], "400 days", work)
    return spark.read.parquet(os.path.join(work, "out"))


@register("stream_latest", _with_latest("""
SELECT s.station_id, v.variable_id, l.observed_at, l.value, l.unit
FROM latest l JOIN stations s ON l.station_code = s.code JOIN variables v ON l.variable_code = v.code""",
                                        "stations"))
def stream_latest(spark, d):
    work = STR._work_dir(spark, "stream-latest")
    m = _event_measurements(STR.file_stream(spark, d, "events"))
    target = STR.stream_latest(m, os.path.join(work, "table"), work)
    return STR.read_latest_state(spark, target).select("station_id", "variable_id", "observed_at", "value", "unit")


@register("stream_dedup", sql("""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_id, variable_id, observed_at
                                                       ORDER BY measurement_id) AS rn FROM measurements)
WHERE rn = 1""", "measurements"))
def stream_dedup(spark, d):
    work = STR._work_dir(spark, "stream-dedup")
    m = _event_measurements(STR.file_stream(spark, d, "events"))
    out = STR.stream_dedup(m, ["station_id", "variable_id", "observed_at"], "2 hours", work)
    return spark.read.parquet(out)


# ---------------------------------------------------------------------------------------------------------
# S1/S2 end to end: E written as long-format delimited files by Spark, then ingested by the file pipeline
# ---------------------------------------------------------------------------------------------------------

@register("delimited_ingest", sql("""
SELECT station_code, observed_at, variable_code, value, unit, 'data' AS source_sheet FROM measurements""",
                                  "measurements"))
def delimited_ingest(spark, d):
    from envspark.functions.timefmt import iso_datetime
    from envspark.sources import files as S

    work = STR._work_dir(spark, "delimited")
    m = B.measurements(spark, d)
    (m.select(F.col("station_code").alias("estacion"),
              F.replace(iso_datetime("observed_at", True), F.lit("T"), F.lit(" ")).alias("fecha_hora"),
              F.col("variable_code").alias("contaminante"), F.col("value").cast("string").alias("valor"),
              F.col("unit").alias("unidad"))
     .write.option("header", "true").option("sep", ";").csv(os.path.join(work, "csv")))
    listed = S.list_files(spark, os.path.join(work, "csv"))
    paths = [r["path"] for r in S.format_gate(listed.withColumn("suffix", F.lit(".csv")))
             .where("accepted AND length > 0").select("path").collect()]
    staged = S.read_delimited(spark, paths)
    return staged.select("station_code", "observed_at", "variable_code", "value", "unit", "source_sheet")


# E2 end to end: the same files through the ingest job, twice; the second run finds every file loaded.
@register("ingest_job", sql("""
SELECT r.run, 'completed' AS status, CASE r.run WHEN 1 THEN n_keys ELSE 0 END AS inserted, 0::BIGINT AS updated,
       CASE r.run WHEN 1 THEN n_rows - n_keys ELSE n_rows END AS skipped, n_keys AS table_rows, n_stations, n_variables
FROM (VALUES (1), (2)) r(run), (
  SELECT count(*) AS n_rows, count(DISTINCT (station_code, variable_code, observed_at)) AS n_keys,
         count(DISTINCT station_code) AS n_stations, count(DISTINCT variable_code) AS n_variables FROM measurements)""",
                            "measurements"))
def ingest_job(spark, d):
    from envspark.functions.timefmt import iso_datetime
    from envspark.plans import ingest_job as J

    work = STR._work_dir(spark, "ingest")
    files, store = os.path.join(work, "csv"), os.path.join(work, "store")
    (B.measurements(spark, d)
     .select(F.col("station_code").alias("estacion"),
             F.replace(iso_datetime("observed_at", True), F.lit("T"), F.lit(" ")).alias("fecha_hora"),
             F.col("variable_code").alias("contaminante"), F.col("value").cast("string").alias("valor"),
             F.col("unit").alias("unidad"))
     .write.option("header", "true").option("sep", ";").csv(files))
    runs = [J.ingest(spark, files, store) for _ in range(2)]
    table = J.measurements(spark, store)
    size = table.agg(F.count("*").alias("table_rows"))
    stations = J.store_table(spark, store, "stations", J.STATIONS)
    variables = J.store_table(spark, store, "variables", J.VARIABLES)
    rows = spark.createDataFrame([(k, r["status"], r["inserted"], r["updated"], r["skipped"]) for k, r in enumerate(runs, 1)],
                                 "run int, status string, inserted bigint, updated bigint, skipped bigint")
    return rows.select("*", F.lit(size.first()[0]).cast("bigint").alias("table_rows"),
                       F.lit(stations.count()).cast("bigint").alias("n_stations"),
                       F.lit(variables.count()).cast("bigint").alias("n_variables"))


# ---------------------------------------------------------------------------------------------------------
# Q13 run by id, S8 landing names, N9 variable from sheet / workbook names
# ---------------------------------------------------------------------------------------------------------

@register("run_by_id", sql("SELECT * FROM etl_runs WHERE id = 'run-002'", "etl_runs"))
def run_by_id(spark, d):
    return Q.run_by_id(B.etl_runs(spark, d), "run-002")


@register("landing_names", sql("""
SELECT doc_id, substr(sha256(text), 1, 12) || '-' || regexp_replace(source || '/' || lang || '/doc.txt', '[/\\\\]', '_', 'g')
       AS landing_name FROM documents"""))
def landing_names(spark, d):
    from envspark.session import read_table

    docs = read_table(spark, d, "documents")
    name = F.concat_ws("/", "source", "lang", F.lit("doc.txt"))
    return docs.select("doc_id", LG.landing_name(LG.fingerprint(F.col("text")), name).alias("landing_name"))


def _names_sql_code(x: str) -> str:
    c = f"replace({SQL_CODE(x)}, '_', '')"
    return f"CASE WHEN {c} <> '' AND {c} NOT IN ('HOJA1', 'SHEET1', 'DATA', 'DATOS') THEN {c} END"


@register("variable_from_names", sql(f"""
SELECT source_file_id, sheet, original_name,
       coalesce({_names_sql_code('sheet')}, {_names_sql_code("regexp_replace(original_name, '\\.[^./]*$', '')")},
                'UNKNOWN_VARIABLE') AS variable_code
FROM (SELECT source_file_id, original_name,
             CASE source_file_id % 3 WHEN 0 THEN 'Hoja1' WHEN 1 THEN 'pm 2.5' ELSE ' datos ' END AS sheet
      FROM source_files)""", "source_files"))
def variable_from_names(spark, d):
    f = B.source_files(spark, d)
    k = F.col("source_file_id") % 3
    sheet = F.when(k == 0, F.lit("Hoja1")).when(k == 1, F.lit("pm 2.5")).otherwise(F.lit(" datos "))
    f = f.select("source_file_id", sheet.alias("sheet"), "original_name")
    return f.withColumn("variable_code", N.variable_from_names("sheet", "original_name"))


# ---------------------------------------------------------------------------------------------------------
# A17 contract jobs and the E1 analysis request
# ---------------------------------------------------------------------------------------------------------

from datetime import datetime  # noqa: E402

from envspark.plans import contract as C  # noqa: E402
from envspark.plans import request as RQ  # noqa: E402

CONTRACT = dict(metric="pm25", station_codes=["ST01", "ST02", "ST03", "ST04"], date_from=datetime(2024, 1, 3),
                date_to=datetime(2024, 1, 20, 12))
CONTRACT_WHERE = ("variable_code = 'PM25' AND station_code IN ('ST01', 'ST02', 'ST03', 'ST04') "
                  "AND observed_at >= TIMESTAMP '2024-01-03 00:00:00' AND observed_at <= TIMESTAMP '2024-01-20 12:00:00'")


@register("contract_weekly", sql(f"""
SELECT CAST(date_trunc('week', observed_at) AS TIMESTAMP) AS timestamp, {R6('avg(value)')} AS value, count(*) AS n
FROM measurements WHERE {CONTRACT_WHERE} GROUP BY 1""", "measurements"))
def contract_weekly(spark, d):
    return r6(C.run_contract(B.measurements(spark, d), aggregation="weekly", **CONTRACT), "value")


@register("contract_monthly_li", sql(f"""
SELECT CAST(date_trunc('month', observed_at) AS TIMESTAMP) AS timestamp, {R6('avg(value)')} AS value, count(*) AS n
FROM measurements_li WHERE variable_code = 'PM10' GROUP BY 1""", "measurements_li"))
def contract_monthly_li(spark, d):
    return r6(C.run_contract(B.measurements_li(spark, d), "pm10", None, datetime(1900, 1, 1), datetime(2100, 1, 1),
                             "monthly"), "value")


@register("contract_trend", _sql_with(f"""
r AS (SELECT * FROM measurements WHERE {CONTRACT_WHERE}),
p AS (SELECT strftime(observed_at, '%Y-%m-%d') AS bucket, avg(value) AS value FROM r GROUP BY 1),
e AS (SELECT count(*) AS n_points, arg_max(value, bucket) - arg_min(value, bucket) AS delta,
             regr_slope(value, CAST(CAST(bucket AS DATE) - DATE '1970-01-01' AS DOUBLE)) AS slope FROM p)
SELECT count(value) AS samples, {R6('coalesce(avg(value), 0.0)')} AS mean,
       CASE WHEN count(value) = 0 OR max(n_points) < 2 THEN 'Stable'
            WHEN max(delta) > greatest(0.05, abs(avg(value)) * 0.02) THEN 'Rising'
            WHEN max(delta) < -greatest(0.05, abs(avg(value)) * 0.02) THEN 'Falling' ELSE 'Stable' END AS trend,
       {R6('max(slope)')} AS slope, max(n_points) AS n_days
FROM r, e""", "measurements"))
def contract_trend(spark, d):
    return r6(C.run_contract(B.measurements(spark, d), aggregation="daily", result_type="trend", **CONTRACT),
              "mean", "slope")


@register("analysis_request_rolling", _sql_with(f"""
rows AS (SELECT * FROM star WHERE station_code IN ('ST01', 'ST02') AND variable_code IN ('PM25', 'PM10')
         AND observed_at >= TIMESTAMP '2024-01-02 00:00:00' AND observed_at < TIMESTAMP '2024-01-26 00:00:00'),
p AS (SELECT strftime(observed_at, '%Y-%m-%d %H:00') AS bucket, 'overall' AS series, avg(value) AS value
      FROM rows GROUP BY 1)
SELECT bucket, series, {R6('value')} AS value, {R6('m')} AS mean, {R6('m + sd')} AS upper, {R6('m - sd')} AS lower
FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM p
      WINDOW w AS (ORDER BY bucket ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""", "star"))
def analysis_request_rolling(spark, d):
    req = RQ.AnalysisRequest(filters=Q.Filters(station_codes=["ST01", "ST02"], variable_codes=["PM25", "PM10"],
                                               date_from=date(2024, 1, 2), date_to=date(2024, 1, 25)),
                             granularity="hour", rolling_window=24)
    out = RQ.run_analysis(*_dims(spark, d), req)
    return r6(out["rolling"], "value", "mean", "upper", "lower")


@register("stream_window_sliding", sql(f"""
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, variable_code, count(*) AS n,
       {R6('avg(value)')} AS mean_value
FROM (SELECT time_bucket(INTERVAL 30 MINUTE, observed_at) AS window_start, variable_code, value FROM measurements
      UNION ALL
      SELECT time_bucket(INTERVAL 30 MINUTE, observed_at) - INTERVAL 30 MINUTE, variable_code, value FROM measurements)
GROUP BY 1, 2, 3""", "measurements"))
def stream_window_sliding(spark, d):
    work = STR._work_dir(spark, "stream-window-sliding")
    m = _event_measurements(STR.file_stream(spark, d, "events"))
    out = STR.stream_window(m, "1 hour", "30 minutes", ["variable_code"], "2 hours", work)
    return r6(spark.read.parquet(out), "mean_value")


@register("file_state", sql("""
SELECT source_file_id, status, downloaded_at + INTERVAL 2 MINUTE AS updated_at, CAST(3 AS BIGINT) AS n_events
FROM source_files""", "source_files"))
def file_state(spark, d):
    return LG.file_state(LG.file_events(B.source_files(spark, d)))


# The other canned samples of the stored tables
@register("table_sample_stations", sql("SELECT * FROM stations ORDER BY code LIMIT 120", "stations"))
def table_sample_stations(spark, d):
    return Q.table_sample(B.stations(spark, d), "stations")


@register("table_sample_variables", sql("SELECT * FROM variables ORDER BY code LIMIT 120", "variables"))
def table_sample_variables(spark, d):
    return Q.table_sample(B.variables(spark, d), "variables")


@register("table_sample_source_files", sql(
    "SELECT * FROM source_files ORDER BY downloaded_at DESC, source_file_id DESC LIMIT 120", "source_files"))
def table_sample_source_files(spark, d):
    return Q.table_sample(B.source_files(spark, d), "source_files")


@register("table_sample_etl_runs", sql("SELECT * FROM etl_runs ORDER BY started_at DESC, id DESC LIMIT 120",
                                       "etl_runs"))
def table_sample_etl_runs(spark, d):
    return Q.table_sample(B.etl_runs(spark, d), "etl_runs")


# S5 end to end: Spark packs each partition of E (as long-format CSV text) into zip archives in memory,
# then the archive rows are dealt out, expanded and their members parsed — no file is written.

ARCHIVE_LINES = 20_000


def _zip_partition(batches):
    """An archive of one member for every ARCHIVE_LINES lines at most, so neither grows with the partition."""
    import pandas as _pd

    lines = []
    for pdf in batches:
        lines.extend(pdf["line"].tolist())
        while len(lines) >= ARCHIVE_LINES:
            yield _pd.DataFrame([_zip_archive(lines[:ARCHIVE_LINES])])
            lines = lines[ARCHIVE_LINES:]
    if lines:
        yield _pd.DataFrame([_zip_archive(lines)])


def _zip_archive(lines):
    import hashlib as _hl
    import io as _io
    import zipfile as _zip

    buf = _io.BytesIO()
    with _zip.ZipFile(buf, "w", _zip.ZIP_DEFLATED) as zf:
        info = _zip.ZipInfo("data/part.csv", date_time=(2024, 1, 1, 0, 0, 0))  # fixed: reproducible bytes
        zf.writestr(info, "\n".join(["estacion;fecha_hora;contaminante;valor;unidad", *lines]) + "\n",
                    compress_type=_zip.ZIP_DEFLATED)
    data = buf.getvalue()  # the name is derived from the content, so a recomputed partition gets the same one
    return {"path": f"archive-{_hl.sha1(data).hexdigest()[:16]}.zip", "content": data}


@register("zip_members", sql("""
SELECT station_code, observed_at, variable_code, value, unit, 'data' AS source_sheet FROM measurements""",
                             "measurements"))
def zip_members(spark, d):
    from envspark.functions.timefmt import iso_datetime
    from envspark.sources import files as S

    m = B.measurements(spark, d)
    line = F.concat_ws(";", "station_code", F.replace(iso_datetime("observed_at", True), F.lit("T"), F.lit(" ")),
                       "variable_code", F.col("value").cast("string"), "unit")
    archives = m.select(line.alias("line")).mapInPandas(_zip_partition, "path string, content binary")
    archives = archives.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # expanded and parsed in parallel
    staged = S.parse_members(spark, S.expand_archives(archives))
    return staged.select("station_code", "observed_at", "variable_code", "value", "unit", "source_sheet")


# A19 other aggregate choices: Sum by Day over the last 30 days; Average by Hour over the last 7 days

def _last_days_sql(days: int) -> str:
    return (f"CAST(observed_at AS DATE) >= greatest((SELECT CAST(max(observed_at) AS DATE) FROM measurements) - {days - 1},"
            " (SELECT CAST(min(observed_at) AS DATE) FROM measurements))")


@register("agg_choice_sum_day_30d", sql(_resample_sql(f"(SELECT * FROM measurements WHERE {_last_days_sql(30)})",
                                                      SQL_BUCKET["day"], agg="sum"), "measurements"))
def agg_choice_sum_day_30d(spark, d):
    m = B.measurements(spark, d)
    return _resample(Q.apply_preset(m, m, "30d"), "day", agg="sum")


@register("agg_choice_avg_hour_7d", sql(_resample_sql(f"(SELECT * FROM measurements WHERE {_last_days_sql(7)})",
                                                      SQL_BUCKET["hour"], agg="avg"), "measurements"))
def agg_choice_avg_hour_7d(spark, d):
    m = B.measurements(spark, d)
    return _resample(Q.apply_preset(m, m, "7d"), "hour", agg="avg")


# Cell validation report over text cells derived from E (a timestamp column and a float column)
@register("cell_validation", sql(f"""
SELECT row_number, "column", error, cell FROM (
  SELECT measurement_id + 2 AS row_number, 'ts' AS "column", 'Expected Timestamp' AS error, ts_text AS cell,
         TRY_CAST(ts_text AS TIMESTAMP) IS NULL AS bad FROM cells
  UNION ALL
  SELECT measurement_id + 2, 'value', 'Expected Float', raw,
         NOT coalesce(regexp_matches(raw, '{NUMERIC_SQL_RE}') AND TRY_CAST(trim(raw) AS DOUBLE) IS NOT NULL, false) FROM cells)
WHERE bad AND cell IS NOT NULL AND trim(cell) <> ''""".replace("cells", "(SELECT measurement_id, "
    "CASE WHEN measurement_id % 50 = 0 THEN 'Invalid Date' ELSE strftime(observed_at, '%Y-%m-%d %H:%M:%S') END AS ts_text, "
    "CASE measurement_id % 10 WHEN 0 THEN concat(CAST(value AS VARCHAR), 'x') WHEN 1 THEN 'NaN' WHEN 2 THEN '1d' "
    "WHEN 3 THEN ' 1,5' ELSE CAST(value AS VARCHAR) END AS raw FROM measurements)"), "measurements"))
def cell_validation(spark, d):
    from envspark.functions.timefmt import iso_datetime
    from envspark.operators.normalize import validation_report

    m = B.measurements(spark, d)
    k = F.col("measurement_id") % 10
    txt = F.col("value").cast("string")
    raw = (F.when(k == 0, F.concat(txt, F.lit("x"))).when(k == 1, F.lit("NaN")).when(k == 2, F.lit("1d"))
           .when(k == 3, F.lit(" 1,5")).otherwise(txt))
    ts_text = F.when(F.col("measurement_id") % 50 == 0, F.lit("Invalid Date")).otherwise(
        F.replace(iso_datetime(F.col("observed_at"), False), F.lit("T"), F.lit(" ")))
    cells = m.select(F.col("measurement_id").alias("_row"), ts_text.alias("ts"), raw.alias("value"))
    return validation_report(cells, {"ts": "timestamp", "value": "float"})


# S5 + S6 + S8 end to end: Spark packs E into zip archives in the shared folder (some cells cannot be read), and the ingest
# job loads them in chunks far smaller than a member; the file ledger counts the rejects by reason.

def _written_archives(folder: str):
    """Writes an archive for every ARCHIVE_LINES lines of a partition; its name follows from its bytes, so a repeated task
    writes the same files again."""
    def run(batches):
        import pandas as _pd
        import pyarrow.fs as _fs

        for pdf in _zip_partition(batches):
            for r in pdf.itertuples():
                fs, path = _fs.FileSystem.from_uri(f"{folder}/{r.path}")
                with fs.open_output_stream(path) as out:
                    out.write(r.content)
                yield _pd.DataFrame({"path": [r.path]})
    return run


_CELLS_SQL = ("(SELECT station_code, variable_code, observed_at, CASE measurement_id % 50 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'value' "
              "WHEN 2 THEN 'variable' END AS reject FROM measurements)")


@register("zip_ingest", sql(f"""
SELECT 'completed' AS status,
       (SELECT count(*) FROM (SELECT DISTINCT station_code, variable_code, observed_at FROM {_CELLS_SQL} WHERE reject IS NULL)) AS inserted,
       count(*) FILTER (reject IS NULL) AS staged_rows, count(*) FILTER (reject = 'timestamp') AS rejected_timestamp,
       count(*) FILTER (reject = 'value') AS rejected_value, count(*) FILTER (reject = 'variable') AS rejected_variable
FROM {_CELLS_SQL}""", "measurements"))
def zip_ingest(spark, d):
    from envspark.functions.timefmt import iso_datetime
    from envspark.plans import ingest_job as J

    work = STR._work_dir(spark, "zip-ingest")
    folder = work if "://" in work else f"file://{work}"
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{work}/archives/.folder")  # the folder, on whatever file system it is
    k = F.col("measurement_id") % 50
    line = F.concat_ws(";", "station_code", F.when(k == 0, F.lit("never")).otherwise(F.replace(iso_datetime("observed_at", True), F.lit("T"), F.lit(" "))),
                       F.when(k == 2, F.lit("")).otherwise(F.col("variable_code")),
                       F.when(k == 1, F.lit("-")).otherwise(F.col("value").cast("string")), "unit")
    m = B.measurements(spark, d).select(line.alias("line"))
    m.mapInPandas(_written_archives(f"{folder}/archives"), "path string").write.format("noop").mode("overwrite").save()
    run = J.ingest(spark, f"{work}/archives", f"{work}/store")
    files = J.store_table(spark, f"{work}/store", "source_files", J.FILE_LEDGER)
    return files.agg(F.lit(run["status"]).alias("status"), F.lit(run["inserted"]).cast("bigint").alias("inserted"),
                     F.sum("row_count").alias("staged_rows"), *[F.sum(f"rejected_{r}").alias(f"rejected_{r}") for r in J.REJECTS])


from envspark import catalog_more  # noqa: E402, F401  registers its queries
