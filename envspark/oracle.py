"""DuckDB SQL for every registered query: the independent statement of what each one must return.

The bound model tables (FIXTURES.md §1) are CTEs over the given parquet views; ``sql(body, *ctes)``
prefixes a query body with the CTEs it uses (dependencies are added automatically).
Float outputs are rounded with R6 (half-up to 9 decimals, then to 6) on both engines.
"""

from __future__ import annotations

CTE = {}
DEPS = {}


def _cte(name: str, body: str, deps: tuple[str, ...] = ()) -> None:
    CTE[name] = body
    DEPS[name] = deps


def R6(x: str) -> str:
    return f"(floor(floor(({x}) * 1e9 + 0.5) / 1000.0 + 0.5) / 1e6)"


_cte("measurements", """
SELECT event_id AS measurement_id,
       CAST(user_id % 25 AS INT) AS station_id,
       concat('ST', lpad(CAST(user_id % 25 AS VARCHAR), 2, '0')) AS station_code,
       CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4
                       ELSE 5 END AS variable_id,
       CASE event_type WHEN 'click' THEN 'PM25' WHEN 'view' THEN 'PM10' WHEN 'purchase' THEN 'NO2'
                       WHEN 'signup' THEN 'O3' ELSE 'CO' END AS variable_code,
       ts AS observed_at, value,
       CASE WHEN event_type = 'error' THEN 'mg/m3' ELSE 'ug/m3' END AS unit,
       CAST(floor(event_id / 100) AS INT) + 1 AS source_file_id
FROM events""")

_cte("measurements_li", """
SELECT CAST(l_suppkey % 25 AS INT) AS station_id,
       concat('ST', lpad(CAST(l_suppkey % 25 AS VARCHAR), 2, '0')) AS station_code,
       CASE l_returnflag WHEN 'A' THEN 'PM25' WHEN 'N' THEN 'PM10' ELSE 'NO2' END AS variable_code,
       l_shipdate AS observed_at, l_quantity AS value
FROM lineitem""")

_cte("stations_base", """
SELECT n_nationkey AS station_id, n_name AS name,
       CASE WHEN n_nationkey % 5 = 4 THEN CAST(NULL AS DOUBLE)
            ELSE CAST(n_nationkey AS DOUBLE) / 50 - CAST(0.4 AS DOUBLE) END AS latitude,
       CASE WHEN n_nationkey % 5 = 4 THEN CAST(NULL AS DOUBLE)
            ELSE CAST(n_nationkey AS DOUBLE) / 100 - CAST(78.6 AS DOUBLE) END AS longitude,
       r_name AS region, true AS is_active
FROM (SELECT DISTINCT station_id FROM measurements) p
JOIN nation ON p.station_id = n_nationkey JOIN region ON n_regionkey = r_regionkey""", ("measurements",))

_cte("stations", """
SELECT station_id, concat('ST', lpad(CAST(station_id AS VARCHAR), 2, '0')) AS code, name, latitude, longitude,
       region, is_active
FROM stations_base""", ("stations_base",))

_cte("stations_ref", """
SELECT station_id, code,
       CASE WHEN station_id < 9 AND station_id % 2 = 0 THEN code ELSE name END AS name,
       latitude, longitude, region, is_active
FROM (SELECT *, CASE station_id WHEN 0 THEN 'SANANTONIO' WHEN 1 THEN 'CAR' WHEN 2 THEN 'COT' WHEN 3 THEN 'BEL'
                  WHEN 4 THEN 'TUM' WHEN 5 THEN 'CEN' WHEN 6 THEN 'EL_CAMAL' WHEN 7 THEN 'CHI' WHEN 8 THEN 'GUA'
                  ELSE concat('ST', lpad(CAST(station_id AS VARCHAR), 2, '0')) END AS code
      FROM stations_base)""", ("stations_base",))

_cte("variables", """
SELECT DISTINCT variable_id, variable_code AS code, variable_code AS display_name,
       CASE WHEN upper(variable_code) IN ('PM25','PM2.5','PM10','NO2','SO2','O3','CO') THEN 'pollutant'
            WHEN upper(variable_code) IN ('TMP','TEMP','TEMPERATURA','HUM','HUMEDAD','VEL','PRE','IUV','RS','LLU')
            THEN 'meteorological' ELSE 'other' END AS category,
       CASE variable_code WHEN 'CO' THEN 'mg/m3' ELSE 'ug/m3' END AS default_unit
FROM measurements""", ("measurements",))

_cte("source_files", """
SELECT source_file_id,
       concat('run-', lpad(CAST(CAST(floor((source_file_id - 1) / 10) AS INT) + 1 AS VARCHAR), 3, '0')) AS etl_run_id,
       CASE WHEN source_file_id % 3 = 0 THEN 'manual' ELSE 'automatic' END AS source_type,
       concat('file_', lpad(CAST(source_file_id AS VARCHAR), 5, '0'), '.csv') AS original_name,
       CASE WHEN source_file_id % 13 = 0 THEN 'failed' ELSE 'completed' END AS status,
       downloaded_at, row_count
FROM (SELECT source_file_id, max(observed_at) AS downloaded_at, count(*) AS row_count
      FROM measurements GROUP BY source_file_id)""", ("measurements",))

_cte("etl_runs", """
SELECT etl_run_id AS id, min(source_type) AS trigger_type,
       CASE WHEN max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) = 1 THEN 'failed' ELSE 'completed' END AS status,
       min(downloaded_at) AS started_at, max(downloaded_at) AS finished_at,
       count(*) AS archives_processed, CAST(sum(row_count) AS BIGINT) AS records_inserted
FROM source_files GROUP BY etl_run_id""", ("source_files",))

_cte("star", """
SELECT m.measurement_id, m.observed_at, m.value, m.unit, s.code AS station_code, s.name AS station_name,
       v.code AS variable_code, v.display_name AS variable_name, f.source_file_id,
       f.original_name AS source_file_name, f.source_type
FROM measurements m JOIN stations s ON m.station_id = s.station_id
JOIN variables v ON m.variable_id = v.variable_id JOIN source_files f ON m.source_file_id = f.source_file_id""",
     ("measurements", "stations", "variables", "source_files"))

_cte("hourly", """
SELECT station_code, variable_code, CAST(date_trunc('hour', observed_at) AS TIMESTAMP) AS observed_at,
       value, unit, source_file_id, measurement_id AS load_order
FROM measurements""", ("measurements",))

# Reference stations: (ref_order, name, lat, lon, region) and their alias tokens.
_cte("ref_stations", """
SELECT * FROM (VALUES (0, 'San Antonio', -0.009222, -78.448001, 'Quito'), (1, 'Carapungo', -0.095472, -78.449809, 'Quito'),
  (2, 'Cotocollao', -0.107777, -78.497222, 'Quito'), (3, 'Belisario', -0.184719, -78.495986, 'Quito'),
  (4, 'Tumbaco', -0.214933, -78.403253, 'Quito'), (5, 'Centro', -0.221393, -78.514005, 'Quito'),
  (6, 'El Camal', -0.25, -78.51, 'Quito'), (7, 'Los Chillos', -0.297062, -78.455248, 'Quito'),
  (8, 'Guamani', -0.333949, -78.553416, 'Quito'))
  AS r(ref_order, ref_name, ref_latitude, ref_longitude, ref_region)""")

_cte("ref_tokens", """
SELECT * FROM (VALUES (0,'sanantonio'), (1,'carapungo'), (1,'car'), (2,'cotocollao'), (2,'cot'), (3,'belisario'),
  (3,'bel'), (4,'tumbaco'), (4,'tum'), (5,'centro'), (5,'cen'), (6,'elcamal'), (6,'camal'), (6,'cam'),
  (7,'loschillos'), (7,'chillos'), (7,'chi'), (8,'guamani'), (8,'gua')) AS t(ref_order, token)""")


def NORM(x: str) -> str:
    """normalize_text for the oracle: accents stripped, trimmed, lower, whitespace -> _, [a-z0-9_] only."""
    return (f"regexp_replace(regexp_replace(lower(trim(strip_accents({x}), ' \t\n\r\x0b\x0c')), "
            f"'[ \t\n\r\x0b\x0c]+', '_', 'g'), '[^a-z0-9_]+', '', 'g')")


_cte("resolved_ref", f"""
SELECT s.station_id, s.code, min(t.ref_order) AS ref_order
FROM (SELECT station_id, code, replace({NORM('code')}, '_', '') AS token FROM stations_ref
      UNION ALL SELECT station_id, code, replace({NORM("coalesce(name, '')")}, '_', '') FROM stations_ref) s
JOIN ref_tokens t ON s.token = t.token
GROUP BY s.station_id, s.code""", ("stations_ref", "ref_tokens"))


def sql(body: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in ordered) + "\n" + body.strip()
