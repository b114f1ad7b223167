"""Vocabularies of the measurement model.

Everything under "Fixed values" must equal the behaviour being reproduced (codes, hints, aliases,
header synonyms, units, categories, reference stations, forbidden SQL words). They are stated plainly, in
their natural order. Small DataFrames built from them are fixed-size, so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------------------------------------

# Variable codes of the station network, in vocabulary order (the order decides hint-match ties).
VARIABLE_CODES = ("CO", "NO2", "O3", "PM25", "PM10", "SO2", "DIR", "HUM", "IUV", "LLU", "PRE", "RS", "TMP", "VEL")

# Text hints per variable (matched as substrings of normalised link text / href / url).
VARIABLE_HINTS = {
    "CO": ("monoxido_carbono",),
    "NO2": ("dioxido_de_nitrogeno",),
    "O3": ("ozono",),
    "PM25": ("pm25", "particulas_menores_a_25", "particulas_menores_a_2_5"),
    "PM10": ("pm10", "particulas_menores_a_10", "particulas_menores_a_10_micrometros"),
    "SO2": ("dioxido_de_azufre",),
    "DIR": ("direccion_del_viento",),
    "HUM": ("humedad_relativa",),
    "IUV": ("radiacion_ultravioleta",),
    "LLU": ("precipitacion",),
    "PRE": ("presion_barometrica",),
    "RS": ("radiacion_solar",),
    "TMP": ("temperatura_media",),
    "VEL": ("velocidad_del_viento",),
}

# Code aliases found inside parentheses of link text, e.g. "Material particulado (PM2.5)".
VARIABLE_ALIASES = {
    "co": "CO", "no2": "NO2", "o3": "O3", "pm25": "PM25", "pm2.5": "PM25", "pm10": "PM10", "so2": "SO2",
    "dir": "DIR", "hum": "HUM", "iuv": "IUV", "llu": "LLU", "pre": "PRE", "rs": "RS", "tmp": "TMP", "vel": "VEL",
}

# Header synonyms per column role, in priority order (normalised header text).
STATION_COLUMNS = ("station", "station_id", "station_code", "estacion", "id_estacion", "codigo_estacion",
                   "cod_estacion")
DATETIME_COLUMNS = ("timestamp", "datetime", "date_time", "fecha_hora", "fechahora", "unnamed_0", "fecha_unidad",
                    "fechaunidad")
DATE_COLUMNS = ("date", "fecha")
TIME_COLUMNS = ("time", "hora")
VARIABLE_COLUMNS = ("variable", "pollutant", "contaminante", "parametro", "parameter")
VALUE_COLUMNS = ("value", "valor", "measurement", "medicion", "concentracion")
UNIT_COLUMNS = ("unit", "unidad", "units", "unidades")

# Default unit per normalised variable code.
DEFAULT_UNITS = {
    "PM25": "ug/m3", "PM2.5": "ug/m3", "PM10": "ug/m3", "NO2": "ug/m3", "SO2": "ug/m3", "O3": "ug/m3",
    "CO": "mg/m3", "TMP": "C", "TEMP": "C", "TEMPERATURA": "C", "HUM": "%", "HUMEDAD": "%", "VEL": "m/s",
    "VIENTO": "m/s", "PRE": "hPa", "PRESION": "hPa", "IUV": "index", "RS": "W/m2", "LLU": "mm",
}

# Variable categories (anything else is "other").
POLLUTANT_CODES = ("PM25", "PM2.5", "PM10", "NO2", "SO2", "O3", "CO")
METEOROLOGICAL_CODES = ("TMP", "TEMP", "TEMPERATURA", "HUM", "HUMEDAD", "VEL", "PRE", "IUV", "RS", "LLU")

# Sheet / file stems that do not name a variable.
GENERIC_SHEET_NAMES = ("HOJA1", "SHEET1", "DATA", "DATOS")
UNKNOWN_VARIABLE = "UNKNOWN_VARIABLE"
UNKNOWN_STATION = "UNKNOWN_STATION"

# File suffixes accepted by automatic sync and by manual upload.
AUTOMATIC_SUFFIXES = (".rar", ".zip", ".xlsx", ".xls")
MANUAL_SUFFIXES = (".csv", ".xlsx", ".txt")

# Reference stations: (name, latitude, longitude, region, aliases) in resolution order.
STATION_REFERENCES = (
    ("San Antonio", -0.009222, -78.448001, "Quito", ("sanantonio", "san_antonio")),
    ("Carapungo", -0.095472, -78.449809, "Quito", ("carapungo", "car")),
    ("Cotocollao", -0.107777, -78.497222, "Quito", ("cotocollao", "cot")),
    ("Belisario", -0.184719, -78.495986, "Quito", ("belisario", "bel")),
    ("Tumbaco", -0.214933, -78.403253, "Quito", ("tumbaco", "tum")),
    ("Centro", -0.221393, -78.514005, "Quito", ("centro", "cen")),
    ("El Camal", -0.25, -78.51, "Quito", ("elcamal", "el_camal", "camal", "cam")),
    ("Los Chillos", -0.297062, -78.455248, "Quito", ("loschillos", "los_chillos", "chillos", "chi")),
    ("Guamani", -0.333949, -78.553416, "Quito", ("guamani", "gua")),
)

# Words rejected anywhere in a preview statement.
FORBIDDEN_SQL_WORDS = ("insert", "update", "delete", "drop", "alter", "truncate", "create", "grant", "revoke",
                       "comment", "copy", "call", "do", "merge")

# Range presets of the analysis screen: id -> number of calendar days (None = all data).
RANGE_PRESETS = {"24h": 2, "7d": 7, "30d": 30, "90d": 90, "1y": 365, "this_year": "year", "all": None}

# Weekday labels indexed Sunday=0 .. Saturday=6.
WEEKDAY_NAMES = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")

# Pollution intensity score weights and bands; AQI bands.
POLLUTION_WEIGHTS = {"PM25": 1.0, "PM10": 0.5, "NO2": 0.5, "O3": 0.3}
POLLUTION_SCALE = 50.0
POLLUTION_BANDS = ((1.5, "green"), (3.0, "yellow"), (4.5, "orange"))  # else "red"
AQI_BANDS = ((50.0, "Good"), (100.0, "Moderate"))  # else "Unhealthy"

# Operating limits.
DEFAULT_QUERY_LIMIT = 5000
MIN_QUERY_LIMIT = 100
PREVIEW_DEFAULT_ROWS = 120
PREVIEW_MAX_ROWS = 500
SCATTER_ROWS = 4000
SAMPLE_ROWS = 180
HEATMAP_DAYS = 14
HISTOGRAM_BINS = 16
MAX_ACF_LAG = 30
DEFAULT_ARCHIVES = 4
MAX_ARCHIVES = 30
FILTER_SOURCES_LIMIT = 300

# ---------------------------------------------------------------------------------------------------------
# Small fixed-size DataFrames (safe to broadcast: their size is bounded by the literals above)
# ---------------------------------------------------------------------------------------------------------


def station_reference_df(spark: SparkSession) -> DataFrame:
    """One row per reference station with its position (first match wins)."""
    schema = T.StructType([T.StructField("ref_order", T.IntegerType(), False),
                           T.StructField("ref_name", T.StringType(), False),
                           T.StructField("ref_latitude", T.DoubleType(), False),
                           T.StructField("ref_longitude", T.DoubleType(), False),
                           T.StructField("ref_region", T.StringType(), False)])
    rows = [(i, name, lat, lon, region) for i, (name, lat, lon, region, _) in enumerate(STATION_REFERENCES)]
    return spark.createDataFrame(rows, schema)


def station_alias_tokens() -> list[tuple[int, str]]:
    """(ref_order, token) pairs: every alias and the name, normalised and without underscores."""
    from envspark.functions.text import normalize_text_fast

    out = []
    for i, (name, _lat, _lon, _region, aliases) in enumerate(STATION_REFERENCES):
        tokens = {normalize_text_fast(a).replace("_", "") for a in aliases}
        tokens.add(normalize_text_fast(name).replace("_", ""))
        out.extend((i, t) for t in sorted(tokens) if t)
    return out


def station_alias_df(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("ref_order", T.IntegerType(), False),
                           T.StructField("token", T.StringType(), False)])
    return spark.createDataFrame(station_alias_tokens(), schema)


# Cells that spell a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
           "NaN", "None", "n/a", "nan", "null")
