"""Fact queries (Q1-Q20, S10): star join, filters, capped results, filter options, latest values, ledgers.

Dimension and ledger joins are written as plain equi-joins: Spark broadcasts a side only when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE re-checks at runtime), and falls back to a
shuffle join otherwise, so no side is broadcast on faith.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark import vocab
from envspark.operators.load import resolve_station_references

STAR_COLUMNS = ["observed_at", "value", "unit", "station_code", "station_name", "variable_code", "variable_name",
                "source_file_id", "source_file_name", "source_type"]
ORDER_KEYS = ["observed_at", "station_code", "variable_code", "measurement_id"]


@dataclass
class Filters:
    """Q2/Q3 parameters; empty lists mean no filter; date_to is inclusive (whole day)."""

    source_file_ids: list[int] = field(default_factory=list)
    station_codes: list[str] = field(default_factory=list)
    variable_codes: list[str] = field(default_factory=list)
    date_from: date | None = None
    date_to: date | None = None

    def normalized(self) -> "Filters":
        """Q19: a reversed range is swapped."""
        if self.date_from and self.date_to and self.date_from > self.date_to:
            return Filters(self.source_file_ids, self.station_codes, self.variable_codes, self.date_to, self.date_from)
        return self


def star(facts: DataFrame, stations: DataFrame, variables: DataFrame, files: DataFrame,
         keep_id: bool = True) -> DataFrame:
    """Q1: measurement x station x variable x source file (inner equi-joins), 10 columns (+ id)."""
    st = stations.select("station_id", F.col("code").alias("station_code"), F.col("name").alias("station_name"))
    va = variables.select("variable_id", F.col("code").alias("variable_code"),
                          F.col("display_name").alias("variable_name"))
    sf = files.select("source_file_id", F.col("original_name").alias("source_file_name"), "source_type")
    f = facts.select("measurement_id", "station_id", "variable_id", "source_file_id", "observed_at", "value", "unit")
    joined = f.join(st, "station_id").join(va, "variable_id").join(sf, "source_file_id")
    cols = (["measurement_id"] if keep_id else []) + STAR_COLUMNS
    return joined.select(*cols)


def apply_filters(rows: DataFrame, flt: Filters) -> DataFrame:
    """Q2 + Q3: IN-lists when non-empty; observed_at >= from 00:00 and < (to + 1 day) 00:00. Rows of a stored table carry the
    day as a DATE, which prunes row groups where a TIMESTAMP_NTZ does not, so the range is set on it as well."""
    flt = flt.normalized()
    out = rows
    if "observed_date" in rows.columns:
        if flt.date_from is not None:
            out = out.where(F.col("observed_date") >= F.lit(flt.date_from))
        if flt.date_to is not None:
            out = out.where(F.col("observed_date") <= F.lit(flt.date_to))
    if flt.source_file_ids:
        out = out.where(F.col("source_file_id").isin(list(flt.source_file_ids)))
    if flt.station_codes:
        out = out.where(F.col("station_code").isin(list(flt.station_codes)))
    if flt.variable_codes:
        out = out.where(F.col("variable_code").isin(list(flt.variable_codes)))
    if flt.date_from is not None:
        out = out.where(F.col("observed_at") >= F.lit(flt.date_from.isoformat() + " 00:00:00").cast("timestamp_ntz"))
    if flt.date_to is not None:
        end = (flt.date_to + timedelta(days=1)).isoformat() + " 00:00:00"
        out = out.where(F.col("observed_at") < F.lit(end).cast("timestamp_ntz"))
    return out


def dataset_cap(facts: DataFrame, source_file_ids: list[int], limit: int | None) -> int:
    """Q4 cap: max(100, limit or 5000), bounded by the fact count of the chosen files (all files if none)."""
    scope = facts.where(F.col("source_file_id").isin(list(source_file_ids))) if source_file_ids else facts
    n = scope.select(F.count("*")).first()[0]
    requested = max(vocab.MIN_QUERY_LIMIT, limit or vocab.DEFAULT_QUERY_LIMIT)
    return min(requested, n) if n > 0 else requested


def capped(rows: DataFrame, cap: int, order: list[str] | None = None) -> DataFrame:
    """Q4: the first ``cap`` rows by observed_at (ties broken by key) and a ``truncated`` flag.

    ``limit(cap + 1)`` after ``orderBy`` is a top-k (TakeOrderedAndProject): each task keeps cap + 1 rows,
    so the window over the result sees at most cap + 1 rows.
    """
    order = order or ORDER_KEYS
    top = rows.orderBy(*order).limit(cap + 1)
    w = Window.orderBy(*order)
    marked = top.withColumn("_rn", F.row_number().over(w)).withColumn(
        "truncated", F.count("*").over(Window.partitionBy(F.lit(1))) > cap)
    return marked.where(F.col("_rn") <= cap).drop("_rn")


def filter_sources(facts: DataFrame, files: DataFrame, limit: int = vocab.FILTER_SOURCES_LIMIT) -> DataFrame:
    """Q5: completed files with their fact count (> 0), newest first; facts are counted before the join."""
    counts = facts.groupBy("source_file_id").agg(F.count("*").alias("measurement_count"))
    done = files.where(F.col("status") == "completed").select(
        "source_file_id", "original_name", "source_type", "etl_run_id", "downloaded_at")
    return (done.join(counts, "source_file_id").where(F.col("measurement_count") > 0)
            .orderBy(F.col("downloaded_at").desc(), F.col("measurement_count").desc(),
                     F.col("source_file_id").desc())
            .limit(limit))


def filter_stations(stations: DataFrame) -> DataFrame:
    """Q6: stations ordered by code, region from the reference-station resolver (null if none)."""
    resolved = resolve_station_references(stations)
    return (stations.join(resolved.select("station_id", F.col("ref_region").alias("region_ref")), "station_id",
                          "left")
            .select("code", "name", "latitude", "longitude", F.col("region_ref").alias("region"))
            .orderBy("code"))


def filter_variables(variables: DataFrame) -> DataFrame:
    return variables.select("code", F.col("display_name").alias("name")).orderBy("code")


def time_extent(facts: DataFrame) -> DataFrame:
    """Q7: min / max observed_at over all facts."""
    return facts.agg(F.min("observed_at").alias("min_observed_at"), F.max("observed_at").alias("max_observed_at"))


def latest_values(facts: DataFrame, stations: DataFrame, variables: DataFrame,
                  station_codes: list[str] | None = None) -> DataFrame:
    """Q8: latest row per (station, variable).

    A grouped ``max_by`` keyed on (observed_at, measurement_id): partial aggregation on the map side, so a
    hot (station, variable) pair is reduced before the shuffle and never collected whole.
    """
    order_key = F.struct("observed_at", "measurement_id")
    latest = facts.groupBy("station_id", "variable_id").agg(
        F.max_by(F.struct("value", "unit", "observed_at"), order_key).alias("l"))
    st = stations.select("station_id", F.col("code").alias("station_code"), F.col("name").alias("station_name"),
                         "latitude", "longitude")
    va = variables.select("variable_id", F.col("code").alias("variable_code"),
                          F.col("display_name").alias("variable_name"))
    out = latest.join(st, "station_id").join(va, "variable_id").select(
        "station_code", "station_name", "latitude", "longitude", "variable_code", "variable_name",
        F.col("l.value").alias("value"), F.col("l.unit").alias("unit"), F.col("l.observed_at").alias("observed_at"))
    if station_codes:
        out = out.where(F.col("station_code").isin(list(station_codes)))
    return out.orderBy("station_code", "variable_code")


def live_snapshot(latest: DataFrame, stations: DataFrame, nested: bool = False) -> DataFrame:
    """Q9: latest values grouped by station; coordinates fall back to the reference station, plus region,
    the number of stations and the newest observation overall (windows over the per-station rows)."""
    resolved = resolve_station_references(stations).select(
        F.col("code").alias("station_code"), "ref_latitude", "ref_longitude", "ref_region")
    per = latest.groupBy("station_code", "station_name", "latitude", "longitude").agg(
        F.count("*").alias("n_variables"), F.max("observed_at").alias("latest_observed_at"),
        *([F.sort_array(F.collect_list(F.struct("variable_code", "variable_name", "value", "unit",
                                                "observed_at"))).alias("variables")] if nested else []))
    everything = Window.partitionBy(F.lit(1))  # over one row per station
    out = per.join(resolved, "station_code", "left").select(
        "station_code", "station_name",
        F.coalesce("latitude", "ref_latitude").alias("latitude"),
        F.coalesce("longitude", "ref_longitude").alias("longitude"),
        F.col("ref_region").alias("region"), "n_variables", "latest_observed_at",
        F.count("*").over(everything).alias("total"),
        F.max("latest_observed_at").over(everything).alias("global_latest_observed_at"),
        *(["variables"] if nested else []))
    return out.orderBy("station_code")


def station_list(stations: DataFrame) -> DataFrame:
    """Q12: stations by code, missing coordinates as 0.0, with the total count."""
    return (stations.select("station_id", "code", "name",
                            F.coalesce("latitude", F.lit(0.0)).alias("latitude"),
                            F.coalesce("longitude", F.lit(0.0)).alias("longitude"))
            .withColumn("total", stations.select(F.count("*")).scalar())
            .orderBy("code"))


def checked_limit(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    return limit


def run_list(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Q13: newest runs first; a limit outside 1..200 is an error."""
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(checked_limit(limit, 200))


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def store_metrics(facts: DataFrame, stations: DataFrame, variables: DataFrame, runs: DataFrame) -> DataFrame:
    """Q14: counts of facts / stations / variables and the status of the newest run ('never-run')."""
    one = facts.agg(F.count("*").alias("total_measurements"))
    return one.select(
        "total_measurements",
        stations.select(F.count("*")).scalar().alias("total_stations"),
        variables.select(F.count("*")).scalar().alias("total_variables"),
        F.coalesce(runs.select(F.max_by("status", F.struct("started_at", "id"))).scalar(),
                   F.lit("never-run")).alias("last_run_status"),
    )


def run_preview(facts: DataFrame, stations: DataFrame, variables: DataFrame, files: DataFrame, runs: DataFrame,
                run_id: str | None = None, limit: int = 100) -> DataFrame:
    """Q15: facts of one run's files (the newest run if none given), newest first; a limit outside 1..500 is an error."""
    n = checked_limit(limit, 500)
    if run_id is None:
        run_id_col = runs.select(F.max_by("id", F.struct("started_at", "id"))).scalar()
    else:
        run_id_col = F.lit(run_id)
    run_files = files.where(F.col("etl_run_id") == run_id_col).select("source_file_id", "etl_run_id")
    rows = star(facts, stations, variables, files).join(run_files, "source_file_id", "left_semi")
    return rows.orderBy(F.col("observed_at").desc(), F.col("station_code"), F.col("variable_code"),
                        F.col("measurement_id").desc()).limit(n)


def source_search(files: DataFrame, keyword: str) -> DataFrame:
    """Q16: trimmed lower-case keyword contained in name, source type or run id; blank keyword = all."""
    kw = (keyword or "").strip().lower()
    if not kw:
        return files
    hay = F.lower(F.concat_ws(" ", "original_name", "source_type", "etl_run_id"))
    return files.where(hay.contains(kw))


def preset_range(facts: DataFrame, preset: str) -> tuple:
    """Q17: (date_from, date_to) columns of a preset, anchored at the newest data date, not before the oldest."""
    if preset not in vocab.RANGE_PRESETS:
        raise ValueError(f"preset must be one of {sorted(vocab.RANGE_PRESETS)}")
    days = vocab.RANGE_PRESETS[preset]
    g = facts.select(F.struct(F.to_date(F.min("observed_at")).alias("mn"),
                              F.to_date(F.max("observed_at")).alias("mx"))).scalar()
    mn, mx = g.getField("mn"), g.getField("mx")
    if days is None:
        return mn, mx
    start = F.trunc(mx, "year") if days == "year" else F.date_sub(mx, days - 1)
    return F.greatest(start, mn), mx


def apply_preset(rows: DataFrame, facts: DataFrame, preset: str) -> DataFrame:
    lo, hi = preset_range(facts, preset)
    d = F.to_date("observed_at")
    return rows.where((d >= lo) & (d <= hi))


def first_rows(rows: DataFrame, n: int = vocab.SAMPLE_ROWS, order: list[str] | None = None) -> DataFrame:
    """Q20: first n rows of the result order."""
    return rows.orderBy(*(order or ORDER_KEYS)).limit(n)


def zoom_bounds(first: Column, last: Column, low: float, high: float) -> tuple[Column, Column]:
    """Q18: the days at ``low`` and ``high`` per cent of the way from the day ``first`` to the day ``last``. Shares stand between 0
    and 100, the second not below the first; a range of no length stays as it is."""
    low, high = sorted((min(max(low, 0.0), 100.0), max(min(max(low, 0.0), 100.0), min(max(high, 0.0), 100.0))))
    days = F.datediff(last, first)
    at = lambda share: F.date_add(first, F.floor(days * share / 100).cast("int"))
    return F.when(days > 0, at(low)).otherwise(first), F.when(days > 0, at(high)).otherwise(last)


def zoomed_days(first: date | None, last: date | None, low: float, high: float) -> tuple[date | None, date | None]:
    """``zoom_bounds`` of two given days."""
    length = (last - first).days if first and last else 0
    if length <= 0:
        return first, last
    shares = min(max(low, 0), 100), min(max(low, high, 0), 100)
    return tuple(first + timedelta(days=length * share // 100) for share in shares)


# Canned samples of the stored tables (S10): table -> ordering.
TABLE_SAMPLE_ORDER = {
    "measurements": [("observed_at", False), ("measurement_id", False)],
    "stations": [("code", True)],
    "variables": [("code", True)],
    "source_files": [("downloaded_at", False), ("source_file_id", False)],
    "etl_runs": [("started_at", False), ("id", False)],
}


def table_sample(df: DataFrame, table: str, n: int = vocab.PREVIEW_DEFAULT_ROWS) -> DataFrame:
    """``SELECT * FROM t ORDER BY ...`` preview of a stored table."""
    order = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in TABLE_SAMPLE_ORDER[table]]
    return df.orderBy(*order).limit(n)
