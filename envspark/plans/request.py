"""One analysis request -> a set of DataFrames (nothing is collected here; the hourly partials are written once).

The request carries the screen's choices (filters, preset range, zoom, granularity, split, aggregate,
category); ``analysis_rows`` builds the filtered star rows (Q1-Q3, Q17-Q19, A19 category) and
``run_analysis`` derives every chart of the analysis workspace from them (A1-A13, Q20). Catalyst plans
each output as a whole; callers act on the outputs they need.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.operators import partials as P
from envspark.operators import queries as Q
from envspark.operators import timeseries as A
from envspark.session import cut_lineage


@dataclass
class AnalysisRequest:
    filters: Q.Filters = field(default_factory=Q.Filters)
    preset: str | None = None                     # Q17: 24h / 7d / 30d / 1y / all
    zoom: tuple[float, float] | None = None       # Q18: percentages of the chosen range
    granularity: str = "day"                      # A1: hour / day / week / month / year
    agg: str = "avg"                              # A19: avg / sum / min / max
    category: str | None = None                   # A19: pollutant / meteorological
    rolling_window: int = 14                      # A10
    seasonality: str = "weekday"                  # A11
    heatmap_days: int = 14                        # A7

    @property
    def split_by_station(self) -> bool:
        """A2: lines per station when more than one station is selected, else per variable."""
        return len(self.filters.station_codes) > 1


def analysis_rows(facts: DataFrame, stations: DataFrame, variables: DataFrame, files: DataFrame,
                  req: AnalysisRequest) -> DataFrame:
    flt = req.filters.normalized()
    if req.zoom is not None and flt.date_from and flt.date_to:
        lo, hi = Q.zoomed_days(flt.date_from, flt.date_to, *req.zoom)
        flt = Q.Filters(flt.source_file_ids, flt.station_codes, flt.variable_codes, lo, hi)
    rows = Q.apply_filters(Q.star(facts, stations, variables, files), flt)
    if req.preset:
        rows = Q.apply_preset(rows, facts, req.preset)
    if req.category:
        cat = variables.where(F.col("category") == req.category).select(F.col("code").alias("variable_code"))
        rows = rows.join(cat, "variable_code", "left_semi")
    return rows


def run_analysis(facts: DataFrame, stations: DataFrame, variables: DataFrame, files: DataFrame,
                 req: AnalysisRequest) -> dict[str, DataFrame]:
    rows = analysis_rows(facts, stations, variables, files, req)
    series_col = "station_code" if req.split_by_station else "variable_code"
    # one pass over the selected facts; every output over time reads the hourly partials, written once
    parts = cut_lineage(P.hourly(rows))
    points = P.resample(parts, req.granularity, series_col, req.agg)
    overall = points.where(F.col("series") == A.OVERALL).select("bucket", "series", "value")
    return {
        "rows": rows,
        "series": points,
        "series_keys": A.series_rank(rows, series_col, None if req.split_by_station else 4),
        "station_means": P.station_means(parts),
        "scatter": A.hour_scatter(rows, Q.ORDER_KEYS),
        "histogram": A.histogram(rows),
        "heatmap": A.heat_scale(P.heatmap(parts, req.heatmap_days)),
        "summary": P.summary_trend(parts, points),
        "rolling": A.rolling_band(overall, req.rolling_window),
        "seasonal": P.seasonal_profile(parts, req.seasonality),
        "autocorrelation": A.autocorrelation(overall),
        "anomalies": A.iqr_anomalies(overall),
        "sample": Q.first_rows(rows),
    }
