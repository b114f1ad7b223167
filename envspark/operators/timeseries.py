"""Time-series analytics (A1-A22) as DataFrame transforms.

Inputs are fact frames with ``observed_at`` (TIMESTAMP_NTZ) and ``value``; ``series`` names the column that
splits the analysis (variable, station, ...). "Points" are the output of ``resample``: one row per
(bucket, series) plus the ``overall`` series. Windows always partition by series; the ``overall`` series is a
partition of its own whose size is the number of buckets (bounded by time span / granularity, not by data).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark import vocab
from envspark.functions.scalar import global_stats
from envspark.functions.timefmt import (bucket_key, day_string, hour_of_day_fraction, weekday_index,
                                        weekday_name)
from envspark.operators.positions import positional_values

OVERALL = "overall"


# ---------------------------------------------------------------------------------------------------------
# A1-A3 resample, ranking, pivot
# ---------------------------------------------------------------------------------------------------------

def resample(df: DataFrame, granularity: str, series: str | None = "variable_code", agg: str = "avg",
             with_overall: bool = True, ts: str = "observed_at", value: str = "value") -> DataFrame:
    """A1: (bucket, series, value, n). ``overall`` = the aggregate over all rows of the bucket.

    One scan: partial aggregates per (bucket, series) are computed once; the overall rows are a second,
    tiny aggregation of those partials (the shuffle of the first is reused by both branches).
    """
    if agg not in ("avg", "sum", "min", "max"):
        raise ValueError("agg must be avg, sum, min or max")
    key = bucket_key(ts, granularity).alias("bucket")
    ser = (F.col(series).cast("string") if series else F.lit(OVERALL)).alias("series")
    per = (df.select(key, ser, F.col(value).alias("v"))
           .groupBy("bucket", "series")
           .agg(F.sum("v").alias("s"), F.count("v").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")))

    def finish(frame: DataFrame) -> DataFrame:
        out = {"avg": F.col("s") / F.col("n"), "sum": F.col("s"), "min": F.col("mn"), "max": F.col("mx")}[agg]
        return frame.select("bucket", "series", out.alias("value"), "n")

    result = finish(per)
    if with_overall and series:
        over = (per.groupBy("bucket")
                .agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
                .withColumn("series", F.lit(OVERALL)))
        result = result.unionByName(finish(over))
    return result


def series_rank(df: DataFrame, series: str = "variable_code", top_k: int | None = 4,
                ts: str = "observed_at") -> DataFrame:
    """A2: series by row count desc; ties keep first-seen order (earliest observation), then name; keep
    top_k (None = all, as when splitting by station)."""
    counts = df.groupBy(F.col(series).cast("string").alias("series")).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_seen"))
    ordered = counts.orderBy(F.col("n").desc(), F.col("first_seen").asc(), F.col("series").asc()).drop(
        "first_seen")
    return ordered.limit(top_k) if top_k else ordered


def series_pivot(df: DataFrame, granularity: str, series: str, values: list[str],
                 ts: str = "observed_at", value: str = "value") -> DataFrame:
    """A3: one row per bucket, one mean column per listed series value, plus ``overall``.

    The pivot values are given (a vocabulary), so no extra job is needed to discover them; this is the
    conditional aggregation that ``pivot`` compiles to, in a single pass together with ``overall``.
    """
    key = bucket_key(ts, granularity).alias("bucket")
    cols = [F.avg(F.when(F.col(series) == v, F.col(value))).alias(v) for v in values]
    return df.groupBy(key).agg(*cols, F.avg(value).alias(OVERALL))


# ---------------------------------------------------------------------------------------------------------
# A4-A8, A14 bars, scatter, histogram, heatmap
# ---------------------------------------------------------------------------------------------------------

def station_means(df: DataFrame, station: str = "station_code", value: str = "value") -> DataFrame:
    """A4: mean per station, highest first."""
    return (df.groupBy(station).agg(F.avg(value).alias("avg_value"), F.count("*").alias("n"))
            .orderBy(F.col("avg_value").desc(), F.col(station)))


def hour_scatter(df: DataFrame, order: list[str], n_rows: int = vocab.SCATTER_ROWS,
                 ts: str = "observed_at", station: str = "station_code", value: str = "value") -> DataFrame:
    """A5: the first n rows in result order; x = hour + minutes/60 (2 decimals), y = value."""
    first = df.orderBy(*order).limit(n_rows)
    return first.select(F.col(station), hour_of_day_fraction(ts).alias("hour"), F.col(value).alias("value"), *[
        c for c in order if c not in (station, value)])


def histogram(df: DataFrame, bins: int = vocab.HISTOGRAM_BINS, value: str = "value") -> DataFrame:
    """Equal-width bins over [min, max]; empty bins kept; one bin when max - min < 1e-9.

    min / max / count are one scalar subquery (a single small job, inlined as literals), so the binning itself
    is a map + partial aggregation with no join against the data.
    """
    spark = df.sparkSession
    v = F.col(value)
    stats = df.select(v.alias("v")).where(v.isNotNull())
    g = global_stats(stats, mn=F.min("v"), mx=F.max("v"), n=F.count("v"))
    mn, mx, n_all = g.getField("mn"), g.getField("mx"), g.getField("n")
    flat = F.abs(mx - mn) < F.lit(1e-9)
    width = (mx - mn) / F.lit(float(bins))
    x = F.col("v")
    idx = F.when(flat, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((x - mn) / width).cast("int")))
    counts = stats.select(idx.alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    axis = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = axis.join(F.broadcast(counts), "bin", "left")
    start = F.when(flat, mn).otherwise(mn + width * F.col("bin"))
    end = F.when(flat, mx).otherwise(mn + width * F.col("bin") + width)
    out = joined.select("bin", start.alias("bin_start"), end.alias("bin_end"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
    # single-bin case keeps bin 0 only; no rows at all gives no bins
    return out.where((~flat | (F.col("bin") == 0)) & (n_all > 0))


def heatmap(df: DataFrame, n_days: int = vocab.HEATMAP_DAYS, ts: str = "observed_at",
            value: str = "value") -> DataFrame:
    """Mean per (day, hour) over the last n_days distinct days; missing cells are absent."""
    cells = (df.select(day_string(ts).alias("day"), F.hour(ts).alias("hour"), F.col(value))
             .groupBy("day", "hour").agg(F.avg(value).alias("mean_value"), F.count("*").alias("n")))
    last_days = cells.select("day").distinct().orderBy(F.col("day").desc()).limit(n_days)
    return cells.join(F.broadcast(last_days), "day", "left_semi")


def heatmap_page(df: DataFrame, window_days: int = 7, offset: int = 0, n_days: int = vocab.HEATMAP_DAYS,
                 ts: str = "observed_at", value: str = "value") -> DataFrame:
    """A page of the heatmap of 7 to 60 days (else an error), counted from the newest day; an offset beyond the oldest page
    shows that page."""
    if not 7 <= window_days <= 60:
        raise ValueError("window_days must be between 7 and 60")
    win = window_days
    cells = heatmap(df, n_days, ts, value)
    days = cells.select("day").distinct()
    total = days.select(F.count("*")).scalar()
    safe_offset = F.least(F.lit(max(0, offset)), F.greatest(F.lit(0), total - F.lit(win)))
    # rank from the newest day; the distinct-day list is bounded by n_days, so one window task is fine
    ranked = days.withColumn("r", F.row_number().over(Window.orderBy(F.col("day").desc())))
    keep = ranked.where((F.col("r") > safe_offset) & (F.col("r") <= safe_offset + F.lit(win))).select("day")
    return cells.join(F.broadcast(keep), "day", "left_semi")


def heat_scale(cells: DataFrame, value: str = "mean_value") -> DataFrame:
    """(v - min) / (max - min) over the cells; 0 when the range is flat."""
    g = global_stats(cells, mn=F.min(value), mx=F.max(value))
    mn, mx = g.getField("mn"), g.getField("mx")
    ratio = F.when(mx <= mn, F.lit(0.0)).otherwise((F.col(value) - mn) / (mx - mn))
    return cells.withColumn("intensity", ratio)


# ---------------------------------------------------------------------------------------------------------
# A9-A13 summary, rolling band, seasonality, autocorrelation, anomalies
# ---------------------------------------------------------------------------------------------------------

def summary_trend(df: DataFrame, points: DataFrame, value: str = "value") -> DataFrame:
    """Samples, mean, min, max over rows; trend from last - first ``overall`` point.

    Rising / Falling when |delta| exceeds max(0.05, 2 % of |mean|); fewer than two points or no rows: Stable.
    """
    ov = points.where(F.col("series") == OVERALL)
    g = global_stats(ov, first=F.min_by("value", "bucket"), last=F.max_by("value", "bucket"), n=F.count("*"))
    first, last, n_points = g.getField("first"), g.getField("last"), g.getField("n")
    stats = df.agg(F.count(value).alias("samples"), F.avg(value).alias("mean"), F.min(value).alias("min"),
                   F.max(value).alias("max"))
    delta = last - first
    threshold = F.greatest(F.lit(0.05), F.abs(F.col("mean")) * F.lit(0.02))
    trend = (F.when(n_points < 2, F.lit("Stable")).when(delta > threshold, F.lit("Rising"))
             .when(delta < -threshold, F.lit("Falling")).otherwise(F.lit("Stable")))
    return stats.select(
        "samples",
        F.coalesce(F.col("mean"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.col("min"), F.lit(0.0)).alias("min"),
        F.coalesce(F.col("max"), F.lit(0.0)).alias("max"),
        F.when(F.col("samples") == 0, F.lit("Stable")).otherwise(trend).alias("trend"),
    )


def rolling_band(points: DataFrame, window_points: int = 14) -> DataFrame:
    """A10: rolling mean +- population std over the last w points of each series (partial at the start); w is 2 to 90,
    else an error."""
    if not 2 <= window_points <= 90:
        raise ValueError("window_points must be between 2 and 90")
    w = window_points
    win = Window.partitionBy("series").orderBy("bucket").rowsBetween(-(w - 1), 0)
    mean = F.avg("value").over(win)
    std = F.stddev_pop("value").over(win)
    return points.select("bucket", "series", "value", mean.alias("mean"), (mean + std).alias("upper"),
                         (mean - std).alias("lower"))


def seasonal_profile(df: DataFrame, mode: str, ts: str = "observed_at", value: str = "value") -> DataFrame:
    """Mean of raw rows by weekday name / month '01'-'12' / hour '00'-'23' (+ natural order column)."""
    if mode == "weekday":
        key, order = weekday_name(ts), weekday_index(ts)
    elif mode == "month":
        key, order = F.lpad(F.month(ts).cast("string"), 2, "0"), F.month(ts)
    elif mode == "hour":
        key, order = F.lpad(F.hour(ts).cast("string"), 2, "0"), F.hour(ts)
    else:
        raise ValueError("mode must be weekday, month or hour")
    return (df.select(key.alias("bucket"), order.alias("sort_key"), F.col(value))
            .groupBy("bucket", "sort_key").agg(F.avg(value).alias("value"), F.count("*").alias("n")))


def autocorrelation(points: DataFrame, max_lag: int = vocab.MAX_ACF_LAG) -> DataFrame:
    """r_k = sum_t (x_t - m)(x_{t-k} - m) / sum (x - m)^2 for k = 1..min(max_lag, n - 2).

    One pass per series: the centred value and its ``max_lag`` lags come from one window; the sums are a
    grouped aggregate; ``stack`` turns the lag columns into rows. Empty when n < 3 or the variance is ~0.
    """
    whole = Window.partitionBy("series")
    ordered = Window.partitionBy("series").orderBy("bucket")
    centred = points.select("series", "bucket", (F.col("value") - F.avg("value").over(whole)).alias("d"),
                            F.count("*").over(whole).alias("n"))
    lags = centred.select("series", "n", "d", *[F.lag("d", k).over(ordered).alias(f"l{k}")
                                                for k in range(1, max_lag + 1)])
    sums = lags.groupBy("series").agg(F.max("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("den"),
                                      *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"s{k}")
                                        for k in range(1, max_lag + 1)])
    stack = "stack({}, {}) AS (lag, num)".format(max_lag, ", ".join(f"{k}, s{k}" for k in range(1, max_lag + 1)))
    long = sums.selectExpr("series", "n", "den", stack)
    return (long.where((F.col("n") >= 3) & (F.col("den") > 1e-12) & (F.col("lag") <= F.col("n") - 2))
            .select("series", F.col("lag").cast("int").alias("lag"), (F.col("num") / F.col("den")).alias("acf")))


def iqr_anomalies(points: DataFrame) -> DataFrame:
    """Quartiles by position (sorted[floor(n/4)], sorted[floor(3n/4)], 0-based), 1.5 IQR fences.

    n < 5: points unchanged (flags and fences null). Normal points get a null anomaly_value. The quartiles come by
    histogram refinement (``positions``), so no task sorts a series.
    """
    n = F.col("n")
    quartiles = positional_values(points, "series", F.col("value"), {"q1": F.floor(n * 0.25), "q3": F.floor(n * 0.75)})
    fenced = points.join(quartiles, "series")
    iqr = F.col("q3") - F.col("q1")
    lower = F.col("q1") - iqr * 1.5
    upper = F.col("q3") + iqr * 1.5
    enough = F.col("n") >= 5
    flag = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return (fenced.select("bucket", "series", "value", "n",
                          F.when(enough, lower).alias("lower"), F.when(enough, upper).alias("upper"))
            .select("bucket", "series", "value",
                    F.when(F.col("n") >= 5, flag.cast("int")).alias("is_anomaly"),
                    F.when((F.col("n") >= 5) & flag, F.col("value")).alias("anomaly_value"),
                    "lower", "upper"))


# ---------------------------------------------------------------------------------------------------------
# A15-A22 dashboard scores, contract aggregations, correlation, wind rose, diurnal, radius join
# ---------------------------------------------------------------------------------------------------------

def pollution_band(latest: DataFrame, station: str = "station_code", variable: str = "variable_code",
                   value: str = "value") -> DataFrame:
    """score = (PM25 + 0.5 PM10 + 0.5 NO2 + 0.3 O3) / 50 on latest values (missing = 0); colour band."""
    cols = [F.max(F.when(F.col(variable) == code, F.col(value))).alias(code.lower())
            for code in vocab.POLLUTION_WEIGHTS]
    wide = latest.groupBy(station).agg(*cols)
    score = sum(F.coalesce(F.col(code.lower()), F.lit(0.0)) * F.lit(w)
                for code, w in vocab.POLLUTION_WEIGHTS.items()) / F.lit(vocab.POLLUTION_SCALE)
    band = None
    for limit, name in vocab.POLLUTION_BANDS:
        band = F.when(F.col("score") <= limit, F.lit(name)) if band is None else band.when(
            F.col("score") <= limit, F.lit(name))
    return wide.withColumn("score", score).withColumn("band", band.otherwise(F.lit("red")))


def aqi_band_col(aqi: Column) -> Column:
    (g, good), (m, moderate) = vocab.AQI_BANDS
    return F.when(aqi <= g, F.lit(good)).when(aqi <= m, F.lit(moderate)).otherwise(F.lit("Unhealthy"))


def aqi_alerts(index_rows: DataFrame, station: str = "station_code", aqi: str = "aqi") -> DataFrame:
    """Band each index value; per station the counts per band and the alert count (band <> Good)."""
    banded = index_rows.withColumn("band", aqi_band_col(F.col(aqi)))
    return banded.groupBy(station).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("band") == "Good").alias("n_good"),
        F.count_if(F.col("band") == "Moderate").alias("n_moderate"),
        F.count_if(F.col("band") == "Unhealthy").alias("n_unhealthy"),
        F.count_if(F.col("band") != "Good").alias("n_alerts"),
    )


def trend_slope(points: DataFrame) -> DataFrame:
    """A17 trend: least-squares slope of the series per day index (bucket must be a 'YYYY-MM-DD' day)."""
    x = F.unix_date(F.to_date("bucket")).cast("double")
    return points.groupBy("series").agg(F.regr_slope(F.col("value"), x).alias("slope"),
                                        F.count("*").alias("n"))


def correlation_matrix(df: DataFrame, variables: list[str], align: list[str], granularity: str = "hour",
                       variable: str = "variable_code", ts: str = "observed_at", value: str = "value") -> DataFrame:
    """Pearson correlation of every variable pair after aligning on (align cols, time bucket).

    Aligned means are a wide frame (conditional aggregation); every pair is one ``corr`` aggregate of that
    frame, computed in a single pass with no self-join. The result is stacked into (var_a, var_b, corr, n).
    """
    key = bucket_key(ts, granularity).alias("bucket")
    wide = df.groupBy(*align, key).agg(*[F.avg(F.when(F.col(variable) == v, F.col(value))).alias(v)
                                         for v in variables])
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i + 1:]]
    aggs = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(a, b).alias(f"c_{a}_{b}"), F.count_if(both).alias(f"n_{a}_{b}")]
    one = wide.agg(*aggs)
    stack = "stack({}, {}) AS (var_a, var_b, corr, n)".format(
        len(pairs), ", ".join(f"'{a}', '{b}', c_{a}_{b}, n_{a}_{b}" for a, b in pairs))
    return one.selectExpr(stack)


def as_of(df: DataFrame, left: str, right: str, tolerance_s: int, key: str = "station_id", variable: str = "variable_code",
          ts: str = "observed_at", value: str = "value", order: str = "measurement_id") -> DataFrame:
    """(key, ts, left, right): every measurement of variable ``left`` with the last one of ``right`` of its key that is not
    later and at most ``tolerance_s`` seconds older; rows without one are left out.

    Time is cut into slots of the tolerance. A right row goes to its own slot and the next, a left row to its own, so a left
    row meets every right row it may take, and a window holds two slots of one key, never a whole series. Of right rows
    at one time the one of the greatest ``order`` counts.
    """
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")
    rows = df.where(F.col(variable).isin(left, right) & F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull()).select(
        key, ts, (F.col(variable) == left).alias("is_left"), F.col(value).alias("v"), F.col(order).alias("o"), micros.alias("at"))
    slot = F.floor(F.col("at") / (tolerance_s * 1_000_000))
    slots = F.when(F.col("is_left"), F.array(slot)).otherwise(F.array(slot, slot + 1))
    rows = rows.withColumn("slot", F.explode(slots))
    before = Window.partitionBy(key, "slot").orderBy("at", "is_left", "o").rowsBetween(Window.unboundedPreceding, 0)
    right_row = F.when(~F.col("is_left"), F.struct("at", "v"))
    met = rows.withColumn("r", F.last(right_row, ignorenulls=True).over(before)).where("is_left")
    return met.where(F.col("at") - F.col("r.at") <= tolerance_s * 1_000_000).select(
        key, ts, F.col("v").alias("left"), F.col("r.v").alias("right"))


def wind_rose(df: DataFrame, direction: str = "dir_deg", speed: str = "speed") -> DataFrame:
    """16 sectors of 22.5 degrees (N centred) x speed classes; count and share of all counted rows."""
    sector = (F.floor((F.col(direction) + 11.25) / 22.5) % 16).cast("int")
    s = F.col(speed)
    klass = (F.when(s < 2, F.lit("0-2")).when(s < 4, F.lit("2-4")).when(s < 6, F.lit("4-6"))
             .otherwise(F.lit("6+")))
    counts = df.select(sector.alias("sector"), klass.alias("speed_class")).groupBy("sector", "speed_class") \
        .agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # 64 rows at most
    return counts.withColumn("share", F.col("n") / total)


def diurnal_composite(df: DataFrame, variables: list[str], block_hours: int = 4, variable: str = "variable_code",
                      ts: str = "observed_at", value: str = "value") -> DataFrame:
    """Mean per block of hours (0, 4, 8, ...) with one column per variable."""
    block = (F.floor(F.hour(ts) / block_hours) * block_hours).cast("int").alias("block")
    return df.groupBy(block).agg(*[F.avg(F.when(F.col(variable) == v, F.col(value))).alias(v) for v in variables])


EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def _unit_vector_cells(df: DataFrame, lat: str, lon: str, cell: float) -> DataFrame:
    p, l_ = F.radians(F.col(lat)), F.radians(F.col(lon))
    x, y, z = F.cos(p) * F.cos(l_), F.cos(p) * F.sin(l_), F.sin(p)
    return df.withColumn("cx", F.floor(x / cell)).withColumn("cy", F.floor(y / cell)).withColumn(
        "cz", F.floor(z / cell))


def radius_pairs(points: DataFrame, radius_km: float, key: str = "station_id", lat: str = "latitude",
                 lon: str = "longitude") -> DataFrame:
    """Pairs (a < b) within radius_km (haversine), found by an equi-join on 3-D grid cells.

    Two points at great-circle distance d are at chord distance <= d / R on the unit sphere, so with cells of
    size r / R every pair within r lies in the same or a neighbouring cell (27 candidates). Each point meets
    only the points of its neighbourhood; the exact distance filters the candidates.
    """
    cell = radius_km / EARTH_RADIUS_KM
    base = _unit_vector_cells(points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
                              .select(key, lat, lon), lat, lon, cell)
    offs = F.sequence(F.lit(-1), F.lit(1))
    a = (base.select(F.col(key).alias("a"), F.col(lat).alias("lat_a"), F.col(lon).alias("lon_a"),
                     "cx", "cy", "cz")
         .withColumn("dx", F.explode(offs)).withColumn("dy", F.explode(offs)).withColumn("dz", F.explode(offs))
         .select("a", "lat_a", "lon_a", (F.col("cx") + F.col("dx")).alias("cx"),
                 (F.col("cy") + F.col("dy")).alias("cy"), (F.col("cz") + F.col("dz")).alias("cz")))
    b = base.select(F.col(key).alias("b"), F.col(lat).alias("lat_b"), F.col(lon).alias("lon_b"), "cx", "cy", "cz")
    cand = a.join(b, ["cx", "cy", "cz"]).where(F.col("a") < F.col("b"))
    dist = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return cand.select("a", "b", dist.alias("distance_km")).where(F.col("distance_km") <= radius_km)


def crossed_variables(df: DataFrame, pairs: DataFrame, key: str = "station_id", variable: str = "variable_code",
                      ts: str = "observed_at", value: str = "value") -> DataFrame:
    """For every pair of places (a, b, distance_km) and of variables, the hours in which both measured, the mean of
    each and the mean absolute difference of their hourly means.

    The measurements are reduced to one row a place and hour, with the mean of every variable in it, before the pairs
    meet; the variables of a pair of rows are crossed inside the row and summed where they lie.
    """
    hour = bucket_key(ts, "hour").alias("bucket")
    means = df.groupBy(key, hour, variable).agg(F.avg(value).alias("v"))
    hourly = means.groupBy(key, "bucket").agg(F.collect_list(F.struct(F.col(variable).alias("variable"), "v")).alias("m"))
    a = hourly.select(F.col(key).alias("a"), "bucket", F.col("m").alias("ma"))
    b = hourly.select(F.col(key).alias("b"), "bucket", F.col("m").alias("mb"))
    met = pairs.join(a, "a").join(b, ["b", "bucket"]).select("a", "b", "distance_km", F.explode("ma").alias("x"), "mb")
    met = met.select("a", "b", "distance_km", "x", F.explode("mb").alias("y"))
    return met.groupBy("a", "b", "distance_km", F.col("x.variable").alias("variable_a"), F.col("y.variable").alias("variable_b")).agg(
        F.count("*").alias("n_hours"), F.avg("x.v").alias("mean_a"), F.avg("y.v").alias("mean_b"),
        F.avg(F.abs(F.col("x.v") - F.col("y.v"))).alias("mean_abs_diff"))
