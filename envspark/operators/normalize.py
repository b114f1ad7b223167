"""Frame-level normalisation (N1, N4-N8, N12, N19): layout detection, long / wide to the staging schema.

Header work (a handful of column names) happens on the driver; all row work is DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark import vocab
from envspark.functions.text import (clean_unit, is_blank_or_nan, normalize_code, normalize_text,
                                     normalize_text_fast, resolve_unit, station_code, to_number,
                                     variable_from_names)
from envspark.functions.timeparse import with_parsed_datetime
from envspark.session import compiled_methods

STAGING_COLUMNS = ["station_code", "observed_at", "variable_code", "value", "unit", "source_sheet",
                   "source_row_number", "source_workbook"]

#: Columns that the readers add to a frame; no header has these names (``files.clean_header``).
HELPERS = ("_file", "_name", "_row", "_mid", "_pid")


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_blank_or_nan_or_null(c: Column) -> Column:
    s = c.cast("string")
    return s.isNull() | (F.trim(s) == "")


def unpivot_wide(df: DataFrame, ids: list[str], value_cols: list[str], name_col: str, value_col: str) -> DataFrame:
    """Wide -> long with Spark's UNPIVOT; null cells are dropped."""
    return df.unpivot(ids, value_cols, name_col, value_col).where(F.col(value_col).isNotNull())


def resolve_roles(columns: list[str]) -> dict[str, str | None]:
    """Header -> role by synonyms in priority order; later duplicate headers win in the map."""
    cmap: dict[str, str] = {}
    for c in columns:
        cmap[normalize_text_fast(str(c))] = c

    def first(cands):
        for cand in cands:
            if cand in cmap:
                return cmap[cand]
        return None

    return {
        "station": first(vocab.STATION_COLUMNS),
        "datetime": first(vocab.DATETIME_COLUMNS),
        "date": first(vocab.DATE_COLUMNS),
        "time": first(vocab.TIME_COLUMNS),
        "variable": first(vocab.VARIABLE_COLUMNS),
        "value": first(vocab.VALUE_COLUMNS),
        "unit": first(vocab.UNIT_COLUMNS),
    }


def guess_datetime_column(df: DataFrame, candidates: list[str], dayfirst: bool = False) -> DataFrame:
    """N4 (with the R1/R2 fix): (_file, column) of each file's timestamp column.

    Over all cells of a file, the best share of values that the reader's own parser takes, of columns that hold anything
    but numbers; ties keep the earlier column; a share below 0.5 gives none. One aggregation per (file, column), so the
    cells of one file never decide for another.
    """
    file = F.col("_file") if "_file" in df.columns else F.lit("").alias("_file")
    cells = df.select(file, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c"), quoted(c).cast("string").alias("v"))
                                                for k, c in enumerate(candidates)])).alias("x")).select("_file", "x.*")
    cells = with_parsed_datetime(cells.where(F.col("v").isNotNull() & (F.trim("v") != "")), F.col("v"), "_ts", dayfirst)
    shares = cells.groupBy("_file", "k", "c").agg(
        (F.count("_ts") / F.count("*")).alias("share"), F.max((to_number(F.col("v")).isNull()).cast("int")).alias("text"))
    return (shares.where((F.col("text") == 1) & (F.col("share") >= 0.5)).groupBy("_file")
            .agg(F.max_by("c", F.struct("share", -F.col("k"))).alias("column")))


def normalize_frame(df: DataFrame, sheet: str | Column, workbook: str | Column, wide_axis: str = "station",
                    dayfirst: bool = False, file_col: str | None = None, datetime: str | None = None,
                    keep_file: bool = False, rejects: bool = False) -> DataFrame:
    """Any header-bearing frame (string cells, ``_row`` = 0-based data row) -> staging rows.

    Long layout when both a variable and a value column exist; otherwise wide: every non-metadata column with
    at least one numeric cell holds values, its header naming the station (or the variable when
    ``wide_axis='variable'``). ``datetime`` names the timestamp column where no header does; ``keep_file``
    adds ``file_col`` as ``source_path``. ``rejects`` keeps the rows (long) or cells (wide) that cannot be staged, with the
    reason in ``reject``: no timestamp, no value (in a wide cell: text that is no number) or no variable; staged rows have null.
    """
    compiled_methods(df.sparkSession)  # parsing a row is a long chain of expressions
    cols = [c for c in df.columns if c not in HELPERS]
    roles = resolve_roles(cols)
    explicit_dt = roles["datetime"] or datetime
    if explicit_dt is None and roles["date"] is None:
        used = {roles["station"], roles["variable"], roles["value"], roles["unit"]}
        candidates = [c for c in cols if c not in used]
        guessed = guess_datetime_column(df, candidates, dayfirst) if candidates else None
        names = sorted(r[0] for r in guessed.select("column").distinct().collect()) if candidates else []  # headers
        if not names:
            return _unstaged(df, sheet, workbook, file_col, keep_file, rejects, cols, "timestamp")
        parts = []
        for name in names:  # files whose timestamps stand in the same column are read together
            own = guessed.where(F.col("column") == name).select("_file")
            rows = df.join(F.broadcast(own), "_file", "left_semi") if "_file" in df.columns else df
            parts.append(normalize_frame(rows, sheet, workbook, wide_axis, dayfirst, file_col, name, keep_file,
                                         rejects))
        if rejects:  # rows of files without any timestamp column
            rest = df.join(F.broadcast(guessed.select("_file")), "_file", "left_anti") if "_file" in df.columns else df.limit(0)
            parts.append(_unstaged(rest, sheet, workbook, file_col, keep_file, rejects, cols, "timestamp"))
        return reduce(DataFrame.unionByName, parts)
    sheet_c = F.lit(sheet) if isinstance(sheet, str) else sheet
    book_c = F.lit(workbook) if isinstance(workbook, str) else workbook

    # Datetime column, else date + ' ' + time, else date
    if explicit_dt is not None:
        ts_text = quoted(explicit_dt)
    elif roles["date"] and roles["time"]:
        ts_text = F.concat_ws(" ", quoted(roles["date"]), quoted(roles["time"]))
    elif roles["date"]:
        ts_text = quoted(roles["date"])
    else:
        ts_text = F.lit(None).cast("string")

    base = with_parsed_datetime(df.where(~all_blank(cols)), ts_text, "_ts", dayfirst)
    ts = F.col("_ts")
    row_no = (F.col("_row") + 2).cast("long")
    meta = {c for c in roles.values() if c is not None} | ({explicit_dt} if explicit_dt else set())

    if roles["variable"] and roles["value"]:
        value = to_number(quoted(roles["value"]))
        var_raw = quoted(roles["variable"]).cast("string")
        out = base.select(
            station_code(quoted(roles["station"]) if roles["station"] else None).alias("station_code"), ts.alias("observed_at"),
            normalize_code(var_raw).alias("variable_code"), value.alias("value"),
            resolve_unit(quoted(roles["unit"]) if roles["unit"] else None, normalize_code(var_raw)).alias("unit"),
            sheet_c.alias("source_sheet"), row_no.alias("source_row_number"), book_c.alias("source_workbook"),
            *([F.col(file_col).alias("source_path")] if keep_file else []),
            # R4 fix: a missing variable drops the row instead of becoming code 'NAN'
            _reason(F.col("_ts"), value, is_blank_or_nan(var_raw)).alias("reject"))
        return out if rejects else out.where(F.col("reject").isNull()).drop("reject")

    candidates = [c for c in cols if c not in meta]
    counts = base.agg(*[F.count(to_number(quoted(c))).alias(f"n{i}") for i, c in enumerate(candidates)]).first() if candidates else []
    value_cols = [c for i, c in enumerate(candidates) if counts[i] > 0]
    if not value_cols:
        return _unstaged(df, sheet, workbook, file_col, keep_file, rejects, cols, "value")

    # A file's first data row is its units row when its datetime cell mentions 'fecha' and 'unidad'
    fcol = F.col(file_col) if file_col else F.lit("")
    units = None
    if explicit_dt is not None:
        marker = normalize_text(F.coalesce(quoted(explicit_dt).cast("string"), F.lit("")))
        is_units = (F.col("_row") == 0) & marker.contains("fecha") & marker.contains("unidad")
        unit_rows, base = base.where(is_units), base.where(~is_units)
        units = unit_rows.select(fcol.alias("_ufile"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("_ucol"), clean_unit(quoted(c)).alias("_unit")) for c in value_cols])).alias("u")) \
            .select("_ufile", "u._ucol", "u._unit").where(F.col("_unit").isNotNull())

    st_raw = quoted(roles["station"]).cast("string") if roles["station"] else F.lit(None).cast("string")
    long = base.select(fcol.alias("_ufile"), sheet_c.alias("_sheet"), book_c.alias("_book"), st_raw.alias("_st"),
                       ts.alias("observed_at"), row_no.alias("source_row_number"),
                       F.explode(F.array(*[F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("text"))
                                           for c in value_cols])).alias("cell"))
    long = long.where(~is_blank_or_nan_or_null(F.col("cell.text")))  # an empty cell holds no measurement, and is not parsed
    long = long.withColumn("value", to_number(F.col("cell.text")))
    long = long.withColumn("reject", _reason(F.col("observed_at"), F.col("value")))
    if not rejects:
        long = long.where(F.col("reject").isNull())
    long = long.withColumn("_ucol", F.col("cell.col"))
    if units is not None:
        # one row per (file, column) at most; small, so the join is broadcast when it fits the threshold
        long = long.join(units, ["_ufile", "_ucol"], "left")
    else:
        long = long.withColumn("_unit", F.lit(None).cast("string"))
    wide_var = variable_from_names(F.col("_sheet"), F.col("_book"))
    given_unit = F.col("_unit")
    if wide_axis == "variable":
        station = station_code(F.col("_st") if roles["station"] else None)
        variable = normalize_code(F.col("cell.col"))
    else:
        station = normalize_code(F.col("cell.col"))
        variable = wide_var
    return long.select(station.alias("station_code"), "observed_at", variable.alias("variable_code"),
                       F.col("value"), resolve_unit(given_unit, variable).alias("unit"),
                       F.col("_sheet").alias("source_sheet"), "source_row_number",
                       F.col("_book").alias("source_workbook"),
                       *([F.col("_ufile").alias("source_path")] if keep_file else []), *(["reject"] if rejects else []))


def _reason(ts: Column, value: Column, no_variable: Column | None = None) -> Column:
    """Why a row or cell cannot be staged; null where it can."""
    out = F.when(ts.isNull(), F.lit("timestamp")).when(value.isNull(), F.lit("value"))
    return out if no_variable is None else out.when(no_variable, F.lit("variable"))


STAGING_TYPES = ("string", "timestamp_ntz", "string", "double", "string", "string", "long", "string")


def _unstaged(df: DataFrame, sheet, workbook, file_col: str | None, keep_file: bool, rejects: bool, cols: list[str],
              reason: str) -> DataFrame:
    """Staging rows of a frame without a timestamp or value column: none, or all its rows as rejects."""
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    known = {"source_sheet": text(sheet), "source_workbook": text(workbook), "source_row_number": F.col("_row") + 2}
    found = df.where(~all_blank(cols)) if rejects else df.limit(0)
    return found.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in zip(STAGING_COLUMNS, STAGING_TYPES)],
                        *([F.col(file_col).alias("source_path")] if keep_file else []),
                        *([F.lit(reason).alias("reject")] if rejects else []))


def all_blank(cols: list[str]) -> Column:
    cond = None
    for c in cols:
        b = is_blank_or_nan_or_null(quoted(c))
        cond = b if cond is None else (cond & b)
    return cond if cond is not None else F.lit(True)


#: What a cell of a declared type looks like, without blanks around it; a timestamp is what the reader's parser takes.
_CELL = {"integer": r"^[+-]?\d+$", "boolean": r"(?i)^(true|false|yes|no|1|0)$", "string": r"(?s)^.*$"}


def validation_report(df: DataFrame, types: dict[str, str], dayfirst: bool = False) -> DataFrame:
    """Per column, cells that are present but do not parse as the declared type (float, integer, boolean, string or
    timestamp)."""
    unknown = set(types.values()) - {"float", "timestamp", *_CELL}
    if unknown:
        raise ValueError(f"unknown cell types: {sorted(unknown)}")
    checks = []
    for i, (c, t) in enumerate(types.items()):
        if t == "timestamp":
            df = with_parsed_datetime(df, quoted(c), f"_parsed_{i}", dayfirst)
    for i, (c, t) in enumerate(types.items()):
        s = quoted(c).cast("string")
        present = s.isNotNull() & (F.trim(s) != "")
        fits = {"float": to_number(s).isNotNull(), "timestamp": F.col(f"_parsed_{i}").isNotNull() if t == "timestamp" else None}.get(
            t, F.trim(s).rlike(_CELL.get(t, "")))
        checks.append(F.struct(F.lit(c).alias("column"), F.lit(f"Expected {t.capitalize()}").alias("error"),
                               (present & ~fits).alias("bad"), s.alias("cell")))
    cells = df.select(F.col("_row"), F.explode(F.array(*checks)).alias("x")).where("x.bad")
    return cells.select((F.col("_row") + 2).alias("row_number"), "x.column", "x.error", "x.cell")
