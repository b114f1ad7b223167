"""N11 timestamp parsing: a bounded set of layouts, naive = UTC, offsets converted to UTC.

Layouts (fixed order, R10): year first ``yyyy-MM-dd[( |T)HH:mm[:ss[.ffffff]]]`` (also with ``/``), then
``M/d/yyyy[ H:mm[:ss]]`` month first, then the same day first (used when month first is not a valid date, or
first when ``dayfirst``); ``-`` and ``.`` separate like ``/``. An offset (``Z``, ``+hh:mm``, ``-hhmm``, ``UTC``) may follow a
time. Before that, ``canonical`` rewrites compact dates (``yyyyMMdd``), months alone (``yyyy-MM``), two-digit years (20yy),
month names, hours alone and 12-hour times into these layouts. Anything else is null.

Each layout is recognised with one regular expression, split on its separators and assembled with
``try_make_timestamp_ntz`` (invalid dates become null), so the expression stays small enough for whole-stage
codegen, and the session time zone never enters: the offset is subtracted with NTZ calendar arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIME = r"(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?"
YEAR_FIRST = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})" + _TIME + "$"
YEAR_LAST = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + _TIME + "$"
#: Texts that Spark's cast to TIMESTAMP_NTZ reads as the layouts do (no second 60, no zone), so they are not rewritten.
PLAIN = r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:[0-5]\d(?:\.\d{1,6})?\s*$"
#: Numbers too short for a date of eight digits: no layout takes them.
SHORT_NUMBER = r"^\s*[+-]?\d{0,7}(?:\.\d*)?\s*$"
WITH_OFFSET = r"^(.*\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(Z|z|[+-]\d{2}:?\d{2})$"


def _int(x: Column) -> Column:
    return F.when(x != "", x.cast("int"))


def _build(local: Column, y: int, m: int, d: int) -> Column:
    """Fields by position after splitting a validated layout on its separators (0-based: the three date
    parts in the layout's order, then hour, minute, second, fraction); missing time parts are 0."""
    parts = F.split(local, "[-/T :.]")
    g = lambda i: F.get(parts, i)  # noqa: E731  (null past the end)
    frac = F.coalesce(g(6), F.lit(""))
    seconds = F.concat(F.coalesce(g(5), F.lit("0")), F.lit("."),
                       F.rpad(F.substring(frac, 1, 6), 6, "0")).cast("decimal(16,6)")
    return F.try_make_timestamp_ntz(g(y).cast("int"), g(m).cast("int"), g(d).cast("int"),
                                    F.coalesce(g(3).cast("int"), F.lit(0)), F.coalesce(g(4).cast("int"), F.lit(0)),
                                    seconds)


def _naive(local: Column, dayfirst: bool) -> Column:
    year_first = F.when(local.rlike(YEAR_FIRST), _build(local, 0, 1, 2))
    month_first = _build(local, 2, 0, 1)
    day_first = _build(local, 2, 1, 0)
    year_last = F.when(local.rlike(YEAR_LAST), F.coalesce(day_first, month_first) if dayfirst
                       else F.coalesce(month_first, day_first))
    return F.coalesce(year_first, year_last)


_MONTH = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_HALF = r"(?i)^(.*[T ]\d{1,2}(?::\d{2}){0,2}) *([ap])\.?m\.?$"


def canonical(df: DataFrame, col: Column, out: str) -> DataFrame:
    """Add ``out``: the text rewritten to the layouts above, and ``out`` + "_half": a or p of a 12-hour time."""
    s = F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)(:\d{2}(?:\.\d+)?) *(?:UTC|GMT)$", "$1Z"), r"(?i) *(?:UTC|GMT)$", "")
    df = df.withColumn(out, s)
    month = F.lower(F.regexp_extract(out, _MONTH, 1))
    number = F.lpad((F.expr(f"cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', `{out}_m`) + 2) / 3 AS int)")).cast("string"), 2, "0")
    named = (F.when(F.col(out).rlike("^" + _MONTH + r" \d{1,2},? \d{4}(\D|$)"),
                    F.regexp_replace(out, "^" + _MONTH + r" (\d{1,2}),? (\d{4})", "$3-@-$2"))
             .when(F.col(out).rlike(r"^\d{1,2}[ -]" + _MONTH + r",?[ -]\d{4}(\D|$)"),
                   F.regexp_replace(out, r"^(\d{1,2})[ -]" + _MONTH + r",?[ -](\d{4})", "$3-@-$1")).otherwise(F.col(out)))
    df = df.withColumn(f"{out}_m", month).withColumn(out, named).withColumn(out, F.replace(F.col(out), F.lit("@"), number))
    s = F.regexp_replace(out, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ]\d)", "$1-$2-$3")
    s = F.regexp_replace(s, r"^(\d{4})-(\d{1,2})$", "$1-$2-01")
    s = F.regexp_replace(s, r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{2})(?=$|[T ]\d)", "$1$2$3$220$4")
    df = df.withColumn(f"{out}_half", F.lower(F.regexp_extract(s, _HALF, 2)))
    s = F.when(F.col(f"{out}_half") != "", F.regexp_extract(s, _HALF, 1)).otherwise(s)
    return df.withColumn(out, F.regexp_replace(s, r"^(\d+[-/.]\d+[-/.]\d+)[T ](\d{1,2})$", "$1 $2:00")).drop(f"{out}_m")


def _offset_minutes(off: Column) -> Column:
    digits = F.regexp_replace(off, "[^0-9]", "")
    sign = F.when(off.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    return F.when((off == "") | (F.upper(off) == "Z"), F.lit(0)).otherwise(
        sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")))


def with_parsed_datetime(df: DataFrame, col: Column, out: str, dayfirst: bool = False) -> DataFrame:
    """Add ``out`` = N11 parse of ``col``, one step per projection.

    Each step reads the previous step's column, so no large sub-expression is repeated inside another (the
    optimizer does not collapse projections that would duplicate non-trivial expressions) and the generated
    code stays within the JVM method size limit. Texts in the ``PLAIN`` layout are cast, and only the others pass the
    patterns of the rewriting.
    """
    text = col.cast("string")
    df = df.withColumn("_pd_plain", F.when(text.rlike(PLAIN), F.regexp_replace(text, r"^\s+|\s+$", "").try_cast("timestamp_ntz")))
    staged = (canonical(df, F.when(F.col("_pd_plain").isNull() & ~text.rlike(SHORT_NUMBER), text), "_pd_s")
              .withColumn("_pd_local", F.when(F.col("_pd_s").rlike(WITH_OFFSET),
                                              F.regexp_extract("_pd_s", WITH_OFFSET, 1)).otherwise(F.col("_pd_s")))
              .withColumn("_pd_off", _offset_minutes(F.regexp_extract("_pd_s", WITH_OFFSET, 2)))
              .withColumn("_pd_naive", _naive(F.col("_pd_local"), dayfirst)))
    hour, half = F.hour("_pd_naive"), F.col("_pd_s_half")
    add = F.when(half == "", 0).when(~hour.between(1, 12), None).when(half == "p", F.when(hour < 12, 12).otherwise(0)).otherwise(
        F.when(hour == 12, -12).otherwise(0))
    staged = staged.withColumn("_pd_naive", F.timestamp_add("HOUR", add, F.col("_pd_naive")))
    # ``spark_partition_id() >= 0`` is always true; being non-deterministic it keeps this projection in place,
    # so a later filter on ``out`` (e.g. "is not null") reads the computed column instead of being pushed
    # below with copies of the whole parse inlined into it (which overflows the generated-code size limit).
    barrier = F.spark_partition_id() >= 0
    return (staged.withColumn(out, F.when(barrier, F.coalesce("_pd_plain", _shift(F.col("_pd_naive"), F.col("_pd_off")))))
            .drop("_pd_plain", "_pd_s", "_pd_s_half", "_pd_local", "_pd_off", "_pd_naive"))


def _shift(naive: Column, off_min: Column) -> Column:
    """Local time minus its UTC offset. NTZ calendar arithmetic (``timestampadd``) involves no zone."""
    return F.timestamp_add("MINUTE", -off_min, naive)


def parse_datetime(col: Column, dayfirst: bool = False) -> Column:
    """Column form of the same parse, for a single use in a small projection (tests, ad-hoc); pipelines use
    ``with_parsed_datetime``, which keeps the generated code small."""
    s = F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")
    local = F.when(s.rlike(WITH_OFFSET), F.regexp_extract(s, WITH_OFFSET, 1)).otherwise(s)
    off_min = _offset_minutes(F.regexp_extract(s, WITH_OFFSET, 2))
    return _shift(_naive(local, dayfirst), off_min)
