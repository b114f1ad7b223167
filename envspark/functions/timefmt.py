"""Zone-free time expressions on TIMESTAMP_NTZ columns (bucket keys, weekday, hour truncation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from envspark import vocab

GRANULARITIES = ("hour", "day", "week", "month", "year")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _p2(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def day_string(ts: Column | str) -> Column:
    """'YYYY-MM-DD' of a TIMESTAMP_NTZ (the NTZ -> DATE cast involves no time zone)."""
    return F.to_date(_c(ts)).cast("string")


def bucket_key(ts: Column | str, granularity: str) -> Column:
    """A1 bucket keys: hour 'YYYY-MM-DD HH:00', day 'YYYY-MM-DD', week = its Monday, month 'YYYY-MM', year.

    Built from the NTZ fields (date cast, hour), never through a zoned timestamp, so the session time zone
    cannot move a bucket (e.g. across a daylight-saving gap).
    """
    t = _c(ts)
    if granularity == "hour":
        return F.concat(day_string(t), F.lit(" "), _p2(F.hour(t)), F.lit(":00"))
    if granularity == "day":
        return day_string(t)
    if granularity == "week":
        return week_start(t).cast("string")
    if granularity == "month":
        return F.substring(day_string(t), 1, 7)
    if granularity == "year":
        return F.substring(day_string(t), 1, 4)
    raise ValueError(f"unknown granularity {granularity!r}; expected one of {GRANULARITIES}")


def week_start(ts: Column | str) -> Column:
    """Monday of the week (weeks start on Monday). dayofweek: Sunday=1 .. Saturday=7."""
    d = F.to_date(_c(ts))
    return F.date_sub(d, (F.dayofweek(d) + 5) % 7)


_DAY_US = 86_400_000_000


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of an NTZ value read as UTC, from its fields (date, hour, minute,
    seconds with fraction) — Spark's own NTZ arithmetic passes through the session zone and can shift values
    that fall into a daylight-saving gap there."""
    t = _c(ts)
    return (F.unix_date(F.to_date(t)).cast("long") * F.lit(_DAY_US)
            + F.hour(t).cast("long") * F.lit(3_600_000_000) + F.minute(t).cast("long") * F.lit(60_000_000)
            + (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("long"))


def from_epoch_micros(micros: Column) -> Column:
    """TIMESTAMP_NTZ from microseconds since the epoch, built from fields (inverse of ``epoch_micros``)."""
    rem = F.pmod(micros, F.lit(_DAY_US))
    day = F.date_from_unix_date(((micros - rem) / F.lit(_DAY_US)).cast("int"))
    hour = (rem / F.lit(3_600_000_000)).cast("int")
    minute = (F.pmod(rem, F.lit(3_600_000_000)) / F.lit(60_000_000)).cast("int")
    sec = F.pmod(rem, F.lit(60_000_000)).cast("decimal(16,0)") / F.lit(1_000_000)
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hour, minute,
                                sec.cast("decimal(16,6)"))


def ntz_as_utc_instant(ts: Column | str) -> Column:
    """The instant an NTZ value denotes when read as UTC (a TIMESTAMP, e.g. for watermarks / windows)."""
    return F.timestamp_micros(epoch_micros(ts))


def instant_as_utc_ntz(ts: Column | str) -> Column:
    """UTC wall-clock NTZ of an instant (inverse of ``ntz_as_utc_instant``)."""
    return from_epoch_micros(F.unix_micros(_c(ts)))


def truncate_hour(ts: Column | str) -> Column:
    """Hour truncation that stays TIMESTAMP_NTZ and zone-free."""
    t = _c(ts)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))


def iso_datetime(ts: Column | str, with_fraction: bool) -> Column:
    """'YYYY-MM-DDTHH:MM:SS' (+ '.ffffff') of an NTZ value, from its fields."""
    t = _c(ts)
    base = F.concat(day_string(t), F.lit("T"), _p2(F.hour(t)), F.lit(":"), _p2(F.minute(t)), F.lit(":"),
                    _p2(F.second(t)))
    if not with_fraction:
        return base
    return F.concat(base, F.lit("."), F.lpad(micro_of_second(t).cast("string"), 6, "0"))


def micro_of_second(ts: Column | str) -> Column:
    return F.pmod((F.date_part(F.lit("SECOND"), _c(ts)) * F.lit(1_000_000)).cast("long"), F.lit(1_000_000))


def weekday_name(ts: Column | str) -> Column:
    names = F.array(*[F.lit(n) for n in vocab.WEEKDAY_NAMES])
    return names[F.dayofweek(_c(ts)) - 1]


def weekday_index(ts: Column | str) -> Column:
    """Sunday=0 .. Saturday=6."""
    return F.dayofweek(_c(ts)) - 1


def hour_of_day_fraction(ts: Column | str) -> Column:
    """Hour plus minutes/60, rounded half-up to 2 decimals."""
    t = _c(ts)
    x = F.hour(t) + F.minute(t) / F.lit(60.0)
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)
