"""Local calendar days, peak windows and lead times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK_START_HOUR = 12
PEAK_END_HOUR = 22


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_time(ts: Column | str, tz: Column | str) -> Column:
    return F.from_utc_timestamp(_c(ts), _c(tz))


def local_date(ts: Column | str, tz: Column | str) -> Column:
    return F.to_date(local_time(ts, tz))


def local_midnight(day: Column | str, tz: Column | str) -> Column:
    """UTC instant of local midnight."""
    return F.to_utc_timestamp(_c(day).cast("timestamp"), _c(tz))


def plus_hours(ts: Column | str, hours: Column | float) -> Column:
    """Elapsed hours, unaffected by clock changes."""
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return F.timestamp_micros(F.unix_micros(_c(ts)) + (h * 3_600_000_000).cast("long"))


def peak_window(day: Column | str, tz: Column | str) -> tuple[Column, Column]:
    """UTC ends of the afternoon: local midnight plus 12 and 22 elapsed hours, both included."""
    midnight = local_midnight(day, tz)
    return plus_hours(midnight, PEAK_START_HOUR), plus_hours(midnight, PEAK_END_HOUR)


def lead_hours(run: Column | str, valid: Column | str) -> Column:
    """Hour boundaries crossed from run to valid time."""
    hour = 3_600_000_000
    return (F.floor(F.unix_micros(_c(valid)) / hour) - F.floor(F.unix_micros(_c(run)) / hour)).cast("long")


def fold_label(day: Column | str, in_sample: tuple[str, str], out_of_sample: tuple[str, str]) -> Column:
    day = _c(day)
    return (
        F.when(day.between(*[F.lit(d).cast("date") for d in in_sample]), "IS")
        .when(day.between(*[F.lit(d).cast("date") for d in out_of_sample]), "OOS")
        .otherwise("OOB")
    )
