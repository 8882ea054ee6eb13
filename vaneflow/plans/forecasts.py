"""Point-in-time forecasts: what was known at the cutoff, never later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import local_date, peak_window
from ..operators.asof import asof_join, asof_many


def run_maxima(
    runs: DataFrame, station: str, runtime: str, valid: str, value: str, tz: str, start_hour=12, end_hour=22,
    extra: dict | None = None,
) -> DataFrame:
    """Largest value of each run inside the afternoon window of each local day.

    The window belongs to the day, not to the probe, so it is folded in before any lookup."""
    from ..functions.calendar import local_midnight, plus_hours

    day = local_date(valid, tz)
    midnight = local_midnight(F.col("local_date"), tz)
    inside = runs.filter(F.col(value).isNotNull()).withColumn("local_date", day).filter(
        F.col(valid).between(plus_hours(midnight, start_hour), plus_hours(midnight, end_hour))
    )
    return inside.groupBy(station, "local_date", runtime).agg(
        F.max(value).alias(value), *[c.alias(n) for n, c in (extra or {}).items()]
    )


def latest_run_max(
    probes: DataFrame, maxima: DataFrame, station: str, cutoff: str, runtime: str, value: str, out: str,
    look_back: str = "24 hours",
) -> DataFrame:
    """For each (station, local_date, cutoff) the maximum of the newest run at or before the cutoff."""
    return asof_join(
        probes, maxima, [station, "local_date"], cutoff, runtime, {out: value}, tolerance=look_back
    )


def gridded_peak(
    probes: DataFrame, grid: DataFrame, station: str, probe_id: str, cutoff: str, init: str, valid: str, value: str,
    tz: str, out: str, min_hours: int = 6, step_minutes: int = 60,
) -> DataFrame:
    """Largest newest-known value over the peak window of each probe's day.

    For every valid time the newest init at or before the cutoff counts; fewer than `min_hours`
    distinct UTC hours of valid time give null.  `grid` has one row per (station, init, valid)."""
    start, end = peak_window("local_date", tz)
    steps = F.sequence(F.unix_seconds(start), F.unix_seconds(end), F.lit(step_minutes * 60))
    wanted = probes.select(probe_id, station, cutoff, F.explode(steps).alias("_vs")).withColumn(
        valid, F.timestamp_seconds("_vs")
    )
    hits = asof_join(wanted, grid, [station, valid], cutoff, init, {"_val": value}, how="inner")
    peak = hits.groupBy(probe_id).agg(
        F.max("_val").alias("_peak"), F.count_distinct(F.hour(valid)).alias("_hours")
    )
    known = peak.select(probe_id, F.when(F.col("_hours") >= min_hours, F.col("_peak")).alias(out))
    return probes.join(known, probe_id, "left")


def hour_probes(days: DataFrame, station: str, tz: str, hours: range) -> DataFrame:
    """One row per (station, local_date, local hour) with the elapsed-hours cutoff in UTC."""
    from ..functions.calendar import local_midnight, plus_hours

    exploded = days.withColumn("hour", F.explode(F.sequence(F.lit(hours.start), F.lit(hours.stop - 1))))
    return exploded.withColumns({
        "cutoff": plus_hours(local_midnight("local_date", tz), F.col("hour")),
        "probe_id": F.concat_ws("|", F.col(station).cast("string"), F.col("local_date").cast("string"), F.col("hour").cast("string")),
    })


def forecast_panel(
    days: DataFrame, first: DataFrame, second: DataFrame, grid: DataFrame, station: str, tz: str, hours: range,
    look_back: str = "24 hours", min_hours: int = 6,
) -> DataFrame:
    """Three as-of forecasts and their spread for every station, day and hour.

    `first` and `second` are run maxima (station, local_date, runtime, value); `grid` holds
    (station, init_time, valid_time, value)."""
    from ..functions.pricing import forecast_spread

    probes = hour_probes(days, station, tz, hours)
    runs = {"first_pred": (first, "runtime", "value", look_back), "second_pred": (second, "runtime", "value", look_back)}
    panel = asof_many(probes, runs, [station, "local_date"], "cutoff")
    panel = gridded_peak(panel, grid, station, "probe_id", "cutoff", "init_time", "valid_time", "value", tz, "grid_pred", min_hours)
    return panel.withColumn("spread", forecast_spread("first_pred", "second_pred", "grid_pred"))
