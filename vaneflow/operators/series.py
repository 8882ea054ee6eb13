"""Time-series operators: sessions, streaks, crossings, bursts, equity curves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .asof import window_lookup
from .ordered import RANGE, cut, neighbours, previous, running


def gap_seconds(later: str, earlier: str) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000


def session_ids(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], max_gap_seconds: float):
    """Add `session`, a number that grows by one after every gap longer than the limit."""
    order = [ts, *tie]
    marked = previous(cut(df, keys, order), keys, order, F.col(RANGE), _before=F.col(ts))
    starts = F.col("_before").isNull() | (gap_seconds(ts, "_before") > max_gap_seconds)
    return running(
        marked.withColumn("_start", starts.cast("long")), keys, order, F.col(RANGE), session=("sum", F.col("_start"))
    ).drop("_before", "_start", RANGE)


def sessionize(df, keys, ts, tie, max_gap_seconds, *aggs: Column) -> DataFrame:
    numbered = session_ids(df, keys, ts, tie, max_gap_seconds)
    return numbered.groupBy(*keys, "session").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n"), *aggs
    )


def longest_streak(df, keys, ts, tie, flag: Column, out: str) -> DataFrame:
    """Longest run of consecutive rows where `flag` holds: rows between two breaks share the break count."""
    counted = running(
        df.withColumn("_f", flag), keys, [ts, *tie], _breaks=("sum", F.when(F.col("_f"), 0).otherwise(1))
    )
    runs = counted.groupBy(*keys, "_breaks").agg(F.count_if("_f").alias("_len"))
    return runs.groupBy(*keys).agg(F.max("_len").alias(out))


def sustained(df, keys, order, flag: Column, k: int, out: str = "sustained") -> DataFrame:
    """True where the flag held in each of the last k rows."""
    marked = df.withColumn("_f", F.when(flag, 1).otherwise(0))
    held = neighbours(marked, keys, order, None, {out: lambda win: F.sum("_f").over(win(-(k - 1), 0)) == k}, before=k - 1)
    return held.drop("_f")


def equity_curve(df, keys, ts, tie, ret: Column, fraction: float) -> DataFrame:
    """Compounded fixed-fraction equity with running peak and drawdown (needs fraction*ret > -1)."""
    order = [ts, *tie]
    grown = running(cut(df, keys, order), keys, order, F.col(RANGE), _log=("sum", F.log1p(F.lit(fraction) * ret)))
    grown = grown.withColumn("equity", F.exp("_log"))
    peaked = running(grown, keys, order, F.col(RANGE), peak=("max", F.col("equity")))
    return peaked.withColumn("drawdown", F.lit(1.0) - F.col("equity") / F.greatest(F.col("peak"), F.lit(1.0))).drop("_log", RANGE)


def tick_changes(df, keys, ts, tie, value, max_gap_seconds: float) -> DataFrame:
    """Rows whose value moved since the previous row, if that row is recent enough."""
    paired = previous(df, keys, [ts, *tie], prev_value=F.col(value), prev_ts=F.col(ts))
    near = gap_seconds(ts, "prev_ts") <= max_gap_seconds
    return paired.filter(near & (F.col(value) != F.col("prev_value"))).withColumn("move", F.col(value) - F.col("prev_value"))


def bursts(df, keys, row_id: str, ts: str, window_seconds: float, min_legs: int, *aggs: Column) -> DataFrame:
    """Clusters of at least `min_legs` rows within the window, merged while members are that close.

    A row opens a burst when the window that starts at it holds enough rows; every row of that window
    is a member.  Members separated by more than the window form separate clusters."""
    df = df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))  # rows without a key are in no burst
    ahead = window_lookup(df, df, keys, row_id, ts, ts, 0, window_seconds, _ahead=("count", F.lit(1)))
    flagged = df.select(*keys, row_id, ts).join(ahead, row_id).withColumn("_open", F.when(F.col("_ahead") >= min_legs, 1))
    # Staged, as cells are counted before they are filled; a member has an opening row behind it, so counts do.
    flagged = stage(flagged, "flagged")
    behind = window_lookup(df, flagged, keys, row_id, ts, ts, -window_seconds, 0, _opened=("count", F.col("_open")))
    members = stage(df.join(behind.filter("_opened > 0").select(row_id), row_id, "left_semi"), "members")
    return sessionize(members, keys, ts, [row_id], window_seconds, *aggs)
