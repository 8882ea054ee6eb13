"""Dense bars: a regular time spine with values carried forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def bucket_start(ts: str, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def bar_last(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], value: str, seconds: int) -> DataFrame:
    """Last value of every time bucket."""
    return df.groupBy(*keys, bucket_start(ts, seconds).alias("bar")).agg(
        F.max_by(value, F.struct(ts, *tie)).alias(value), F.count(F.lit(1)).alias("n")
    )


def spine(df: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Every bucket from floor(first) to ceil(last) of each key.

    Grown in two steps, chunks then buckets, so that no single array spans the whole history."""
    chunk = max(seconds * 1000, 1)
    lo = F.floor(F.unix_micros(F.min(ts)) / (seconds * 1_000_000)) * seconds
    hi = F.ceil(F.unix_micros(F.max(ts)) / (seconds * 1_000_000)) * seconds
    ends = df.groupBy(*keys).agg(lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi"))
    chunks = ends.withColumn("_c", F.explode(F.sequence("_lo", "_hi", F.lit(chunk).cast("long"))))
    last = F.least(F.col("_hi"), F.col("_c") + (chunk - seconds))
    return chunks.withColumn("_b", F.explode(F.sequence("_c", last, F.lit(seconds).cast("long")))).select(
        *keys, F.timestamp_seconds("_b").alias("bar")
    )


def resample_ffill(
    fills: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], side: str, sides: dict[str, str], price: str,
    size: str, seconds: int,
) -> DataFrame:
    """Dense bars per key: last price of each side carried forward, with cumulative counts, size and value.

    `sides` maps the values of the side column to output prefixes."""
    tagged = fills.filter(F.col(side).isin(*sides)).withColumn("_usd", F.col(price) * F.col(size))
    per_side = []
    for value, name in sides.items():
        mine = F.col(side) == value
        per_side += [
            F.max_by(F.when(mine, F.col(price)), F.when(mine, F.struct(ts, *tie))).alias(f"_{name}_price"),
            F.count_if(mine).alias(f"_{name}_n"),
            F.sum(F.when(mine, F.col(size))).alias(f"_{name}_size"),
        ]
    bars = tagged.groupBy(*keys, bucket_start(ts, seconds).alias("bar")).agg(*per_side, F.sum("_usd").alias("_usd"))
    dense = spine(tagged, keys, ts, seconds).join(bars, [*keys, "bar"], "left")
    specs = {"usd_cum": ("sum", F.col("_usd"))}
    for name in sides.values():
        specs[f"{name}_price"] = ("last", F.col(f"_{name}_price"))
        specs[f"{name}_count"] = ("sum", F.col(f"_{name}_n"))
        specs[f"{name}_size_cum"] = ("sum", F.col(f"_{name}_size"))
    filled = running(dense, keys, ["bar"], **specs)
    zero = [c for c in specs if not c.endswith("_price")]
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero}).select(*keys, "bar", *specs)
