"""Exact interpolated quantiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import CELL, value_cell


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], method: str = "linear"
) -> DataFrame:
    """Continuous quantiles (linear interpolation, as SQL PERCENTILE_CONT) per key.

    With `method="higher"` the upper neighbour is taken instead of interpolating.

    Counts per distinct value and per value band are taken first; the band counts locate the bands
    that hold the wanted ranks, and only those bands are scanned value by value."""
    keys = list(keys)
    base = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn(CELL, value_cell("_v"))

    per_band = counted.groupBy(*keys, CELL).agg(F.sum("_n").alias("_cn"))
    up_to = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = per_band.withColumns(
        {"_hi": F.sum("_cn").over(up_to), "_total": F.sum("_cn").over(Window.partitionBy(*keys))}
    ).withColumn("_lo", F.col("_hi") - F.col("_cn"))

    wanted = F.array(*[F.struct(F.lit(n).alias("q"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    rank = (F.col("_total") - 1) * F.col("_q.p")
    if method == "higher":
        rank = F.ceil(rank).cast("double")
    ranks = (
        bands.withColumn("_q", F.explode(wanted))
        .withColumn("_h", rank)
        .withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
        .filter((F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi")))
        .select(*keys, CELL, "_lo", F.col("_q.q").alias("_q"), "_h", "_r")
    )
    needed = ranks.select(*keys, CELL, "_lo").distinct()
    inside = Window.partitionBy(*keys, CELL).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = (
        counted.join(needed, [*keys, CELL])
        .withColumn("_to", F.col("_lo") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_n"))
        .drop("_lo")
    )
    hit = located.join(ranks.drop("_lo"), [*keys, CELL]).filter(
        (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to"))
    )
    weight = F.when(F.floor("_h") == F.ceil("_h"), F.lit(1.0)).otherwise(F.lit(1.0) - F.abs(F.col("_h") - F.col("_r")))
    part = hit.withColumn("_part", F.col("_v") * weight)
    return part.groupBy(*keys).agg(*[F.sum(F.when(F.col("_q") == n, F.col("_part"))).alias(n) for n in probs])
