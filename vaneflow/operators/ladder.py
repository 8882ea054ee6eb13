"""Ladders (mutually exclusive buckets of one outcome) and order books."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import fee_per_share
from .ordered import running


def favorite(ladder: DataFrame, group: Sequence[str], index: str, price: str, *cols: str) -> DataFrame:
    """Highest-priced bucket of each ladder; the lowest index wins a tie."""
    row = F.struct(index, price, *cols)
    picked = ladder.filter(F.col(price).isNotNull()).groupBy(*group).agg(
        F.max_by(row, F.struct(F.col(price), -F.col(index))).alias("_r")
    )
    return picked.select(*group, "_r.*")


def nearest_bucket(ladder: DataFrame, group: Sequence[str], index: str, center: str, target: str, *cols: str) -> DataFrame:
    """Bucket whose centre is closest to the forecast; the lowest index wins a tie."""
    row = F.struct(index, center, target, *cols)
    distance = F.struct(F.abs(F.col(center) - F.col(target)), F.col(index))
    picked = ladder.filter(F.col(target).isNotNull()).groupBy(*group).agg(F.min_by(row, distance).alias("_r"))
    return picked.select(*group, "_r.*")


def ladder_sums(quotes: DataFrame, group: Sequence[str], bucket: str, bid: str, ask: str, min_buckets: int) -> DataFrame:
    """Sum of bids and asks and the overround per ladder snapshot, complete ladders only."""
    return (
        quotes.groupBy(*group)
        .agg(F.count_distinct(bucket).alias("n_buckets"), F.sum(bid).alias("sum_bid"), F.sum(ask).alias("sum_ask"))
        .filter(F.col("n_buckets") >= min_buckets)
        .withColumn("overround", F.col("sum_bid") - 1)
    )


def ladder_shape(ladder: DataFrame, group: Sequence[str], price: str, visible: float = 0.10) -> DataFrame:
    """Entropy (bits), concentration, count of visible buckets, and peak over second distinct price.

    Entropy of normalised prices follows from two sums, log2(S) - sum(x log2 x)/S, so the ladder is
    never held together; the runner-up price needs one more pass over distinct prices."""
    x = F.col(price)
    xlogx = F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    sums = ladder.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("_s"), F.sum(xlogx).alias("_xl"), F.sum(x * x).alias("_x2"),
        F.max(x).alias("_peak"), F.count_if(x >= visible).alias("n_visible"),
    )
    # The rank filter is applied before the shuffle too, so a ladder sends two rows per task at most.
    by_price = Window.partitionBy(*group).orderBy(F.desc(price))
    top_two = (
        ladder.select(*group, price).distinct().withColumn("_rk", F.row_number().over(by_price)).filter("_rk <= 2")
        .filter("_rk = 2").select(*group, F.col(price).alias("_second"))
    )
    joined = sums.join(top_two, list(group), "left")
    return joined.select(
        *group, "n", (F.log2("_s") - F.try_divide("_xl", "_s")).alias("entropy"),
        F.try_divide(F.col("_x2"), F.col("_s") * F.col("_s")).alias("concentration"), "n_visible",
        F.try_divide("_peak", "_second").alias("peak_ratio"),
    )


def fresh_sums(quotes: DataFrame, group: Sequence[str], price: str, age_seconds: str, limits: Sequence[int]) -> DataFrame:
    """Ladder sum over the quotes younger than each limit, one row per limit."""
    young = F.col(age_seconds) <= F.col("max_age")
    return (
        quotes.withColumn("max_age", F.explode(F.array(*[F.lit(n) for n in limits])))
        .groupBy(*group, "max_age")
        .agg(F.count_if(young).alias("n_fresh"), F.sum(F.when(young, F.col(price))).alias("fresh_sum"))
    )


def book_walk(
    levels: DataFrame, book: Sequence[str], price: str, size: str, targets: Sequence[float], side: str = "bid",
    fee_price: Column | None = None,
) -> DataFrame:
    """Average fill, filled size and fee when taking each target size from the best level on.

    Cumulative size along the price decides what every level contributes; deep books are cut into
    ranges of levels."""
    book = list(book)
    signed = levels.withColumn("_walk", -F.col(price) if side == "bid" else F.col(price))
    placed = running(signed, book, ["_walk"], exclusive=True, _before=("sum", F.col(size)))
    before = F.coalesce(F.col("_before"), F.lit(0.0))
    take = F.greatest(F.lit(0.0), F.least(F.col(size), F.col("target") - before))
    fee = fee_per_share(F.col(price) if fee_price is None else fee_price)
    walked = placed.withColumn("target", F.explode(F.array(*[F.lit(float(x)) for x in targets]))).withColumn("_take", take)
    return (
        walked.groupBy(*book, "target")
        .agg(
            F.sum("_take").alias("filled"), F.sum(F.col("_take") * F.col(price)).alias("_notional"),
            F.sum(F.col("_take") * fee).alias("fee"),
        )
        .withColumn("avg_price", F.coalesce(F.try_divide("_notional", "filled"), F.lit(0.0)))
        .drop("_notional")
    )


def ladder_gate(table: DataFrame, group: Sequence[str], price: str, forecast: str, won: str, min_buckets: int = 9) -> DataFrame:
    """Rows of ladders that have every price and the forecast, enough buckets and exactly one winner."""
    good = (
        table.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("_n"), F.count(price).alias("_np"), F.count(forecast).alias("_nf"),
            F.sum(won).alias("_w"), F.min(won).alias("_w0"),
        )
        .filter((F.col("_np") == F.col("_n")) & (F.col("_nf") == F.col("_n")) & (F.col("_n") >= min_buckets)
                & (F.col("_w") == 1) & (F.col("_w0") >= 0))
        .select(*group)
    )
    return table.join(good, list(group), "left_semi")

