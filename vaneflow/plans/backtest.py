"""Strategy backtests as single plans: picks, entries, prices, fees and parameter grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import complement, trade_pnl
from ..operators.asof import asof_join
from ..operators.ladder import ladder_gate, nearest_bucket
from .stats import stat_columns

Selector = Callable[[DataFrame], DataFrame]


def pick_offset(table: DataFrame, picks: DataFrame, group: str, index: str, offset: int) -> DataFrame:
    """Rows of the ladder that lie `offset` places from each pick."""
    wanted = picks.select(group, (F.col(index) + F.lit(offset)).alias(index))
    return table.join(wanted, [group, index])


def run_selector(table: DataFrame, selector: Selector, group: str, price: str, forecast: str, won: str, min_buckets: int = 9) -> DataFrame:
    """Gate the ladders, let the selector choose rows, and price one share of each."""
    chosen = selector(ladder_gate(table, [group], price, forecast, won, min_buckets))
    return chosen.withColumn("pnl", trade_pnl(price, won))


def first_consensus_hour(panel: DataFrame, keys: Sequence[str], limit: Column | float, floor: Column | int) -> DataFrame:
    """Earliest hour at or after the floor at which all forecasts agree within the limit."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    hit = (F.col("spread") <= limit) & (F.col("hour") >= floor)
    first = panel.filter(hit).groupBy(*keys).agg(F.min(F.struct("hour", "cutoff", "spread")).alias("_f"))
    return first.select(*keys, "_f.*")


def consensus_trades(
    table: DataFrame, panel: DataFrame, prices: DataFrame, *, station: str, bucket: str, center: str, forecast: str, price: str,
    won: str, limit: float = 3.0, offset: int = 1, floor_hour: int = 15, yes_min: float = 0.005, yes_max: float = 0.22,
    max_wait: str = "3 hours", min_buckets: int = 9,
) -> DataFrame:
    """Fade the bucket above the forecast favorite once the forecasts agree.

    Ladders lacking a price or short of buckets are dropped.  The entry is the first agreeing hour, the
    price the first one within `max_wait`, and the trade buys NO at one minus the YES price."""
    keys = [station, "local_date"]
    counted = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(price).alias("_np"))
    full = counted.filter((F.col("_n") >= min_buckets) & (F.col("_n") == F.col("_np"))).select(*keys)
    ladders = table.join(full, keys, "left_semi")
    favorites = nearest_bucket(ladders, keys, bucket, center, forecast).select(*keys, (F.col(bucket) + offset).alias(bucket))
    targets = ladders.join(favorites, [*keys, bucket])
    entries = targets.join(first_consensus_hour(panel, keys, limit, floor_hour), keys)
    priced = asof_join(entries, prices, [station, bucket], "cutoff", "ts", {"yes_price": "p_yes"}, seq=["event_id"],
                       direction="forward", tolerance=max_wait, how="inner")
    taken = priced.filter(F.col("yes_price").between(yes_min, yes_max))
    paid, won_no = complement("yes_price"), F.lit(1) - F.col(won)
    return taken.withColumns({"price_paid": paid, "won_no": won_no, "pnl": trade_pnl(paid, won_no)})


def consensus_grid(
    panel: DataFrame, keys: Sequence[str], floors: Sequence[int], limits: Sequence[float], stable: Sequence[int], caps: Sequence[float],
    hourly: DataFrame, price: str, won: str, by: Sequence[str] = (),
) -> DataFrame:
    """Statistics of every parameter set in one plan.

    Agreement held for k hours is the rolling maximum of the spread, taken once per k; each set then
    only compares numbers.  Entries are reduced to one row per ladder and set before pricing caps apply.
    `hourly` has the price and outcome a trade entered at each (keys, hour) would get."""
    # A ladder day has at most 24 hourly rows.
    per_day = Window.partitionBy(*keys).orderBy("hour")
    held = [
        F.struct(F.lit(k).alias("stable_k"), F.when(
            F.count("spread").over(per_day.rowsBetween(-(k - 1), 0)) == k, F.max("spread").over(per_day.rowsBetween(-(k - 1), 0))).alias("worst"))
        for k in stable
    ]
    rows = panel.select(*keys, "hour", F.array(*held).alias("_h")).select(*keys, "hour", F.inline("_h")).filter("worst IS NOT NULL")
    sets = rows.withColumn("floor", F.explode(F.array(*map(F.lit, floors)))).filter(F.col("hour") - F.col("stable_k") + 1 >= F.col("floor"))
    sets = sets.withColumn("limit", F.explode(F.array(*[F.lit(float(x)) for x in limits]))).filter(F.col("worst") <= F.col("limit"))
    entries = sets.groupBy(*keys, "floor", "limit", "stable_k").agg(F.min("hour").alias("hour"))
    trades = entries.join(hourly, [*keys, "hour"]).filter(F.col(price).isNotNull())
    capped = trades.withColumn("cap", F.explode(F.array(*[F.lit(float(x)) for x in caps]))).filter(F.col(price) <= F.col("cap"))
    scored = capped.withColumn("pnl", trade_pnl(complement(price), F.lit(1) - F.col(won)))
    return scored.groupBy("floor", "limit", "stable_k", "cap", *by).agg(*stat_columns(F.col("pnl")))


def offset_trades(table: DataFrame, favorites: DataFrame, group: str, index: str, offsets: Sequence[int], price: str, won: str) -> DataFrame:
    """Both sides of every offset from the favorite: buy YES and buy NO."""
    fav = favorites.select(group, F.col(index).alias("_fav"))
    rows = table.join(fav, group).withColumn("offset", F.col(index) - F.col("_fav")).filter(F.col("offset").isin(*offsets))
    p, w = F.col(price), F.col(won)
    sides = F.array(
        F.struct(F.lit("YES").alias("side"), trade_pnl(p, w).alias("pnl")),
        F.struct(F.lit("NO").alias("side"), trade_pnl(complement(p), F.lit(1) - w).alias("pnl")))
    return rows.withColumn("_s", F.explode(sides)).select("*", "_s.*").drop("_s", "_fav")


def holdout(trades: DataFrame, by: Sequence[str], fold: str, train: str, test: str, min_n: int = 10) -> DataFrame:
    """Best parameter set by t on the training fold, reported on the test fold."""
    scored = trades.groupBy(*by, fold).agg(*stat_columns(F.col("pnl")))
    best = scored.filter((F.col(fold) == train) & (F.col("n") >= min_n)).agg(
        F.max_by(F.struct(*by), F.struct(F.col("t"), *[F.col(c) for c in by])).alias("_b"), F.max("t").alias("train_t")
    ).select("_b.*", "train_t")
    return scored.filter(F.col(fold) == test).join(F.broadcast(best), list(by))


def rule_trades(context: DataFrame, ladder: DataFrame, group: str, index: str, favorite: str, rules: dict[str, str | Column], cols: Sequence[str]) -> DataFrame:
    """Each rule gives the offset to buy on a ladder, or null to skip it; rules may be SQL text."""
    chosen = F.array(*[
        F.struct(F.lit(name).alias("rule"), (F.expr(r) if isinstance(r, str) else r).cast("int").alias("offset")) for name, r in rules.items()
    ])
    picks = context.select("*", F.inline(chosen)).filter("offset IS NOT NULL").withColumn(index, F.col(favorite) + F.col("offset"))
    return picks.join(ladder.select(group, index, *cols), [group, index])


