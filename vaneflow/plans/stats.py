"""Statistics of trades and forecasts, each a single grouped aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def t_value(pnl: Column) -> Column:
    """mean / (sd / sqrt n), zero when the deviation is zero or undefined."""
    sd, n = F.stddev_samp(pnl), F.count(pnl)
    return F.when(sd > 0, F.avg(pnl) / (sd / F.sqrt(n))).otherwise(F.lit(0.0))


def trade_stats(trades: DataFrame, by: Sequence[str], pnl: str = "pnl") -> DataFrame:
    p = F.col(pnl)
    return trades.groupBy(*by).agg(*stat_columns(p))


def stat_columns(p: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(p > 0).alias("wins"), F.count_if(p <= 0).alias("losses"),
        F.avg((p > 0).cast("double")).alias("hit"), F.avg(p).alias("per_trade"), F.sum(p).alias("total"),
        t_value(p).alias("t"),
    ]


def rollup_report(trades: DataFrame, dims: Sequence[str], pnl: str = "pnl") -> DataFrame:
    """The same statistics for everything and for each dimension on its own."""
    sets = [[], *[[d] for d in dims]]
    cols = [F.col(d) for d in dims]
    grouped = trades.groupingSets([[F.col(d) for d in s] for s in sets], *cols)
    return grouped.agg(*stat_columns(F.col(pnl)), F.grouping_id(*cols).alias("grouping_level"))


def daily_risk(trades: DataFrame, day: str, pnl: str, capital: str, by: Sequence[str] = ()) -> DataFrame:
    """Daily sums, then positive days, Sharpe, its annual form and return on capital."""
    daily = trades.groupBy(*by, day).agg(F.sum(pnl).alias("_p"), F.sum(capital).alias("_c"))
    sd = F.stddev_samp("_p")
    sharpe = F.when(sd > 0, F.avg("_p") / sd).otherwise(F.lit(0.0))
    return daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("_p") > 0).alias("positive_days"), sharpe.alias("daily_sharpe"),
        (sharpe * F.sqrt(F.lit(252.0))).alias("annual_sharpe"), F.try_divide(F.sum("_p"), F.sum("_c")).alias("return_on_capital"),
    )


def unpivot_models(df: DataFrame, ids: Sequence[str], models: dict[str, str], name: str = "model", value: str = "pred") -> DataFrame:
    return df.select(*ids, F.inline(F.array(*[
        F.struct(F.lit(n).alias(name), F.col(c).cast("double").alias(value)) for n, c in models.items()
    ])))


def error_metrics(long: DataFrame, by: Sequence[str], pred: str, actual: str) -> DataFrame:
    """MAE, RMSE, bias, population deviation, shares within 1/2/3/5 and the largest error."""
    e = F.col(pred) - F.col(actual)
    rows = long.filter(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.stddev_pop(e).alias("sd"), *[F.avg((F.abs(e) <= k).cast("double")).alias(f"within_{k}") for k in (1, 2, 3, 5)],
        F.max(F.abs(e)).alias("max_error"),
    )


def equal_width_bin(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Right-closed bins of equal width over the observed range; the minimum falls in the first."""
    lo, hi = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    position = F.ceil(F.try_divide(F.col(value) - lo, hi - lo) * bins)
    return df.withColumn(out, F.greatest(F.lit(1), position).cast("long"))
