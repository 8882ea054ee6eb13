"""Daily feature table: what was known, the truth, lags, calendar and fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import fold_label, local_date, local_time
from ..functions.pricing import forecast_spread
from ..operators.ordered import previous


def daily_observations(obs: DataFrame, station: str, ts: str, value: str, tz: str) -> DataFrame:
    """Per (station, local day): maximum, count, and conditional means."""
    hour, v = F.hour(local_time(ts, tz)), F.col(value)
    return obs.groupBy(station, local_date(ts, tz).alias("local_date")).agg(
        F.max(v).alias("actual"), F.count(F.lit(1)).alias("n_obs"), F.avg(F.when(hour.between(11, 13), v)).alias("noon"),
        F.avg(F.when(hour.between(6, 9), v)).alias("morning"))


def feature_matrix(
    days: DataFrame, observed: DataFrame, forecasts: DataFrame, station: str, preds: list[str], in_sample, out_of_sample
) -> DataFrame:
    """Grid of station days left-joined to observations and forecasts, with lags, disagreement and fold."""
    keys = [station, "local_date"]
    base = days.select(*keys).join(observed, keys, "left").join(forecasts.select(*keys, *preds), keys, "left")
    month = (F.year("local_date") * 12 + F.month("local_date")).cast("long")
    lagged = previous(base, [station], ["local_date"], month, yesterday=F.col("actual"),
                      yesterday_error=F.col("actual") - F.col(preds[0]))
    return lagged.withColumns({
        "disagreement": forecast_spread(*preds), "ensemble": sum((F.col(p) for p in preds), F.lit(0.0)) / len(preds),
        "day_of_year": F.dayofyear("local_date"), "month": F.month("local_date"), "fold": fold_label("local_date", in_sample, out_of_sample),
    })
