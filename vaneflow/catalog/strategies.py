"""Feature, model and strategy queries on the driver tables.

Roles: user_id mod 5 is the station.  Clicks and views are two forecast feeds, errors the gridded
one, purchases the prices of eleven buckets (event_id mod 11), signups the observed truth."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.calendar import local_midnight, plus_hours
from ..operators.asof import asof_join, window_lookup
from ..operators.ladder import favorite, ladder_gate, nearest_bucket
from ..operators.quantiles import exact_quantiles
from ..plans import backtest, models, stats
from ..plans.features import daily_observations, feature_matrix
from ..plans.forecasts import forecast_panel, run_maxima
from ..session import stage, stage_all
from .aggregates import _STATS, SQL_ZONE, ZONES, r6, rounded_stats
from .joins import LADDER, ladder, us
from .registry import query
from .windows import ANCHOR_HOURS, BUCKET_PATH, bucket_path, ev

HOURS = range(12, 24)


def r6z(c, name):
    """Rounded, with the sign of zero dropped."""
    r = F.round(c, 6)
    return F.when(r == 0, 0.0).otherwise(r).alias(name)


class Domain:
    """The roles above as tables."""

    def __init__(self, t):
        zone = F.element_at(F.array(*map(F.lit, ZONES)), (F.col("station") + 1).cast("int"))
        self.e = t.events.select("event_id", "event_type", (F.col("user_id") % 5).alias("station"), "ts", "value").withColumn("tz", zone)
        local = F.to_date(F.from_utc_timestamp("ts", F.col("tz")))
        self.days = self.e.select("station", "tz", local.alias("local_date")).distinct()

    def staged(self, hours=HOURS):
        """Day list, panel and trade table computed once: one row per station day, hour or bucket."""
        self.days = stage(self.days, "days")
        both = stage_all(table=self.table(), panel=self.panel(hours))
        return both["table"], both["panel"]

    def kind(self, name):
        return self.e.filter(F.col("event_type") == name)

    def maxima(self, name):
        lead = F.explode(F.array(*map(F.lit, (6, 18, 30))))
        runs = self.kind(name).select("station", "tz", F.col("ts").alias("runtime"), "value", lead.alias("lead")).withColumn(
            "ftime", plus_hours("runtime", F.col("lead")))
        return run_maxima(runs, "station", "runtime", "ftime", "value", "tz")

    def grid(self):
        init = F.date_trunc("hour", "ts")
        points = self.kind("error").select("station", init.alias("init_time"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("fxx"), "value")
        return points.groupBy("station", "init_time", plus_hours("init_time", F.col("fxx")).alias("valid_time")).agg(F.max("value").alias("value"))

    def panel(self, hours=HOURS):
        return forecast_panel(self.days, self.maxima("click"), self.maxima("view"), self.grid(), "station", "tz", hours)

    def prices(self):
        return self.kind("purchase").select("station", (F.col("event_id") % 11).alias("bucket"), "ts", "event_id",
                                            F.least(F.col("value") / 400, F.lit(1.0)).alias("p_yes"))

    def observed(self):
        return daily_observations(self.kind("signup"), "station", "ts", "value", "tz")

    def table(self):
        """Trade table: every bucket of every station day with its entry price, forecast and outcome."""
        spread = self.days.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long")))).withColumn(
            "entry_at", local_midnight("local_date", "tz"))
        priced = asof_join(spread, self.prices(), ["station", "bucket"], "entry_at", "ts", {"entry_price": "p_yes"}, seq=["event_id"])
        noon = self.days.withColumn("cutoff", plus_hours(local_midnight("local_date", "tz"), 12))
        pred = asof_join(noon, self.maxima("click"), ["station", "local_date"], "cutoff", "runtime", {"pred": "value"}, tolerance="48 hours")
        truth = self.observed().select("station", "local_date", "actual")
        won_bucket = F.least(F.floor(F.col("actual") / 20), F.lit(10))
        return (
            priced.join(pred.select("station", "local_date", "pred"), ["station", "local_date"], "left")
            .join(truth, ["station", "local_date"], "left")
            .withColumns({"center": F.col("bucket") * 20.0 + 10, "won": F.when(F.col("bucket") == won_bucket, 1).otherwise(0)})
        )


_RUNS = "SELECT station, tz, ts AS rt, ts + to_hours(l) AS ft, value AS v FROM e CROSS JOIN (VALUES (6),(18),(30)) x(l)"
DOM = f"""WITH e AS (SELECT event_id, event_type, user_id % 5 AS station, ts, value, {SQL_ZONE} AS tz FROM events),
loc AS (SELECT *, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE tz AS DATE) AS d FROM e),
days AS (SELECT station, d, any_value((CAST(d AS TIMESTAMP) AT TIME ZONE tz) AT TIME ZONE 'UTC') AS mid FROM loc GROUP BY 1,2),
probe AS (SELECT *, h AS hour, mid + to_hours(h) AS t FROM days CROSS JOIN (SELECT unnest(range(12, 24)) AS h) x),
r1 AS ({_RUNS} WHERE event_type='click'), r2 AS ({_RUNS} WHERE event_type='view'),
m1 AS (SELECT days.station, d, mid, rt, max(v) AS v FROM days JOIN r1 ON r1.station=days.station AND ft BETWEEN mid + INTERVAL 12 HOUR AND mid + INTERVAL 22 HOUR GROUP BY 1,2,3,4),
m2 AS (SELECT days.station, d, mid, rt, max(v) AS v FROM days JOIN r2 ON r2.station=days.station AND ft BETWEEN mid + INTERVAL 12 HOUR AND mid + INTERVAL 22 HOUR GROUP BY 1,2,3,4),
g AS (SELECT station, date_trunc('hour', ts) AS init, date_trunc('hour', ts) + to_hours(f) AS valid, max(value) AS v FROM e CROSS JOIN (SELECT unnest(range(0, 12)) AS f) WHERE event_type='error' GROUP BY 1,2,3),
p1 AS (SELECT p.station, p.d, p.hour, arg_max(m.v, m.rt) AS v FROM probe p JOIN m1 m ON m.station=p.station AND m.d=p.d AND m.rt <= p.t AND m.rt >= p.t - INTERVAL 24 HOUR GROUP BY 1,2,3),
p2 AS (SELECT p.station, p.d, p.hour, arg_max(m.v, m.rt) AS v FROM probe p JOIN m2 m ON m.station=p.station AND m.d=p.d AND m.rt <= p.t AND m.rt >= p.t - INTERVAL 24 HOUR GROUP BY 1,2,3),
gk AS (SELECT p.station, p.d, p.hour, g.valid, arg_max(g.v, g.init) AS v FROM probe p JOIN g ON g.station=p.station AND g.init <= p.t AND g.valid BETWEEN p.mid + INTERVAL 12 HOUR AND p.mid + INTERVAL 22 HOUR GROUP BY 1,2,3,4),
p3 AS (SELECT station, d, hour, CASE WHEN count(DISTINCT hour(valid)) >= 6 THEN max(v) END AS v FROM gk GROUP BY 1,2,3),
panel AS (SELECT p.station, p.d, p.hour, p.t, p1.v AS f1, p2.v AS f2, p3.v AS f3,
  CASE WHEN p1.v IS NOT NULL AND p2.v IS NOT NULL AND p3.v IS NOT NULL THEN greatest(p1.v, p2.v, p3.v) - least(p1.v, p2.v, p3.v) END AS spread
  FROM probe p LEFT JOIN p1 ON p1.station=p.station AND p1.d=p.d AND p1.hour=p.hour LEFT JOIN p2 ON p2.station=p.station AND p2.d=p.d AND p2.hour=p.hour LEFT JOIN p3 ON p3.station=p.station AND p3.d=p.d AND p3.hour=p.hour),
px AS (SELECT station, event_id % 11 AS bucket, ts, least(value / 400, 1) AS p FROM e WHERE event_type='purchase'),
truth AS (SELECT station, d, max(value) AS actual, count(*) AS n_obs, avg(value) FILTER (WHERE hour((ts AT TIME ZONE 'UTC') AT TIME ZONE tz) BETWEEN 11 AND 13) AS noon,
  avg(value) FILTER (WHERE hour((ts AT TIME ZONE 'UTC') AT TIME ZONE tz) BETWEEN 6 AND 9) AS morning FROM loc WHERE event_type='signup' GROUP BY 1,2),
pred AS (SELECT days.station, days.d, arg_max(m1.v, m1.rt) AS pred FROM days JOIN m1 ON m1.station=days.station AND m1.d=days.d AND m1.rt <= days.mid + INTERVAL 12 HOUR AND m1.rt >= days.mid - INTERVAL 36 HOUR GROUP BY 1,2),
lad AS (SELECT days.*, b.b AS bucket FROM days CROSS JOIN (SELECT unnest(range(0, 11)) AS b) b),
tab0 AS (SELECT lad.*, px.p AS entry_price FROM lad ASOF LEFT JOIN px ON px.station=lad.station AND px.bucket=lad.bucket AND lad.mid >= px.ts),
tab AS (SELECT t.station, t.d, t.bucket, t.entry_price, pred.pred, truth.actual, t.bucket * 20.0 + 10 AS center, CASE WHEN t.bucket = least(floor(actual / 20), 10) THEN 1 ELSE 0 END AS won
  FROM tab0 t LEFT JOIN pred ON pred.station=t.station AND pred.d=t.d LEFT JOIN truth ON truth.station=t.station AND truth.d=t.d)"""


def dcol(name="local_date"):
    return F.col(name).cast("string").alias("d")


@query("forecast_panel", DOM + """
SELECT station, CAST(d AS VARCHAR) AS d, CAST(hour AS INT) AS hour, f1, f2, f3, round(spread, 6) AS spread FROM panel""")
def _(t):
    return Domain(t).panel().select("station", dcol(), "hour", F.col("first_pred").alias("f1"), F.col("second_pred").alias("f2"),
                                    F.col("grid_pred").alias("f3"), r6("spread", "spread"))


@query("first_trigger", DOM + """
SELECT station, CAST(d AS VARCHAR) AS d, CAST(min(hour) AS INT) AS hour, epoch_us(min(t)) AS at_us FROM panel WHERE spread <= 60 AND hour >= 15 GROUP BY 1,2""")
def _(t):
    out = backtest.first_consensus_hour(Domain(t).panel(), ["station", "local_date"], 60.0, 15)
    return out.select("station", dcol(), "hour", us("cutoff", "at_us"))


@query("trade_table", DOM + """
SELECT station, CAST(d AS VARCHAR) AS d, bucket, round(entry_price, 6) AS entry_price, pred, actual, CAST(center AS DOUBLE) AS center, won FROM tab""")
def _(t):
    return Domain(t).table().select("station", dcol(), "bucket", r6("entry_price", "entry_price"), "pred", "actual", "center", "won")


_CONSENSUS = DOM + """,
ok AS (SELECT station, d FROM tab GROUP BY 1,2 HAVING count(*) >= 9 AND count(entry_price) = count(*)),
fav AS (SELECT station, d, bucket FROM tab JOIN ok USING (station, d) WHERE pred IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station, d ORDER BY abs(center - pred), bucket) = 1),
trig AS (SELECT station, d, min(hour) AS hour, min(t) AS at_ts FROM panel WHERE spread <= 90 AND hour >= 14 GROUP BY 1,2),
ent AS (SELECT tab.*, trig.hour, trig.at_ts FROM fav JOIN tab ON tab.station=fav.station AND tab.d=fav.d AND tab.bucket=fav.bucket+1 JOIN trig ON trig.station=fav.station AND trig.d=fav.d),
prc AS (SELECT ent.*, px.p AS yes, px.ts AS pts FROM ent ASOF JOIN px ON px.station=ent.station AND px.bucket=ent.bucket AND ent.at_ts <= px.ts),
tr AS (SELECT *, 1 - yes AS paid, 1 - won AS won_no FROM prc WHERE pts <= at_ts + INTERVAL 48 HOUR AND yes BETWEEN 0.005 AND 0.5)"""
_RULE = {"limit": 90.0, "floor_hour": 14, "yes_max": 0.5, "max_wait": "48 hours"}
_COLS = {"station": "station", "bucket": "bucket", "center": "center", "forecast": "pred", "price": "entry_price", "won": "won"}


@query("consensus_backtest", _CONSENSUS + """
SELECT station, CAST(d AS VARCHAR) AS d, bucket, CAST(hour AS INT) AS hour, round(yes, 6) AS yes_price, won_no, round(won_no - paid - 0.05 * paid * (1 - paid), 8) AS pnl FROM tr""")
def _(t):
    d = Domain(t)
    table, panel = d.staged()
    out = backtest.consensus_trades(table, panel, d.prices(), **_COLS, **_RULE)
    return out.select("station", dcol(), "bucket", "hour", r6("yes_price", "yes_price"), "won_no", F.round("pnl", 8).alias("pnl"))


_VARIANTS = [("strict", 40.0, 15, 0.3), ("standard", 90.0, 14, 0.5), ("loose", 150.0, 12, 1.0)]


@query("rule_variants", _CONSENSUS.split("trig AS (")[0] + """
v AS (SELECT * FROM (VALUES ('strict', 40, 15, 0.3), ('standard', 90, 14, 0.5), ('loose', 150, 12, 1.0)) v(variant, lim, flo, cap)),
trig AS (SELECT v.variant, v.cap, station, d, min(t) AS at_ts FROM panel JOIN v ON spread <= v.lim AND hour >= v.flo GROUP BY 1,2,3,4),
ent AS (SELECT tab.*, trig.variant, trig.cap, trig.at_ts FROM fav JOIN tab ON tab.station=fav.station AND tab.d=fav.d AND tab.bucket=fav.bucket+1 JOIN trig ON trig.station=fav.station AND trig.d=fav.d),
prc AS (SELECT ent.*, px.p AS yes, px.ts AS pts FROM ent ASOF JOIN px ON px.station=ent.station AND px.bucket=ent.bucket AND ent.at_ts <= px.ts),
tr AS (SELECT *, 1 - won - (1 - yes) - 0.05 * yes * (1 - yes) AS pnl FROM prc WHERE pts <= at_ts + INTERVAL 48 HOUR AND yes <= cap)
SELECT variant, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, round(avg(pnl), 6) AS per_trade, round(sum(pnl), 4) AS total FROM tr GROUP BY 1""")
def _(t):
    d = Domain(t)
    keys = ["station", "local_date"]
    table, panel = d.staged()
    full = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("entry_price").alias("k")).filter("n >= 9 AND n = k").select(*keys)
    fav = nearest_bucket(table.join(full, keys, "left_semi"), keys, "bucket", "center", "pred").select(*keys, (F.col("bucket") + 1).alias("bucket"))
    targets = table.join(fav, [*keys, "bucket"]).select(*keys, "bucket", "won")
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(s).alias("lim"), F.lit(f).alias("flo"), F.lit(c).alias("cap")) for n, s, f, c in _VARIANTS])
    hits = panel.withColumn("_v", F.explode(variants)).select("*", "_v.*").filter("spread <= lim AND hour >= flo")
    trig = hits.groupBy("variant", "cap", *keys).agg(F.min("cutoff").alias("cutoff"))
    priced = asof_join(targets.join(trig, keys), d.prices(), ["station", "bucket"], "cutoff", "ts", {"yes": "p_yes"}, seq=["event_id"],
                       direction="forward", tolerance="48 hours", how="inner").filter("yes <= cap")
    pnl = pricing.trade_pnl(1 - F.col("yes"), 1 - F.col("won"))
    s = stats.trade_stats(priced.withColumn("pnl", pnl), ["variant"])
    return s.select("variant", "n", "wins", r6("per_trade", "per_trade"), F.round("total", 4).alias("total"))


_FLOORS, _LIMITS, _STABLE, _CAPS = (12, 14, 16, 18), (40.0, 80.0, 120.0), (1, 3), (0.2, 0.5, 1.0)


@query("parameter_sweep", _CONSENSUS.split("trig AS (")[0] + """
pick AS (SELECT tab.* FROM fav JOIN tab ON tab.station=fav.station AND tab.d=fav.d AND tab.bucket=fav.bucket+1),
hp0 AS (SELECT panel.station, panel.d, panel.hour, panel.t, pick.bucket, pick.won FROM panel JOIN pick ON pick.station=panel.station AND pick.d=panel.d),
hp AS (SELECT hp0.*, px.p AS yes, px.ts AS pts FROM hp0 ASOF JOIN px ON px.station=hp0.station AND px.bucket=hp0.bucket AND hp0.t <= px.ts),
k AS (SELECT unnest([1, 3]) AS stable_k),
roll AS (SELECT station, d, hour, k.stable_k, CASE k.stable_k WHEN 1 THEN spread ELSE CASE WHEN count(spread) OVER w = 3 THEN max(spread) OVER w END END AS worst FROM panel CROSS JOIN k
 WINDOW w AS (PARTITION BY k.stable_k, station, d ORDER BY hour ROWS 2 PRECEDING)),
s AS (SELECT station, d, f.floor, l.lim, stable_k, min(hour) AS hour FROM roll JOIN (VALUES (12),(14),(16),(18)) f(floor) ON hour - stable_k + 1 >= f.floor JOIN (VALUES (40.0),(80.0),(120.0)) l(lim) ON worst <= l.lim GROUP BY 1,2,3,4,5),
tr AS (SELECT s.floor, s.lim, s.stable_k, c.cap, 1 - won - (1 - yes) - 0.05 * yes * (1 - yes) AS pnl FROM s JOIN hp ON hp.station=s.station AND hp.d=s.d AND hp.hour=s.hour AND hp.pts <= hp.t + INTERVAL 48 HOUR
 JOIN (VALUES (0.2),(0.5),(1.0)) c(cap) ON yes <= c.cap)
SELECT CAST(floor AS INT) AS floor, CAST(lim AS DOUBLE) AS "limit", CAST(stable_k AS INT) AS stable_k, CAST(cap AS DOUBLE) AS cap, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins,
 round(avg(pnl), 6) AS per_trade, round(sum(pnl), 4) AS total FROM tr GROUP BY 1,2,3,4""")
def _(t):
    d = Domain(t)
    keys = ["station", "local_date"]
    table, panel = d.staged()
    full = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("entry_price").alias("k")).filter("n >= 9 AND n = k").select(*keys)
    fav = nearest_bucket(table.join(full, keys, "left_semi"), keys, "bucket", "center", "pred").select(*keys, (F.col("bucket") + 1).alias("bucket"))
    picks = table.join(fav, [*keys, "bucket"]).select(*keys, "bucket", "won")
    # Entry hours need no forecasts, so they come from the day list and not from a second panel.
    hours = d.days.withColumn("hour", F.explode(F.sequence(F.lit(HOURS.start), F.lit(HOURS.stop - 1)))).withColumn(
        "cutoff", plus_hours(local_midnight("local_date", "tz"), F.col("hour")))
    hourly = asof_join(hours.join(picks, keys), d.prices(), ["station", "bucket"], "cutoff", "ts", {"yes": "p_yes"}, seq=["event_id"],
                       direction="forward", tolerance="48 hours", how="inner").select(*keys, "hour", "yes", "won")
    grid = backtest.consensus_grid(panel, keys, _FLOORS, _LIMITS, _STABLE, _CAPS, hourly, "yes", "won")
    return grid.select("floor", "limit", "stable_k", "cap", "n", "wins", r6("per_trade", "per_trade"), F.round("total", 4).alias("total"))


def features(t):
    d = Domain(t)
    fc = d.panel(range(12, 13)).select("station", "local_date", F.col("first_pred").alias("f1"), F.col("second_pred").alias("f2"), F.col("grid_pred").alias("f3"))
    return feature_matrix(d.days, d.observed(), fc, "station", ["f1", "f2", "f3"], ("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-01-31"))


_FEAT = DOM + """,
fm AS (SELECT days.station, days.d, actual, n_obs, noon, morning, p.f1, p.f2, p.f3, p.spread AS disagreement, (f1 + f2 + f3) / 3 AS ensemble,
 lag(actual) OVER w AS yesterday, lag(actual - f1) OVER w AS yesterday_error, CASE WHEN days.d BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' THEN 'IS' WHEN days.d BETWEEN DATE '2024-01-21' AND DATE '2024-01-31' THEN 'OOS' ELSE 'OOB' END AS fold
 FROM days LEFT JOIN truth ON truth.station=days.station AND truth.d=days.d LEFT JOIN (SELECT * FROM panel WHERE hour=12) p ON p.station=days.station AND p.d=days.d WINDOW w AS (PARTITION BY days.station ORDER BY days.d))"""


@query("feature_matrix", _FEAT + """
SELECT station, CAST(d AS VARCHAR) AS d, actual, n_obs, round(noon, 6) AS noon, round(morning, 6) AS morning, f1, f2, f3, round(disagreement, 6) AS disagreement, round(ensemble, 6) AS ensemble,
 yesterday, round(yesterday_error, 6) AS yesterday_error, CAST(dayofyear(d) AS INT) AS day_of_year, CAST(month(d) AS INT) AS month, fold FROM fm""")
def _(t):
    f = features(t)
    return f.select("station", dcol(), "actual", "n_obs", *[r6(c, c) for c in ("noon", "morning")], "f1", "f2", "f3", r6("disagreement", "disagreement"),
                    r6("ensemble", "ensemble"), "yesterday", r6z("yesterday_error", "yesterday_error"), "day_of_year", "month", "fold")


@query("ensemble_mean", """
WITH f AS (SELECT event_id, event_type, value AS a, value * 0.9 + 5 AS b, CASE WHEN event_id % 3 > 0 THEN value * 1.1 END AS c, CASE WHEN event_id % 4 > 0 THEN value / 10 END AS s FROM events)
SELECT event_id, round((a + b + c) / 3, 6) AS ensemble, round(coalesce(s, (SELECT quantile_cont(s, 0.5) FROM f)), 6) AS spread FROM f""")
def _(t):
    v, i = F.col("value"), F.col("event_id")
    f = t.events.select("event_id", v.alias("a"), (v * 0.9 + 5).alias("b"), F.when(i % 3 > 0, v * 1.1).alias("c"), F.when(i % 4 > 0, v / 10).alias("s"))
    median = exact_quantiles(f, [], "s", {"m": 0.5}).scalar()
    return f.select("event_id", r6((F.col("a") + F.col("b") + F.col("c")) / 3, "ensemble"), r6(F.coalesce("s", median), "spread"))


@query("bias_by_group", """
SELECT p_brand, count(*) AS n, round(avg(l_extendedprice / 10000 - p_size / 10), 6) AS bias, CAST(round_even(avg(l_extendedprice / 10000 - p_size / 10) / 2, 0) AS BIGINT) AS shift
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    per_part = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("k"), F.sum("l_extendedprice").alias("s"))
    j = per_part.join(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey")
    bias = F.sum(F.col("s") / 10000 - F.col("k") * F.col("p_size") / 10) / F.sum("k")
    return j.groupBy("p_brand").agg(F.sum("k").alias("n"), r6(bias, "bias"), F.bround(bias / 2, 0).cast("long").alias("shift"))


@query("anomaly_vs_group_mean", """
WITH m AS (SELECT event_type, avg(value) AS m FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT event_id, round(value - m, 6) AS anomaly FROM events JOIN m USING (event_type)""")
def _(t):
    past = F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp"), F.col("value"))
    means = ev(t).groupBy("event_type").agg(F.try_divide(F.sum(past), F.count(past)).alias("mean")).filter("mean is not null")
    return ev(t).join(means, "event_type").select("event_id", r6z(F.col("value") - F.col("mean"), "anomaly"))


_LINE = """WITH s AS (SELECT l_returnflag AS g, l_linestatus = 'F' AS train, l_quantity AS x, l_discount * 100 AS z, l_extendedprice / 1000 AS y FROM lineitem)"""


def regression_rows(t):
    return t.lineitem.select(F.col("l_returnflag").alias("g"), (F.col("l_linestatus") == "F").alias("train"), F.col("l_quantity").alias("x"),
                             (F.col("l_discount") * 100).alias("z"), (F.col("l_extendedprice") / 1000).alias("y"))


@query("regress_linear_ridge", _LINE + """,
w AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM s WHERE train),
m AS (SELECT 'linear' AS model, sxy / sxx AS b, my - sxy / sxx * mx AS a FROM w UNION ALL SELECT 'ridge', sxy / (sxx + 5), my - sxy / (sxx + 5) * mx FROM w)
SELECT model, round(any_value(b), 4) AS slope, round(any_value(a), 4) AS intercept, count(*) AS n_test, round(avg(abs(a + b * x - y)), 4) AS mae, round(sqrt(avg((a + b * x - y) * (a + b * x - y))), 4) AS rmse
FROM m CROSS JOIN s WHERE NOT train GROUP BY 1""")
def _(t):
    rows = regression_rows(t)
    train, test = rows.filter("train"), models.assemble(rows.filter("NOT train"), ["x"])
    fits = {"linear": models.ridge(train, ["x"], "y"), "ridge": models.ridge(train, ["x"], "y", alpha=5.0)}
    out = None
    for name, fit in fits.items():
        err = F.col("pred") - F.col("y")
        part = fit.transform(test).agg(F.count(F.lit(1)).alias("n_test"), F.round(F.avg(F.abs(err)), 4).alias("mae"), F.round(F.sqrt(F.avg(err * err)), 4).alias("rmse")).select(
            F.lit(name).alias("model"), F.round(F.lit(float(fit.coefficients[0])), 4).alias("slope"), F.round(F.lit(float(fit.intercept)), 4).alias("intercept"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("regress_per_group", _LINE + """,
w AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x)*count(*) + 5 AS a, covar_pop(x,z)*count(*) AS b, var_pop(z)*count(*) + 5 AS d, covar_pop(x,y)*count(*) AS p, covar_pop(z,y)*count(*) AS q FROM s WHERE train GROUP BY 1),
f AS (SELECT *, (d*p - b*q) / (a*d - b*b) AS w1, (a*q - b*p) / (a*d - b*b) AS w2 FROM w),
r AS (SELECT f.g, n, w1, w2, my - w1*mx - w2*mz AS c, s.x, s.z, s.y, s.train FROM f JOIN s ON s.g = f.g)
SELECT g, n, round(any_value(w1), 6) AS w_x, round(any_value(w2), 6) AS w_z, round(any_value(c), 6) AS intercept, round(stddev_samp(y - c - w1*x - w2*z) FILTER (WHERE train), 6) AS sigma,
 round(avg(abs(y - c - w1*x - w2*z)) FILTER (WHERE NOT train), 6) AS mae_test FROM r GROUP BY 1,2""")
def _(t):
    rows = regression_rows(t)
    fits = models.ridge_by_group(rows.filter("train"), ["g"], ["x", "z"], "y", 5.0)
    test = rows.filter("NOT train").join(fits, "g")
    mae = test.groupBy("g").agg(r6(F.avg(F.abs(F.col("y") - models.linear_prediction(["x", "z"]))), "mae_test"))
    return fits.join(mae, "g").select("g", "n", r6(F.get("weights", F.lit(0)), "w_x"), r6(F.get("weights", F.lit(1)), "w_z"), r6("intercept", "intercept"), r6("sigma", "sigma"), "mae_test")


@query("regress_gbt")
def _(t):
    rows = regression_rows(t).withColumn("z", F.when(F.col("x") % 7 > 0, F.col("z")))
    fit = models.boosted_regression(rows.filter("train"), ["x", "z"], "y", rounds=5)
    mean = rows.filter("train").agg(F.avg("y")).scalar()
    test = fit.transform(rows.filter("NOT train"))
    err, base = F.col("pred") - F.col("y"), mean - F.col("y")
    gain = [float(v) for v in fit.stages[-1].featureImportances.toArray()]
    return test.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(F.abs(base)).alias("mae_of_mean")).withColumns(
        {"gain_x": F.lit(gain[0]), "gain_z": F.lit(gain[1])})


@query("regress_stump", _LINE + """,
v AS (SELECT g, train, y, floor(x / 5) AS f1, CASE WHEN x % 7 > 0 THEN z END AS z FROM s),
r AS (SELECT g, train, y, f1, coalesce(z, (SELECT quantile_disc(z, 0.5) FROM v WHERE train)) AS f2 FROM v),
c AS (SELECT 'x' AS f, f1 AS a, count(*) AS n, sum(y) AS sy FROM r WHERE train GROUP BY f1 UNION ALL SELECT 'z', f2, count(*), sum(y) FROM r WHERE train GROUP BY f2),
k AS (SELECT f, a, lead(a) OVER (PARTITION BY f ORDER BY a) AS b, sum(n) OVER (PARTITION BY f ORDER BY a) AS nl, sum(sy) OVER (PARTITION BY f ORDER BY a) AS sl, sum(n) OVER (PARTITION BY f) AS nt, sum(sy) OVER (PARTITION BY f) AS st FROM c),
b AS (SELECT f, (a + b) / 2 AS thr, sl / nl AS lo, (st - sl) / (nt - nl) AS hi FROM k WHERE b IS NOT NULL ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC LIMIT 1)
SELECT g, count(*) AS n, any_value(f) AS feature, round(any_value(thr), 4) AS threshold, round(avg(abs(CASE WHEN CASE f WHEN 'x' THEN f1 ELSE f2 END <= thr THEN lo ELSE hi END - y)), 6) AS mae FROM r CROSS JOIN b WHERE NOT train GROUP BY g""")
def _(t):
    # One round of depth one: a single split, over features of few values, so that all midpoints are candidates.
    rows = regression_rows(t).withColumns({"z": F.when(F.col("x") % 7 > 0, F.col("z")), "x": F.floor(F.col("x") / 5).cast("double")})
    fit = models.boosted_regression(rows.filter("train"), ["x", "z"], "y", rounds=1, depth=1)
    split = fit.stages[-1].trees[0]._call_java("rootNode").split()
    test = fit.transform(rows.filter("NOT train"))
    return test.groupBy("g").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("pred") - F.col("y"))), "mae")).withColumns(
        {"feature": F.lit(["x", "z"][split.featureIndex()]), "threshold": F.round(F.lit(float(split.threshold())), 4)})


@query("classify_logistic", """
WITH RECURSIVE d AS (SELECT documents.doc_id, ln(1 + n_chars) AS x, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
w AS (SELECT stddev_samp(x) AS sd FROM d WHERE doc_id % 4 > 0), z AS (SELECT x / sd AS z, y FROM d CROSS JOIN w WHERE doc_id % 4 > 0),
r AS (SELECT 0 AS i, 0::DOUBLE AS a, 0::DOUBLE AS b UNION ALL
 SELECT i + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
  SELECT i, a, b, avg(p - y) AS g0, avg((p - y) * z) + 0.01 * b AS g1, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * z) AS h01, avg(p * (1 - p) * z * z) + 0.01 AS h11
  FROM (SELECT i, a, b, z, y, 1 / (1 + exp(-(a + b * z))) AS p FROM r CROSS JOIN z WHERE i < 30) GROUP BY i, a, b)),
f AS (SELECT a, b / sd AS b FROM r CROSS JOIN w WHERE i = 30)
SELECT y::INT AS label, count(*) AS n, count(*) FILTER (WHERE (a + b * x > 0) = (y = 1)) AS hits, round(avg(1 / (1 + exp(-(a + b * x)))), 2) AS mean_p FROM d CROSS JOIN f WHERE doc_id % 4 = 0 GROUP BY 1""")
def _(t):
    d = t.documents.select("doc_id", F.log(1.0 + F.col("n_chars")).alias("x")).join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").dropna()
    fit = models.logistic_classifier(d.filter("doc_id % 4 > 0"), ["x"], "label")
    scored = fit.transform(models.assemble(d.filter("doc_id % 4 = 0"), ["x"])).withColumn("p", models.class_probability())
    return scored.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") > 0.5) == (F.col("label") == 1)).alias("hits"), F.round(F.avg("p"), 2).alias("mean_p"))


@query("classify_sign")
def _(t):
    d = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n"), F.size(F.split("text", r"\s+")).cast("double").alias("words"),
                           F.size(F.array_distinct(F.split("text", r"\s+"))).cast("double").alias("kinds")).join(
        t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    train = F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0
    # The fits and the scores work on these few numbers, the texts are read once.  Kept while fitting, not written, as the
    # candidate splits of large inputs are sampled partition by partition.
    d = d.persist()
    try:
        fits = models.sign_classifiers(d.filter(train), ["n", "words", "kinds"], "label")
        held = stage(d.filter(~train), "held-out")
    finally:
        d.unpersist()
    scored = models.assemble(held, ["n", "words", "kinds"])
    for name, fit in fits.items():
        scored = fit.transform(scored).withColumn(name, models.class_probability()).drop("rawPrediction", "probability", "prediction")
    scored = stats.unpivot_models(scored, ["label"], {n: n for n in fits}, value="p")
    confidence = pricing.bands(F.abs(F.col("p") - 0.5), [0.1, 0.25], ["low", "medium", "high"])
    return scored.groupBy("model", confidence.alias("confidence")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(((F.col("p") > 0.5).cast("double") == F.col("label")).cast("double")).alias("accuracy"))


# Normal CDF in SQL: 0.5 + density * sum of z^(2k+1) / (2k+1)!!, the logarithms of the double factorials being the constants.
_LOG_DF = [math.lgamma(2 * k + 2) - k * math.log(2) - math.lgamma(k + 1) for k in range(80)]
_Z = "least(6, greatest(-6, ({e} - m) / s))"
_CDF = ("(CASE WHEN isinf({e}) THEN CASE WHEN {e} > 0 THEN 1 ELSE 0 END WHEN {e} = m THEN 0.5 ELSE 0.5 + sign({e} - m) * exp(-0.5 * power(" + _Z + ", 2)) / sqrt(2 * pi()) * list_sum(list_transform("
        + str(_LOG_DF) + ", lambda c, k: exp((2 * k - 1) * ln(abs(" + _Z + ")) - c))) END)")


@query("bucket_prob_normal", f"""
WITH st AS (SELECT o_orderkey, o_totalprice / 50000 AS m, 0.5 + o_custkey % 5 AS s FROM orders),
b AS (SELECT o_orderkey, m, s, k AS idx, CASE WHEN k = 0 THEN '-infinity'::DOUBLE ELSE k - 0.5 END AS lo, CASE WHEN k = 10 THEN 'infinity'::DOUBLE ELSE k + 0.5 END AS hi FROM st CROSS JOIN (SELECT unnest(range(0, 11)) AS k)),
p AS (SELECT *, greatest({_CDF.format(e='hi')} - {_CDF.format(e='lo')}, 0.001) AS mass FROM b)
SELECT o_orderkey, idx, round(mass / sum(mass) OVER (PARTITION BY o_orderkey), 6) AS p FROM p""")
def _(t):
    k = F.col("idx")
    b = t.orders.select("o_orderkey", (F.col("o_totalprice") / 50000).alias("m"), (0.5 + F.col("o_custkey") % 5).alias("s"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("idx")).withColumns({
        "lo": F.when(k == 0, F.lit(float("-inf"))).otherwise(k - 0.5), "hi": F.when(k == 10, F.lit(float("inf"))).otherwise(k + 0.5)})
    out = models.bucket_probabilities(b, ["o_orderkey"], "lo", "hi", F.col("m"), F.col("s"), out="p")
    return out.select("o_orderkey", "idx", r6("p", "p"))


@query("bucket_prob_empirical", """
WITH r AS (SELECT l_returnflag AS g, l_quantity - 25 + l_discount * 10 AS r FROM lineitem),
b AS (SELECT l_returnflag AS g, l_linenumber AS idx, l_linenumber * 4.0 - 8 AS lo, l_linenumber * 4.0 - 4 AS hi, avg(l_quantity) / 10 AS pred FROM lineitem GROUP BY 1,2,3,4)
SELECT b.g, b.idx, round(avg(CASE WHEN pred + r BETWEEN lo - 0.5 AND hi + 0.5 THEN 1.0 ELSE 0.0 END), 6) AS p FROM b JOIN r ON r.g = b.g GROUP BY 1,2""")
def _(t):
    r = t.lineitem.select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") - 25 + F.col("l_discount") * 10).alias("r"))
    n = F.col("l_linenumber")
    b = t.lineitem.groupBy(F.col("l_returnflag").alias("g"), n.alias("idx"), (n * 4.0 - 8).alias("lo"), (n * 4.0 - 4).alias("hi")).agg((F.avg("l_quantity") / 10).alias("pred"))
    out = models.empirical_probabilities(b, r, ["g"], F.col("lo") - 0.5 - F.col("pred"), F.col("hi") + 0.5 - F.col("pred"), "r", out="p")
    return out.select("g", "idx", r6("p", "p"))


_LT = LADDER + """,
g AS (SELECT ladder_id, arg_max(idx, qty * 100 - idx * 0.001) AS win, sum(px) AS s FROM ladder GROUP BY 1),
lt AS (SELECT l.ladder_id, l.idx, round(l.px / g.s, 6) AS p, CASE WHEN l.idx = g.win THEN 1 ELSE 0 END AS won, o_orderpriority AS city, o_orderdate AS day, o_totalprice % 7 + 1 AS pred, o_custkey % 100 AS humidity,
 CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'IS' ELSE 'OOS' END AS fold FROM ladder l JOIN g USING (ladder_id) JOIN orders ON o_orderkey = l.ladder_id),
mf AS (SELECT ladder_id, idx AS fav, p AS fav_p, won AS fav_won FROM lt QUALIFY row_number() OVER (PARTITION BY ladder_id ORDER BY p DESC, idx) = 1),
nf AS (SELECT ladder_id, idx AS fav FROM lt QUALIFY row_number() OVER (PARTITION BY ladder_id ORDER BY abs(idx - pred), idx) = 1),
gate AS (SELECT ladder_id FROM lt GROUP BY 1 HAVING count(*) >= 4 AND sum(won) = 1)"""


def ladder_table(t):
    """Orders as ladders: price share, winner (largest quantity), city, fold and a forecast.

    A ladder has at most one row per line number, which bounds the windows below."""
    w = Window.partitionBy("ladder_id")
    best = F.max(F.struct("qty", -F.col("idx"))).over(w)
    lt = ladder(t).withColumns({"p": F.round(F.col("px") / F.sum("px").over(w), 6), "_b": best}).withColumn(
        "won", F.when(-F.col("_b.col2") == F.col("idx"), 1).otherwise(0))
    o = t.orders.select(
        F.col("o_orderkey").alias("ladder_id"), F.col("o_orderpriority").alias("city"), F.col("o_orderdate").alias("day"),
        (F.col("o_totalprice") % 7 + 1).alias("pred"), (F.col("o_custkey") % 100).alias("humidity"),
        F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp"), "IS").otherwise("OOS").alias("fold"))
    return lt.select("ladder_id", "idx", "p", "won").join(o, "ladder_id")


def market_favorites(lt):
    return favorite(lt, ["ladder_id"], "idx", "p", "won", "city", "day", "humidity", "fold", "pred")


@query("edge_select", _LT + """
SELECT CAST(th AS DOUBLE) AS th, count(*) AS n, sum(won)::BIGINT AS wins, round(sum(won - p - 0.05 * p * (1 - p)), 4) AS total FROM (SELECT *, abs(sin(ladder_id + idx)) AS m FROM lt) CROSS JOIN (VALUES (0.05),(0.1),(0.2)) v(th)
WHERE m > p * 1.5 AND p > 0.01 AND m - p > th GROUP BY 1""")
def _(t):
    m = F.abs(F.sin(F.col("ladder_id") + F.col("idx")))
    rows = ladder_table(t).withColumn("m", m).filter((F.col("m") > F.col("p") * 1.5) & (F.col("p") > 0.01))
    grid = rows.withColumn("th", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.2))))).filter(F.col("m") - F.col("p") > F.col("th"))
    return grid.groupBy("th").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("wins"), F.round(F.sum(pricing.trade_pnl("p", "won")), 4).alias("total"))


@query("model_confidence", _LT + """, m AS (SELECT *, abs(sin(ladder_id + idx)) AS m FROM lt), r AS (SELECT *, row_number() OVER (PARTITION BY ladder_id ORDER BY m DESC, idx) AS rk FROM m)
SELECT r.ladder_id, round(max(m) FILTER (WHERE rk=1), 6) AS top1, round(max(m) FILTER (WHERE rk=1) - coalesce(max(m) FILTER (WHERE rk=2), 0), 6) AS top_gap,
 CAST(abs(max(idx) FILTER (WHERE rk=1) - any_value(mf.fav)) AS INT) AS bucket_gap FROM r JOIN mf USING (ladder_id) GROUP BY 1""")
def _(t):
    rows = ladder_table(t).withColumn("m", F.abs(F.sin(F.col("ladder_id") + F.col("idx"))))
    w = Window.partitionBy("ladder_id").orderBy(F.desc("m"), "idx")
    top = rows.withColumn("rk", F.row_number().over(w)).filter("rk <= 2").groupBy("ladder_id").agg(
        F.max(F.when(F.col("rk") == 1, F.col("m"))).alias("t1"), F.max(F.when(F.col("rk") == 2, F.col("m"))).alias("t2"), F.max(F.when(F.col("rk") == 1, F.col("idx"))).alias("i1"))
    fav = favorite(rows, ["ladder_id"], "idx", "p").select("ladder_id", F.col("idx").alias("fav"))
    return top.join(fav, "ladder_id").select("ladder_id", r6("t1", "top1"), r6(F.col("t1") - F.coalesce("t2", F.lit(0.0)), "top_gap"), F.abs(F.col("i1") - F.col("fav")).alias("bucket_gap"))


@query("ladder_gate", _LT + " SELECT ladder_id, idx, p, won FROM lt WHERE ladder_id IN (SELECT ladder_id FROM gate)")
def _(t):
    return ladder_gate(ladder_table(t), ["ladder_id"], "p", "pred", "won", 4).select("ladder_id", "idx", "p", "won")


@query("favorite_pick", _LT + """
SELECT nf.ladder_id, nf.fav AS forecast_fav, mf.fav AS market_fav, up.p AS plus1_price, CASE WHEN l0.pred BETWEEN 2 AND 5 THEN up.p END AS filtered_price
FROM nf JOIN mf USING (ladder_id) JOIN lt l0 ON l0.ladder_id=nf.ladder_id AND l0.idx=nf.fav LEFT JOIN lt up ON up.ladder_id=nf.ladder_id AND up.idx=nf.fav+1""")
def _(t):
    lt = ladder_table(t).withColumn("center", F.col("idx").cast("double"))
    n = nearest_bucket(lt, ["ladder_id"], "idx", "center", "pred").select("ladder_id", F.col("idx").alias("forecast_fav"), "pred")
    m = favorite(lt, ["ladder_id"], "idx", "p").select("ladder_id", F.col("idx").alias("market_fav"))
    up = lt.select("ladder_id", (F.col("idx") - 1).alias("forecast_fav"), F.col("p").alias("plus1_price"))
    return n.join(m, "ladder_id").join(up, ["ladder_id", "forecast_fav"], "left").select(
        "ladder_id", "forecast_fav", "market_fav", "plus1_price", F.when(F.col("pred").between(2, 5), F.col("plus1_price")).alias("filtered_price"))


@query("strategy_backtest", _LT + f""", t AS (SELECT lt.fold, lt.city, won - p - 0.05 * p * (1 - p) AS pnl FROM lt JOIN nf ON nf.ladder_id=lt.ladder_id AND lt.idx=nf.fav+1 WHERE lt.ladder_id IN (SELECT ladder_id FROM gate))
SELECT fold, city, {_STATS} FROM t GROUP BY 1,2""")
def _(t):
    def above_forecast(lt):
        picks = nearest_bucket(lt.withColumn("center", F.col("idx").cast("double")), ["ladder_id"], "idx", "center", "pred")
        return backtest.pick_offset(lt, picks, "ladder_id", "idx", 1)

    trades = backtest.run_selector(ladder_table(t), above_forecast, "ladder_id", "p", "pred", "won", 4)
    return rounded_stats(stats.trade_stats(trades, ["fold", "city"]), "fold", "city")


@query("cost_sensitivity", _LT + """
SELECT CAST(v.s AS DOUBLE) AS half_spread, CAST(v.f AS DOUBLE) AS fee, count(*) AS n, round(avg((1 - fav_won) / ((1 - fav_p + s) * (1 + f)) - 1), 6) AS mean_ret, round(sum((1 - fav_won) / ((1 - fav_p + s) * (1 + f)) - 1), 4) AS total
FROM mf CROSS JOIN (VALUES (0.0,0.0),(0.01,0.02),(0.03,0.02),(0.05,0.05)) v(s, f) WHERE 1 - fav_p + s > 0.05 GROUP BY 1,2""")
def _(t):
    costs = F.array(*[F.struct(F.lit(s).alias("half_spread"), F.lit(f).alias("fee")) for s, f in ((0.0, 0.0), (0.01, 0.02), (0.03, 0.02), (0.05, 0.05))])
    rows = market_favorites(ladder_table(t)).select("p", "won", F.inline(costs)).filter(1 - F.col("p") + F.col("half_spread") > 0.05)
    ret = (1 - F.col("won")) / ((1 - F.col("p") + F.col("half_spread")) * (1 + F.col("fee"))) - 1
    return rows.groupBy("half_spread", "fee").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(ret), "mean_ret"), F.round(F.sum(ret), 4).alias("total"))


@query("holdout_lock", _LT + """,
tr AS (SELECT lt.fold, lt.idx - mf.fav AS off, s.side, CASE s.side WHEN 'YES' THEN won - p ELSE (1 - won) - (1 - p) END - 0.05 * p * (1 - p) AS pnl FROM lt JOIN mf USING (ladder_id) CROSS JOIN (VALUES ('YES'),('NO')) s(side) WHERE lt.idx - mf.fav BETWEEN -3 AND 3),
sc AS (SELECT off, side, fold, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, avg(pnl) AS per, avg(pnl) / (stddev_samp(pnl) / sqrt(count(*))) AS t FROM tr GROUP BY 1,2,3),
best AS (SELECT off, side, t AS train_t FROM sc WHERE fold='IS' AND n >= 10 ORDER BY t DESC LIMIT 1)
SELECT CAST(off AS INT) AS "offset", side, round(train_t, 4) AS train_t, n, wins, round(per, 6) AS per_trade, round(t, 4) AS t FROM sc JOIN best USING (off, side) WHERE fold='OOS'""")
def _(t):
    lt = ladder_table(t)
    trades = backtest.offset_trades(lt, favorite(lt, ["ladder_id"], "idx", "p"), "ladder_id", "idx", list(range(-3, 4)), "p", "won")
    out = backtest.holdout(trades, ["offset", "side"], "fold", "IS", "OOS")
    return out.select("offset", "side", F.round("train_t", 4).alias("train_t"), "n", "wins", r6("per_trade", "per_trade"), F.round("t", 4).alias("t"))


@query("conditional_rule", _LT + """,
ctx AS (SELECT mf.ladder_id, mf.fav, any_value(humidity) AS humidity, any_value(day) AS day FROM mf JOIN lt USING (ladder_id) GROUP BY 1,2),
r AS (SELECT ladder_id, fav, 'fixed' AS rule, 1 AS off FROM ctx UNION ALL SELECT ladder_id, fav, 'skip dry', CASE WHEN humidity < 40 THEN NULL ELSE 1 END FROM ctx
 UNION ALL SELECT ladder_id, fav, 'weekend low', CASE WHEN dayofweek(day) IN (0, 6) THEN -1 ELSE 2 END FROM ctx)
SELECT rule, count(*) AS n, round(avg(off), 6) AS mean_offset, round(avg(p), 6) AS mean_entry, round(avg(won), 6) AS hit_rate, round(sum(won / (p * 1.02) - 1), 4) AS total_ret
FROM r JOIN lt ON lt.ladder_id=r.ladder_id AND lt.idx=r.fav+r.off WHERE p >= 0.02 AND p * 1.02 < 0.97 GROUP BY 1""")
def _(t):
    lt = ladder_table(t)
    ctx = market_favorites(lt).select("ladder_id", F.col("idx").alias("fav"), "humidity", "day")
    rules = {"fixed": "1", "skip dry": "CASE WHEN humidity < 40 THEN NULL ELSE 1 END", "weekend low": "CASE WHEN dayofweek(day) IN (1, 7) THEN -1 ELSE 2 END"}
    tr = backtest.rule_trades(ctx, lt, "ladder_id", "idx", "fav", rules, ["p", "won"]).filter("p >= 0.02 AND p * 1.02 < 0.97")
    return tr.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("offset"), "mean_offset"), r6(F.avg("p"), "mean_entry"), r6(F.avg("won"), "hit_rate"),
                                  F.round(F.sum(pricing.net_return("won", "p")), 4).alias("total_ret"))


@query("basket_cost", _LT + """,
b AS (SELECT ladder_id, count(*) AS legs, sum(p * 1.02) AS cost, sum(won) AS hits FROM lt WHERE idx BETWEEN pred - 2 AND pred + 2 AND p >= 0.005 GROUP BY 1 HAVING count(*) >= 3)
SELECT legs, count(*) AS n, round(avg(cost), 6) AS mean_cost, round(avg(hits), 6) AS mean_hits, round(avg(hits / cost - 1), 6) AS mean_ret, round(quantile_cont(hits / cost - 1, 0.5), 6) AS median_ret FROM b GROUP BY 1""")
def _(t):
    legs = ladder_table(t).filter(F.col("idx").between(F.col("pred") - 2, F.col("pred") + 2) & (F.col("p") >= 0.005))
    b = legs.groupBy("ladder_id").agg(F.count(F.lit(1)).alias("legs"), F.sum(F.col("p") * 1.02).alias("cost"), F.sum("won").alias("hits")).filter("legs >= 3").withColumn(
        "ret", F.col("hits") / F.col("cost") - 1)
    base = b.groupBy("legs").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cost"), "mean_cost"), r6(F.avg("hits"), "mean_hits"), r6(F.avg("ret"), "mean_ret"))
    return base.join(exact_quantiles(b, ["legs"], "ret", {"median_ret": 0.5}), "legs").withColumn("median_ret", F.round("median_ret", 6))


@query("hedge_pair", _LT + """,
r AS (SELECT *, row_number() OVER (PARTITION BY ladder_id ORDER BY p DESC, idx) AS rk FROM lt),
w AS (SELECT ladder_id, max(p) FILTER (WHERE rk=1) AS p1, max(won) FILTER (WHERE rk=1) AS y1, max(p) FILTER (WHERE rk=2) AS p2, max(won) FILTER (WHERE rk=2) AS y2, max(p) FILTER (WHERE rk=3) AS p3, max(won) FILTER (WHERE rk=3) AS y3 FROM r GROUP BY 1),
c AS (SELECT *, (1 - p1 + 0.03) * 1.02 AS c1, (p2 + 0.03) * 1.02 AS c2, (p3 + 0.03) * 1.02 AS c3 FROM w)
SELECT 'solo' AS variant, count(*) AS n, round(avg((1 - y1) / c1 - 1), 6) AS mean_ret FROM c UNION ALL SELECT 'plus 2nd', count(*), round(avg(((1 - y1) + y2) / (c1 + c2) - 1), 6) FROM c WHERE p2 IS NOT NULL
UNION ALL SELECT 'plus 2nd 3rd', count(*), round(avg(((1 - y1) + y2 + y3) / (c1 + c2 + c3) - 1), 6) FROM c WHERE p3 IS NOT NULL""")
def _(t):
    rk = F.row_number().over(Window.partitionBy("ladder_id").orderBy(F.desc("p"), "idx"))
    r = ladder_table(t).withColumn("rk", rk).filter("rk <= 3")
    at = lambda k, c: F.max(F.when(F.col("rk") == k, F.col(c)))
    w = r.groupBy("ladder_id").agg(*[at(k, c).alias(f"{n}{k}") for k in (1, 2, 3) for c, n in (("p", "p"), ("won", "y"))])
    c1, c2, c3 = (1 - F.col("p1") + 0.03) * 1.02, (F.col("p2") + 0.03) * 1.02, (F.col("p3") + 0.03) * 1.02
    miss = 1 - F.col("y1")
    variants = F.array(
        F.struct(F.lit("solo").alias("variant"), (miss / c1 - 1).alias("ret")), F.struct(F.lit("plus 2nd").alias("variant"), ((miss + F.col("y2")) / (c1 + c2) - 1).alias("ret")),
        F.struct(F.lit("plus 2nd 3rd").alias("variant"), ((miss + F.col("y2") + F.col("y3")) / (c1 + c2 + c3) - 1).alias("ret")))
    return w.select(F.inline(variants)).filter("ret IS NOT NULL").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ret"), "mean_ret"))


@query("portfolio_overlap", _LT + """,
f AS (SELECT mf.ladder_id, fav_p > 0.4 AS a, fav = 2 AS b, any_value(humidity) < 50 AS c FROM mf JOIN lt USING (ladder_id) GROUP BY 1,2,3)
SELECT count(*) AS n, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE c) AS n_c, count(*) FILTER (WHERE a AND b) AS n_ab, count(*) FILTER (WHERE a AND c) AS n_ac,
 count(*) FILTER (WHERE b AND c) AS n_bc, count(*) FILTER (WHERE a AND b AND c) AS n_abc FROM f""")
def _(t):
    f = market_favorites(ladder_table(t)).select((F.col("p") > 0.4).alias("a"), (F.col("idx") == 2).alias("b"), (F.col("humidity") < 50).alias("c"))
    both = {"a": "a", "b": "b", "c": "c", "ab": "a AND b", "ac": "a AND c", "bc": "b AND c", "abc": "a AND b AND c"}
    return f.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(x)).alias(f"n_{n}") for n, x in both.items()])


_FAVPATH = BUCKET_PATH + """,
favs AS (SELECT d, h, bucket AS fav, p AS fav_p FROM path WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d, h ORDER BY p DESC, bucket) = 1)"""


def anchor_favorites(t):
    path = bucket_path(t)
    tall = path.select("d", "bucket", "score", F.inline(F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.col(f"p{h}").alias("p")) for h in ANCHOR_HOURS])))
    return path, favorite(tall, ["d", "h"], "bucket", "p")


@query("favorite_stability", _FAVPATH + """
SELECT CASE WHEN abs(b.fav - a.fav) = 0 THEN 'same' WHEN abs(b.fav - a.fav) <= 3 THEN 'near' ELSE 'far' END AS drift, count(*) AS n, round(avg(b.fav - a.fav), 6) AS mean_drift, round(avg(CASE WHEN b.fav = winner THEN 1.0 ELSE 0.0 END), 6) AS hit
FROM favs a JOIN favs b ON a.d=b.d AND a.h=12 AND b.h=18 JOIN win ON win.d=a.d GROUP BY 1""")
def _(t):
    path, favs = anchor_favorites(t)
    win = path.groupBy("d").agg(F.max_by("bucket", F.struct("score", -F.col("bucket"))).alias("winner"))
    at = lambda h, n: favs.filter(F.col("h") == h).select("d", F.col("bucket").alias(n))
    j = at(12, "a").join(at(18, "b"), "d").join(win, "d").withColumn("mv", F.col("b") - F.col("a"))
    band = F.when(F.col("mv") == 0, "same").when(F.abs("mv") <= 3, "near").otherwise("far")
    return j.groupBy(band.alias("drift")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("mv"), "mean_drift"), r6(F.avg((F.col("b") == F.col("winner")).cast("double")), "hit"))


@query("winner_emergence", _FAVPATH + """
SELECT CAST(h AS BIGINT) AS h, count(*) AS n, round(avg(CASE WHEN fav = winner THEN 1.0 ELSE 0.0 END), 6) AS share FROM favs JOIN win USING (d) GROUP BY 1""")
def _(t):
    path, favs = anchor_favorites(t)
    win = path.groupBy("d").agg(F.max_by("bucket", F.struct("score", -F.col("bucket"))).alias("winner"))
    return favs.join(win, "d").groupBy("h").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("bucket") == F.col("winner")).cast("double")), "share"))


@query("cross_strike_corr", _FAVPATH + """,
dr AS (SELECT d, bucket, max(p) FILTER (WHERE h=18) - max(p) FILTER (WHERE h=12) AS drift FROM path GROUP BY 1,2)
SELECT CAST(o.bucket - f.fav AS BIGINT) AS off, count(*) AS n, round(avg(o.drift), 6) AS mean_drift, round(corr(fd.drift, o.drift), 4) AS r FROM favs f JOIN dr fd ON fd.d=f.d AND fd.bucket=f.fav
JOIN dr o ON o.d=f.d AND o.bucket - f.fav BETWEEN 1 AND 3 WHERE f.h=12 AND fd.drift IS NOT NULL AND o.drift IS NOT NULL GROUP BY 1""")
def _(t):
    path, favs = anchor_favorites(t)
    drift = path.select("d", "bucket", (F.col("p18") - F.col("p12")).alias("drift"))
    base = favs.filter("h = 12").select("d", F.col("bucket").alias("fav"), F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("off"))
    fd = drift.select("d", F.col("bucket").alias("fav"), F.col("drift").alias("fav_drift"))
    j = base.join(fd, ["d", "fav"]).withColumn("bucket", F.col("fav") + F.col("off")).join(drift, ["d", "bucket"]).dropna(subset=["drift", "fav_drift"])
    return j.groupBy("off").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("drift"), "mean_drift"), F.round(F.corr("fav_drift", "drift"), 4).alias("r"))


@query("bias_compare", _FAVPATH + """,
m AS (SELECT f.d, f.fav * 20 + 10 - t.a AS market_bias, fc.v - t.a AS model_bias FROM favs f JOIN (SELECT CAST(ts AS DATE) AS d, avg(value) AS a FROM events GROUP BY 1) t ON t.d=f.d
 JOIN (SELECT CAST(ts AS DATE) AS d, max(value) AS v FROM events WHERE event_type='view' AND hour(ts) < 12 GROUP BY 1) fc ON fc.d=f.d WHERE f.h=12)
SELECT count(*) AS n, round(avg(model_bias), 6) AS model_bias, round(avg(market_bias), 6) AS market_bias, round(corr(model_bias, market_bias), 4) AS r FROM m""")
def _(t):
    _, favs = anchor_favorites(t)
    e = ev(t).withColumn("d", F.to_date("ts"))
    truth = e.groupBy("d").agg(F.avg("value").alias("a"))
    model = e.filter((F.col("event_type") == "view") & (F.hour("ts") < 12)).groupBy("d").agg(F.max("value").alias("v"))
    j = favs.filter("h = 12").join(truth, "d").join(model, "d").select((F.col("bucket") * 20 + 10 - F.col("a")).alias("mk"), (F.col("v") - F.col("a")).alias("md"))
    return j.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("md"), "model_bias"), r6(F.avg("mk"), "market_bias"), F.round(F.corr("md", "mk"), 4).alias("r"))


@query("book_activity_check", """
WITH w AS (SELECT p.event_id, count(f.event_id) AS n, coalesce(sum(f.value), 0) AS usd FROM events p LEFT JOIN events f ON f.event_type=p.event_type AND f.user_id <> -1 AND f.ts BETWEEN p.ts - INTERVAL 30 MINUTE AND p.ts + INTERVAL 30 MINUTE
 WHERE p.event_type='purchase' GROUP BY 1)
SELECT count(*) AS probes, round(avg(n), 6) AS mean_fills, round(avg(usd), 4) AS mean_usd, round(avg(CASE WHEN n < 2 THEN 1.0 ELSE 0.0 END), 6) AS share_thin, round(avg(CASE WHEN usd < 100 THEN 1.0 ELSE 0.0 END), 6) AS share_small FROM w""")
def _(t):
    e = ev(t)
    w = window_lookup(e.filter("event_type = 'purchase'"), e, ["event_type"], "event_id", "ts", "ts", -1800, 1800,
                      n=("count", F.col("value")), usd=("sum", F.col("value"))).withColumn("usd", F.coalesce("usd", F.lit(0.0)))
    return w.agg(F.count(F.lit(1)).alias("probes"), r6(F.avg("n"), "mean_fills"), F.round(F.avg("usd"), 4).alias("mean_usd"),
                 r6(F.avg((F.col("n") < 2).cast("double")), "share_thin"), r6(F.avg((F.col("usd") < 100).cast("double")), "share_small"))


@query("discover_candidates", DOM + """,
ready AS (SELECT station, d, f1, spread FROM panel WHERE hour = 18 AND spread <= 90),
fav AS (SELECT r.station, r.d, b.b AS bucket, r.spread FROM ready r CROSS JOIN (SELECT unnest(range(0, 11)) AS b) b QUALIFY row_number() OVER (PARTITION BY r.station, r.d ORDER BY abs(b.b * 20.0 + 10 - f1), b.b) = 1)
SELECT fav.station, CAST(fav.d AS VARCHAR) AS d, fav.bucket + 1 AS bucket, round(fav.spread, 6) AS spread, tab.entry_price FROM fav JOIN tab ON tab.station=fav.station AND tab.d=fav.d AND tab.bucket=fav.bucket+1""")
def _(t):
    d = Domain(t)
    table, panel = d.staged(range(18, 19))
    ready = panel.filter("spread <= 90").select("station", "local_date", F.col("first_pred").alias("f1"), "spread")
    table = table.drop("pred")
    fav = nearest_bucket(table.join(ready, ["station", "local_date"]), ["station", "local_date"], "bucket", "center", "f1", "spread")
    target = fav.select("station", "local_date", (F.col("bucket") + 1).alias("bucket"), "spread")
    return target.join(table, ["station", "local_date", "bucket"]).select("station", dcol(), "bucket", r6("spread", "spread"), "entry_price")

