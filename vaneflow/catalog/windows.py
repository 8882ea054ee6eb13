"""Window, resampling, sort and set queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series
from ..operators.asof import asof_anchors, asof_join
from ..operators.joins import union_by_name
from ..operators.ordered import neighbours, previous, running, shift
from ..operators.resample import resample_ffill
from ..session import stage
from .joins import LADDER, ladder, of_type, us
from .registry import query

ORD = ["ts", "event_id"]


def ev(t, *cols):
    return t.events.select(*(cols or ("event_id", "user_id", "event_type", "ts", "value")))


@query("win_running_extreme", """
SELECT event_id, max(value) OVER w AS run_max, min(value) OVER w AS run_min FROM events
WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    e = ev(t).withColumn("d", F.to_date("ts"))
    v = F.col("value")
    return running(e, ["user_id", "d"], ORD, run_max=("max", v), run_min=("min", v)).select(
        "event_id", "run_max", "run_min"
    )


@query("win_row_number_latest", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER
 (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc_nulls_last("ts"), F.desc("event_id"))
    return ev(t).withColumn("rn", F.row_number().over(w)).filter("rn <= 1").select("user_id", "event_type", "event_id", "value")


@query("win_priority_pick", """
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, event_id FROM (SELECT *, row_number() OVER
 (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE WHEN hour(ts) BETWEEN 10 AND 14 THEN 1 ELSE 0 END DESC, ts DESC, event_id DESC) AS rn
 FROM events) WHERE rn = 1""")
def _(t):
    preferred = F.when(F.hour("ts").between(10, 14), 1).otherwise(0)
    w = Window.partitionBy("user_id", "d").orderBy(preferred.desc(), F.desc("ts"), F.desc("event_id"))
    return ev(t).withColumn("d", F.to_date("ts").cast("string")).withColumn("rn", F.row_number().over(w)).filter("rn <= 1").select("user_id", "d", "event_id")


@query("win_qualify", """
SELECT user_id, event_id, value FROM events WHERE event_type = 'view'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return of_type(t, "view").withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select("user_id", "event_id", "value")


@query("win_lag_lead", """
SELECT event_id, lag(value,1) OVER w AS lag_1, lag(value,5) OVER w AS lag_5, lag(value,60) OVER w AS lag_60,
 lead(value,1) OVER w AS lead_1, lead(value,10) OVER w AS lead_10, lead(value,20) OVER w AS lead_20 FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def _(t):
    steps = {"lag_1": 1, "lag_5": 5, "lag_60": 60, "lead_1": -1, "lead_10": -10, "lead_20": -20}
    out = neighbours(ev(t), ["event_type"], ORD, None, {n: shift("value", k) for n, k in steps.items()},
                     before=60, after=20)
    return out.select("event_id", *steps)


@query("win_group_shift", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, max(value) AS top, avg(value) AS pred FROM events GROUP BY 1,2)
SELECT user_id, CAST(d AS VARCHAR) AS d, lag(top) OVER w AS yesterday, round(lag(top - pred) OVER w, 6) AS yesterday_error FROM d
WINDOW w AS (PARTITION BY user_id ORDER BY d)""")
def _(t):
    daily = ev(t).groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max("value").alias("top"), F.avg("value").alias("pred"))
    month = (F.year("d") * 12 + F.month("d")).cast("long")
    out = previous(daily, ["user_id"], ["d"], month, yesterday=F.col("top"), yesterday_error=F.col("top") - F.col("pred"))
    return out.select("user_id", F.col("d").cast("string").alias("d"), "yesterday", F.round("yesterday_error", 6).alias("yesterday_error"))


@query("win_ntile", """
WITH n AS (SELECT o_orderpriority, o_totalprice, ntile(3) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS tile FROM orders)
SELECT o_orderpriority, tile, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM n GROUP BY 1,2""")
def _(t):
    o = t.orders.select("o_orderpriority", "o_totalprice", "o_orderkey")
    ranked = running(o, ["o_orderpriority"], ["o_totalprice", "o_orderkey"],
                     rn=("count", F.lit(1)), n=("total_count", F.lit(1)))
    tile = ntile_of(F.col("rn"), F.col("n"), 3)
    return ranked.groupBy("o_orderpriority", tile.alias("tile")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")
    )


def ntile_of(rn, n, k: int):
    """Tile of a row number: the first n mod k tiles hold one row more."""
    q, r = F.floor(n / k), n % k
    edge = r * (q + 1)
    return F.when(rn <= edge, F.floor((rn - 1) / (q + 1)) + 1).otherwise(r + F.floor(F.try_divide(rn - 1 - edge, q)) + 1).cast("long")


ANCHOR_HOURS = (6, 12, 18, 24)


def bucket_path(t):
    """Price of every bucket at four daily anchors: the day is the ladder, user_id mod 11 the bucket."""
    e = t.events.select((F.col("user_id") % 11).alias("bucket"), "ts", "event_id", "value")
    days = e.select(F.to_date("ts").alias("d"), "bucket").groupBy("d", "bucket").agg(F.count(F.lit(1)).alias("seen"))
    probes = days.select("d", "bucket", F.col("d").cast("timestamp").alias("t0"),
                         F.concat_ws("|", F.col("d").cast("string"), F.col("bucket").cast("string")).alias("pid"))
    wide = asof_anchors(probes, e, ["bucket"], "pid", "t0", "ts", "value",
                        {f"p{h}": h * 3600 for h in ANCHOR_HOURS}, seq=["event_id"])
    outcome = e.groupBy(F.to_date("ts").alias("d"), "bucket").agg(F.round(F.sum("value"), 2).alias("score"))
    return probes.join(wide, "pid").join(outcome, ["d", "bucket"]).select("d", "bucket", "score", *[f"p{h}" for h in ANCHOR_HOURS])


BUCKET_PATH = """WITH e AS (SELECT user_id % 11 AS bucket, ts, event_id, value FROM events),
days AS (SELECT CAST(ts AS DATE) AS d, bucket, round(sum(value),2) AS score FROM e GROUP BY 1,2),
a AS (SELECT d, bucket, score, h, d + to_hours(h) AS at FROM days CROSS JOIN (VALUES (6),(12),(18),(24)) x(h)),
path AS (SELECT a.d, a.bucket, a.score, a.h, e.value AS p FROM a ASOF LEFT JOIN e ON a.bucket = e.bucket AND a.at >= e.ts),
win AS (SELECT d, arg_max(bucket, score * 1000 - bucket * 0.001) AS winner FROM days GROUP BY 1)"""


@query("win_rank", BUCKET_PATH + """,
r AS (SELECT *, rank() OVER (PARTITION BY d, h ORDER BY p DESC) AS rk FROM path WHERE p IS NOT NULL)
SELECT CAST(h AS BIGINT) AS h, count(*) AS n_days, count(*) FILTER (WHERE rk=1) AS n_first, round(avg(rk), 6) AS mean_rank
FROM r JOIN win ON win.d=r.d AND win.winner=r.bucket GROUP BY 1""")
def _(t):
    path = bucket_path(t)
    tall = path.select("d", "bucket", "score", F.inline(F.array(*[
        F.struct(F.lit(h).cast("long").alias("h"), F.col(f"p{h}").alias("p")) for h in ANCHOR_HOURS]))).filter("p IS NOT NULL")
    ranked = tall.withColumn("rk", F.rank().over(Window.partitionBy("d", "h").orderBy(F.desc("p"))))
    win = path.groupBy("d").agg(F.max_by("bucket", F.struct("score", -F.col("bucket"))).alias("bucket"))
    return ranked.join(win, ["d", "bucket"]).groupBy("h").agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("rk") == 1).alias("n_first"), F.round(F.avg("rk"), 6).alias("mean_rank")
    )


@query("win_share", LADDER + "\nSELECT ladder_id, idx, round(px / sum(px) OVER (PARTITION BY ladder_id), 6) AS share FROM ladder")
def _(t):
    # A ladder holds at most one row per line number, so its window is bounded.
    total = F.sum("px").over(Window.partitionBy("ladder_id"))
    return ladder(t).select("ladder_id", "idx", F.round(F.col("px") / total, 6).alias("share"))


@query("win_rolling_mean", """
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 13 PRECEDING), 6) AS mean_14,
 round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 20 PRECEDING), 6) AS mean_21 FROM events""")
def _(t):
    out = neighbours(ev(t), ["user_id"], ORD, None, {
        "mean_14": lambda win: F.avg("value").over(win(-13, 0)), "mean_21": lambda win: F.avg("value").over(win(-20, 0))}, before=20)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("mean_14", "mean_21")])


@query("win_chrono_split", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events WHERE event_type='purchase')
SELECT CASE WHEN rn <= n * 0.7 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(value), 6) AS mean_value,
 epoch_us(min(ts)) AS first_us FROM r GROUP BY 1""")
def _(t):
    r = running(of_type(t, "purchase"), [], ORD, rn=("count", F.lit(1)), n=("total_count", F.lit(1)))
    part = F.when(F.col("rn") <= F.col("n") * 0.7, "train").otherwise("test")
    return r.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.unix_micros(F.min("ts")).alias("first_us")
    )


@query("win_cumulative", """
WITH c AS (SELECT event_id, user_id, count(*) OVER w AS n_cum, round(sum(value) OVER w, 4) AS usd_cum FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, n_cum, usd_cum FROM c""")
def _(t):
    out = running(ev(t), ["user_id"], ORD, n_cum=("count", F.lit(1)), usd_cum=("sum", F.col("value")))
    return out.select("event_id", "n_cum", F.round("usd_cum", 4).alias("usd_cum"))


@query("win_sustained", """
SELECT event_id, sum(CASE WHEN value >= 30 THEN 1 ELSE 0 END) OVER
 (PARTITION BY event_type ORDER BY ts, event_id ROWS 2 PRECEDING) = 3 AS sustained FROM events""")
def _(t):
    return series.sustained(ev(t), ["event_type"], ORD, F.col("value") >= 30, 3).select("event_id", "sustained")


@query("first_crossing", """
WITH o AS (SELECT user_id % 5 AS station, CAST(ts AS DATE) AS d, ts, event_id, value,
  max(value) OVER (PARTITION BY user_id % 5, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rmax FROM events),
m AS (SELECT n_name AS slug, n_regionkey AS station, n_nationkey * 5 AS lo, n_nationkey * 5 + 4 AS hi,
  CASE n_nationkey % 3 WHEN 0 THEN 'or_higher' WHEN 1 THEN 'or_below' ELSE 'range' END AS kind FROM nation),
j AS (SELECT m.slug, m.kind, o.d, o.ts, o.event_id, o.rmax,
  CASE WHEN kind='or_higher' AND rmax >= lo THEN 1 WHEN kind<>'or_higher' AND rmax > hi THEN 0 END AS res,
  CASE WHEN kind='or_higher' AND value >= lo THEN 1 WHEN kind<>'or_higher' AND value > hi THEN 1 ELSE 0 END AS f
  FROM m JOIN o USING (station)),
s AS (SELECT *, sum(f) OVER (PARTITION BY slug, d ORDER BY ts, event_id ROWS 2 PRECEDING) AS k FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY slug, d ORDER BY ts, event_id) AS rn FROM s WHERE res IS NOT NULL AND k >= 3)
SELECT slug, kind, CAST(d AS VARCHAR) AS d, res AS resolution, epoch_us(ts) AS lock_us, rmax AS max_at_lock FROM r WHERE rn=1""")
def _(t):
    obs = ev(t).withColumns({"station": (F.col("user_id") % 5).cast("int"), "d": F.to_date("ts")})
    keys = ["station", "d"]
    obs = running(obs, keys, ORD, rmax=("max", F.col("value")))
    # Three rows in a row beyond an edge is the same as their minimum being beyond it, for every strike.
    obs = neighbours(obs, keys, ORD, None, {
        "low3": lambda win: F.min("value").over(win(-2, 0)), "seen": lambda win: F.count("value").over(win(-2, 0))}, before=2)
    # Only a minimum above all before can be the first beyond any edge: a staircase that rises along the day, so
    # the first row beyond an edge is the lowest step beyond it, a lookup along the value axis.
    records = running(obs.filter("seen = 3"), keys, ORD, exclusive=True, before=("max", F.col("low3"))).filter("before IS NULL OR low3 > before")
    records = stage(records.select(*keys, "low3", F.struct("rmax", F.unix_micros("ts").alias("us")).alias("step")), "records")
    n = F.col("n_nationkey")
    kind = F.when(n % 3 == 0, "or_higher").when(n % 3 == 1, "or_below").otherwise("range")
    strikes = t.nation.select(F.col("n_name").alias("slug"), F.col("n_regionkey").alias("station"), kind.alias("kind"),
                              F.when(n % 3 == 0, n * 5).otherwise(n * 5 + 4).cast("double").alias("edge"))
    probes = strikes.join(records.select(*keys).distinct(), "station")
    hits = []
    for higher in (True, False):  # at the edge or above it for `or_higher`, strictly above it for the others
        mine = probes.filter((F.col("kind") == "or_higher") == higher)
        hits.append(asof_join(mine, records, keys, "edge", "low3", {"step": "step"}, direction="forward", exact=higher, how="inner"))
    return hits[0].unionByName(hits[1]).select(
        "slug", "kind", F.col("d").cast("string").alias("d"), F.col("step.rmax").alias("max_at_lock"), F.col("step.us").alias("lock_us"),
        F.when(F.col("kind") == "or_higher", 1).otherwise(0).alias("resolution"))


@query("sessionize_gaps", """
WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l)
SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n,
 max(value) AS peak, round(avg(value), 6) AS mean_value FROM s GROUP BY 1,2""")
def _(t):
    out = series.sessionize(ev(t), ["user_id"], "ts", ["event_id"], 6 * 3600, F.max("value").alias("peak"),
                            F.round(F.avg("value"), 6).alias("mean_value"))
    return out.select("user_id", "session", us("start_ts", "start_us"), us("end_ts", "end_us"), "n", "peak", "mean_value")


@query("longest_streak", """
WITH f AS (SELECT user_id, ts, event_id, value < 50 AS loss FROM events),
g AS (SELECT *, sum(CASE WHEN loss THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM f),
c AS (SELECT user_id, b, count(*) FILTER (WHERE loss) AS n FROM g GROUP BY 1,2)
SELECT user_id, max(n) AS max_losses FROM c GROUP BY 1""")
def _(t):
    return series.longest_streak(ev(t), ["user_id"], "ts", ["event_id"], F.col("value") < 50, "max_losses")


@query("equity_drawdown", """
WITH r AS (SELECT user_id, ts, event_id, least(value, 200) / 50 - 1 AS r FROM events),
e AS (SELECT *, exp(sum(ln(1 + 0.02 * r)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS eq FROM r),
p AS (SELECT *, greatest(max(eq) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1.0) AS pk FROM e)
SELECT user_id, count(*) AS n, round(arg_max(eq, event_id), 6) AS final_equity, round(max(1 - eq / pk), 6) AS max_drawdown FROM p GROUP BY 1""")
def _(t):
    ret = F.least(F.col("value"), F.lit(200.0)) / 50 - 1
    curve = series.equity_curve(ev(t), ["user_id"], "ts", ["event_id"], ret, 0.02)
    return curve.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max_by("equity", F.struct("ts", "event_id")), 6).alias("final_equity"),
        F.round(F.max("drawdown"), 6).alias("max_drawdown"),
    )


@query("tick_events", """
WITH l AS (SELECT *, lag(ts) OVER w AS pts, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(value - pv, 6) AS move FROM l WHERE ts - pts <= INTERVAL 2 HOUR AND value <> pv""")
def _(t):
    out = series.tick_changes(ev(t), ["user_id"], "ts", ["event_id"], "value", 7200)
    return out.select("event_id", F.round("move", 6).alias("move"))


@query("event_response", """
WITH l AS (SELECT *, lag(ts) OVER w AS pts, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT event_id, event_type, ts, value - pv AS move FROM l WHERE ts - pts <= INTERVAL 2 HOUR AND value <> pv),
q AS (SELECT user_id % 7 AS b, event_type, ts, value FROM events),
p AS (SELECT k.*, o.h, k.ts + to_seconds(o.h) AS at FROM k CROSS JOIN (VALUES (0),(600),(3600)) o(h)),
j AS (SELECT p.event_id, p.move, p.h, q.value FROM p ASOF LEFT JOIN q ON p.event_type = q.event_type AND p.at >= q.ts),
w AS (SELECT event_id, any_value(move) AS move, max(value) FILTER (WHERE h=0) AS v0, max(value) FILTER (WHERE h=600) AS v1,
  max(value) FILTER (WHERE h=3600) AS v2 FROM j GROUP BY 1)
SELECT CASE WHEN move > 0 THEN 'up' ELSE 'down' END AS direction, abs(move) >= 40 AS big, count(*) AS n,
 round(avg(v1 - v0), 6) AS after_10m, round(avg(v2 - v0), 6) AS after_1h FROM w GROUP BY 1,2""")
def _(t):
    ticks = series.tick_changes(ev(t), ["user_id"], "ts", ["event_id"], "value", 7200)
    wide = asof_anchors(ticks, ev(t), ["event_type"], "event_id", "ts", "ts", "value", {"v0": 0, "v1": 600, "v2": 3600},
                        seq=["event_id"])
    m = F.col("move")
    return ticks.select("event_id", "move").join(wide, "event_id").groupBy(
        F.when(m > 0, "up").otherwise("down").alias("direction"), (F.abs(m) >= 40).alias("big")
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("v1") - F.col("v0")), 6).alias("after_10m"),
          F.round(F.avg(F.col("v2") - F.col("v0")), 6).alias("after_1h"))


@query("move_reversion", """
WITH l AS (SELECT value, lag(value,1) OVER w AS p1, lead(value,1) OVER w AS n1, lead(value,5) OVER w AS n5, lead(value,10) OVER w AS n10,
  lead(value,20) OVER w AS n20 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
x AS (SELECT l.*, value - p1 AS mv, th FROM l CROSS JOIN (VALUES (20),(50),(100)) v(th) WHERE abs(value - p1) >= th)
SELECT th, CASE WHEN mv > 0 THEN 'up' ELSE 'down' END AS direction, count(*) AS n, round(avg(n1-value),6) AS m1, round(avg(n5-value),6) AS m5,
 round(avg(n10-value),6) AS m10, round(avg(n20-value),6) AS m20, count(*) FILTER (WHERE (n1-value)*mv < 0) AS n_revert FROM x GROUP BY 1,2""")
def _(t):
    steps = {"p1": 1, "n1": -1, "n5": -5, "n10": -10, "n20": -20}
    near = neighbours(ev(t), ["event_type"], ORD, None, {n: shift("value", k) for n, k in steps.items()}, before=1, after=20)
    v, mv = F.col("value"), F.col("value") - F.col("p1")
    hits = near.withColumn("th", F.explode(F.array(*map(F.lit, (20, 50, 100))))).filter(F.abs(mv) >= F.col("th"))
    return hits.groupBy("th", F.when(mv > 0, "up").otherwise("down").alias("direction")).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(f"n{k}") - v), 6).alias(f"m{k}") for k in (1, 5, 10, 20)],
        F.count_if((F.col("n1") - v) * mv < 0).alias("n_revert"),
    )


@query("volatility_profile", """
WITH l AS (SELECT user_id, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events)
SELECT user_id, count(*) AS n, round(sum(abs(s)), 4) AS total_variation, round(stddev_samp(s), 6) AS step_sd,
 round(sum(abs(s)) / (nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0) / 3.6e9), 6) AS per_hour, max(abs(s)) AS largest FROM l GROUP BY 1""")
def _(t):
    steps = previous(ev(t), ["user_id"], ORD, pv=F.col("value")).withColumn("s", F.col("value") - F.col("pv"))
    total = F.sum(F.abs("s"))
    hours = F.nullif(F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts")), F.lit(0)) / 3.6e9
    return steps.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(total, 4).alias("total_variation"), F.round(F.stddev_samp("s"), 6).alias("step_sd"),
        F.round(total / hours, 6).alias("per_hour"), F.max(F.abs("s")).alias("largest"),
    )


@query("taker_replay", """
WITH q AS (SELECT event_type, value * 0.99 AS bid, lead(value * 1.01, 5) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS ask5 FROM events)
SELECT event_type, count(ask5) AS n, round(avg(bid - ask5), 6) AS mean_pnl FROM q GROUP BY 1""")
def _(t):
    q = ev(t).withColumns({"bid": F.col("value") * 0.99, "ask": F.col("value") * 1.01})
    out = neighbours(q, ["event_type"], ORD, None, {"ask5": shift("ask", -5)}, after=5)
    return out.groupBy("event_type").agg(F.count("ask5").alias("n"), F.round(F.avg(F.col("bid") - F.col("ask5")), 6).alias("mean_pnl"))


@query("autocorr_lag1", """
WITH l AS (SELECT event_type, value - 50 AS b, lag(value - 50) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)
SELECT event_type, count(p) AS n, round(corr(b, p), 6) AS r, round(avg(b) FILTER (WHERE p > 0), 6) AS after_pos,
 round(avg(b) FILTER (WHERE p <= 0), 6) AS after_neg FROM l GROUP BY 1""")
def _(t):
    e = ev(t).withColumn("b", F.col("value") - 50)
    lagged = previous(e, ["event_type"], ORD, p=F.col("b"))
    return lagged.groupBy("event_type").agg(
        F.count("p").alias("n"), F.round(F.corr("b", "p"), 6).alias("r"),
        F.round(F.avg(F.when(F.col("p") > 0, F.col("b"))), 6).alias("after_pos"),
        F.round(F.avg(F.when(F.col("p") <= 0, F.col("b"))), 6).alias("after_neg"),
    )


@query("gap_distribution", """
WITH l AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS g FROM events)
SELECT user_id, count(g) AS n, round(avg(g) / 6e7, 4) AS mean_minutes, round(max(g) / 6e7, 4) AS max_minutes FROM l GROUP BY 1""")
def _(t):
    lagged = previous(ev(t), ["user_id"], ORD, p=F.col("ts"))
    gap = F.unix_micros("ts") - F.unix_micros("p")
    return lagged.groupBy("user_id").agg(
        F.count("p").alias("n"), F.round(F.avg(gap) / 6e7, 4).alias("mean_minutes"), F.round(F.max(gap) / 6e7, 4).alias("max_minutes")
    )


@query("forecast_velocity", """
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, arg_max(value, ts) AS v FROM events GROUP BY 1,2)
SELECT a.event_type, epoch_us(a.h) AS h_us, round(a.v - b.v, 6) AS velocity FROM h a JOIN h b ON a.event_type=b.event_type
AND b.h = a.h - INTERVAL 6 HOUR WHERE abs(a.v - b.v) >= 20""")
def _(t):
    hourly = ev(t).groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    earlier = hourly.select("event_type", (F.col("h") + F.expr("INTERVAL 6 HOURS")).alias("h"), F.col("v").alias("v6"))
    out = hourly.join(earlier, ["event_type", "h"]).withColumn("velocity", F.col("v") - F.col("v6")).filter(F.abs("velocity") >= 20)
    return out.select("event_type", us("h"), F.round("velocity", 6).alias("velocity"))


@query("burst_cluster", """
WITH r AS (SELECT event_id, event_type, CAST(floor(value / 50) AS BIGINT) AS size_class, ts, value FROM events),
a AS (SELECT *, count(*) OVER (PARTITION BY event_type, size_class ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 90 MINUTE FOLLOWING) >= 6 AS o FROM r),
m AS (SELECT *, max(CAST(o AS INT)) OVER (PARTITION BY event_type, size_class ORDER BY ts RANGE BETWEEN INTERVAL 90 MINUTE PRECEDING AND CURRENT ROW) AS mem FROM a),
l AS (SELECT *, lag(ts) OVER (PARTITION BY event_type, size_class ORDER BY ts, event_id) AS p FROM m WHERE mem = 1),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 90 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, size_class ORDER BY ts, event_id) AS k FROM l)
SELECT event_type, size_class, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 2) AS notional FROM s GROUP BY event_type, size_class, k""")
def _(t):
    rows = ev(t).withColumn("size_class", F.floor(F.col("value") / 50))
    out = series.bursts(rows, ["event_type", "size_class"], "event_id", "ts", 5400, 6, F.round(F.sum("value"), 2).alias("notional"))
    return out.select("event_type", "size_class", us("start_ts", "start_us"), "n", "notional")


@query("resample_ffill", """
WITH f AS (SELECT user_id, ts, event_id, event_type, value / 100 AS px, event_id % 7 + 1 AS sz FROM events WHERE event_type IN ('click','view')),
b AS (SELECT user_id, CAST(floor(epoch_us(ts) / 7.2e9) AS BIGINT) AS b, arg_max(px, ts) FILTER (WHERE event_type='click') AS yp,
  arg_max(px, ts) FILTER (WHERE event_type='view') AS np, count(*) FILTER (WHERE event_type='click') AS yn,
  count(*) FILTER (WHERE event_type='view') AS nn, sum(sz) FILTER (WHERE event_type='click') AS ys,
  sum(sz) FILTER (WHERE event_type='view') AS ns, sum(px * sz) AS usd FROM f GROUP BY 1,2),
e AS (SELECT user_id, CAST(floor(epoch_us(min(ts)) / 7.2e9) AS BIGINT) AS lo, CAST(ceil(epoch_us(max(ts)) / 7.2e9) AS BIGINT) AS hi FROM f GROUP BY 1),
s AS (SELECT user_id, unnest(range(lo, hi + 1)) AS b FROM e),
j AS (SELECT s.user_id, s.b, yp, np, yn, nn, ys, ns, usd FROM s LEFT JOIN b ON b.user_id=s.user_id AND b.b=s.b)
SELECT user_id, b * 7200 AS bar_s, last_value(yp IGNORE NULLS) OVER w AS yes_price, last_value(np IGNORE NULLS) OVER w AS no_price,
 CAST(coalesce(sum(yn) OVER w, 0) AS BIGINT) AS yes_count, CAST(coalesce(sum(nn) OVER w, 0) AS BIGINT) AS no_count,
 CAST(coalesce(sum(ys) OVER w, 0) AS BIGINT) AS yes_size_cum, CAST(coalesce(sum(ns) OVER w, 0) AS BIGINT) AS no_size_cum,
 round(coalesce(sum(usd) OVER w, 0), 4) AS usd_cum FROM j WINDOW w AS (PARTITION BY user_id ORDER BY b ROWS UNBOUNDED PRECEDING)""")
def _(t):
    fills = ev(t).withColumns({"px": F.col("value") / 100, "sz": F.col("event_id") % 7 + 1})
    out = resample_ffill(fills, ["user_id"], "ts", ["event_id"], "event_type", {"click": "yes", "view": "no"}, "px", "sz", 7200)
    return out.withColumns({"bar_s": F.unix_seconds("bar"), "usd_cum": F.round("usd_cum", 4)}).drop("bar")


@query("dedupe_first_per_minute", """
SELECT user_id, epoch_us(date_trunc('hour', ts)) AS slot_us, arg_min(event_id, ts) AS event_id, arg_min(value, ts) AS value FROM events GROUP BY 1,2""")
def _(t):
    key = F.struct("ts", "event_id")
    g = ev(t).groupBy("user_id", F.date_trunc("hour", "ts").alias("slot")).agg(F.min_by(F.struct("event_id", "value"), key).alias("r"))
    return g.select("user_id", us("slot"), "r.event_id", "r.value")


@query("dedupe_last_per_second", """
SELECT event_type, epoch_us(date_trunc('minute', ts)) AS slot_us, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1,2""")
def _(t):
    key = F.struct("ts", "event_id")
    g = ev(t).groupBy("event_type", F.date_trunc("minute", "ts").alias("slot")).agg(F.max_by(F.struct("event_id", "value"), key).alias("r"))
    return g.select("event_type", us("slot"), "r.event_id", "r.value")


@query("topk_global", """
SELECT o_custkey, round(sum(o_totalprice), 2) AS usd, count(*) AS n FROM orders GROUP BY 1 ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey LIMIT 20""")
def _(t):
    return t.orders.groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("usd"), F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("usd"), "o_custkey").limit(20)


@query("topk_per_group", LADDER + """
SELECT ladder_id, idx, px, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY ladder_id ORDER BY px DESC, idx) AS rk FROM ladder) WHERE rk <= 3""")
def _(t):
    w = Window.partitionBy("ladder_id").orderBy(F.desc("px"), "idx")
    return ladder(t).withColumn("rk", F.row_number().over(w)).filter("rk <= 3").select("ladder_id", "idx", "px", "rk")


@query("topk_detail", """
WITH v AS (SELECT l_partkey, round(sum(l_extendedprice), 2) AS vol FROM lineitem GROUP BY 1),
top AS (SELECT l_partkey FROM v ORDER BY vol DESC, l_partkey LIMIT 1)
SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS lo, round(avg(l_extendedprice), 6) AS mean_px, max(l_extendedprice) AS hi,
 sum(l_quantity) AS shares, epoch_us(min(l_shipdate)) AS first_us, epoch_us(max(l_shipdate)) AS last_us
FROM lineitem WHERE l_partkey = (SELECT l_partkey FROM top) GROUP BY 1""")
def _(t):
    vol = t.lineitem.groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("vol"))
    top = vol.agg(F.max_by("l_partkey", F.struct("vol", -F.col("l_partkey"))).alias("l_partkey"))
    px = F.col("l_extendedprice")
    return t.lineitem.join(F.broadcast(top), "l_partkey").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.min(px).alias("lo"), F.round(F.avg(px), 6).alias("mean_px"), F.max(px).alias("hi"),
        F.sum("l_quantity").alias("shares"), F.unix_micros(F.min("l_shipdate")).alias("first_us"),
        F.unix_micros(F.max("l_shipdate")).alias("last_us"),
    )


@query("value_frequency", """
SELECT k, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events) GROUP BY 1 ORDER BY n DESC, k LIMIT 10""")
def _(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "k"
    ).limit(10)


@query("order_by_proximity", """
SELECT o_orderkey, abs(date_diff('day', o_orderdate, TIMESTAMP '1998-06-15')) AS days FROM orders ORDER BY 2, 1 LIMIT 50""")
def _(t):
    days = F.abs(F.datediff("o_orderdate", F.lit("1998-06-15"))).cast("long")
    return t.orders.select("o_orderkey", days.alias("days")).orderBy("days", "o_orderkey").limit(50)


@query("union_all", """
SELECT src, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 'event' AS src, value AS v FROM events UNION ALL
SELECT 'order', o_totalprice FROM orders UNION ALL SELECT 'line', l_extendedprice FROM lineitem) GROUP BY 1""")
def _(t):
    parts = [
        t.events.select(F.lit("event").alias("src"), F.col("value").alias("v")),
        t.orders.select(F.lit("order").alias("src"), F.col("o_totalprice").alias("v")),
        t.lineitem.select(F.lit("line").alias("src"), F.col("l_extendedprice").alias("v")),
    ]
    return union_by_name(parts).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("distinct_keys", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("set_difference", """
WITH e AS (SELECT r.et, CAST(unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS TIMESTAMP) AS h FROM
 (SELECT event_type AS et, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events GROUP BY 1) r)
SELECT e.et AS event_type, epoch_us(e.h) AS h_us FROM e
WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type=e.et AND date_trunc('hour', x.ts)=e.h)""")
def _(t):
    e = t.events.select("event_type", F.date_trunc("hour", "ts").alias("h"))
    ends = e.groupBy("event_type").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    expected = ends.select("event_type", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("h"))
    return expected.join(e.distinct(), ["event_type", "h"], "left_anti").select("event_type", us("h"))
