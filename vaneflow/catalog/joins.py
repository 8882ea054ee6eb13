"""Joins and as-of lookups on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import plus_hours
from ..operators.asof import asof_anchors, asof_join, asof_nearest, window_lookup
from ..operators.joins import bucket_membership, diff_tables, near_runs, offset_partner
from ..plans.forecasts import gridded_peak, latest_run_max, run_maxima
from .registry import query


def us(c: str, name: str | None = None):
    return F.unix_micros(c).alias(name or c + "_us")


def of_type(t, kind: str, *cols: str, columns=("event_id", "user_id", "ts", "value")):
    return t.events.filter(F.col("event_type") == kind).select(*columns)


def ladder(t):
    """Ladders on the driver tables: an order is a ladder, its line numbers are the buckets."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("ladder_id"), F.col("l_linenumber").alias("idx")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("px"), F.sum("l_quantity").alias("qty")
    )


LADDER = (
    "WITH ladder AS (SELECT l_orderkey AS ladder_id, l_linenumber AS idx, round(sum(l_extendedprice),2) AS px,"
    " sum(l_quantity) AS qty FROM lineitem GROUP BY 1,2)"
)


@query("join_equi_inner", """
SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def _(t):
    # Summed per part before the join, so a part with many fills reaches it as one row.
    fills = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("k"), F.sum("l_quantity").alias("q"))
    return fills.join(t.part.select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(
        F.sum("k").alias("n"), F.round(F.sum("q"), 2).alias("qty"))


@query("join_left_features", """
WITH f AS (SELECT user_id, CAST(ts AS DATE) AS d, avg(value) FILTER (WHERE event_type='view') AS view_mean,
  max(value) FILTER (WHERE event_type='click') AS click_max, count(*) FILTER (WHERE event_type='purchase') AS n_buy
  FROM events GROUP BY 1,2),
g AS (SELECT c_custkey, c_nationkey, d FROM customer, (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events))
SELECT c_custkey, c_nationkey, CAST(g.d AS VARCHAR) AS d, round(view_mean,6) AS view_mean, click_max, n_buy
FROM g LEFT JOIN f ON f.user_id = g.c_custkey AND f.d = g.d""")
def _(t):
    e = t.events.withColumn("d", F.to_date("ts"))
    f = e.groupBy(F.col("user_id").alias("c_custkey"), "d").agg(
        F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 6).alias("view_mean"),
        F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("click_max"),
        F.count_if(F.col("event_type") == "purchase").alias("n_buy"),
    )
    # Every day of the feed for every customer; the days are few, one row each.
    grid = t.customer.select("c_custkey", "c_nationkey").crossJoin(F.broadcast(e.select("d").distinct()))
    return grid.join(f, ["c_custkey", "d"], "left").select("c_custkey", "c_nationkey", F.col("d").cast("string").alias("d"), "view_mean", "click_max", "n_buy")


@query("join_full_outer_diff", """
WITH p AS (SELECT event_id, user_id, event_type,
   CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN value + 0.00000005
        WHEN event_id % 11 = 0 THEN value + 0.01 ELSE value END AS value
   FROM events WHERE event_id % 101 <> 0
   UNION ALL SELECT event_id + 1000000000, user_id, event_type, value FROM events WHERE event_id % 97 = 0),
j AS (SELECT r.event_id AS rid, p.event_id AS pid, r.value AS rv, p.value AS pv, r.user_id AS ru, p.user_id AS pu,
   r.event_type AS rt, p.event_type AS pt FROM events r FULL JOIN p ON r.event_id = p.event_id),
s AS (SELECT count(*) FILTER (WHERE rid IS NOT NULL AND pid IS NOT NULL) AS n_both,
  count(*) FILTER (WHERE pid IS NULL) AS n_left_only, count(*) FILTER (WHERE rid IS NULL) AS n_right_only,
  count(*) FILTER (WHERE rid IS NOT NULL AND pid IS NOT NULL AND coalesce(abs(rv-pv) > 1e-6, rv IS DISTINCT FROM pv)) AS dv,
  count(*) FILTER (WHERE rid IS NOT NULL AND pid IS NOT NULL AND ru IS DISTINCT FROM pu) AS du,
  count(*) FILTER (WHERE rid IS NOT NULL AND pid IS NOT NULL AND rt IS DISTINCT FROM pt) AS dt FROM j)
SELECT 'value' AS column_name, n_both, n_left_only, n_right_only, dv AS n_diff FROM s
UNION ALL SELECT 'user_id', n_both, n_left_only, n_right_only, du FROM s
UNION ALL SELECT 'event_type', n_both, n_left_only, n_right_only, dt FROM s""")
def _(t):
    raw = t.events.select("event_id", "user_id", "event_type", "value")
    i = F.col("event_id")
    changed = raw.filter(i % 101 != 0).withColumn(
        "value",
        F.when(i % 17 == 0, None).when(i % 13 == 0, F.col("value") + 5e-8).when(i % 11 == 0, F.col("value") + 0.01)
        .otherwise(F.col("value")),
    )
    extra = raw.filter(i % 97 == 0).withColumn("event_id", i + 1_000_000_000)
    return diff_tables(raw, changed.unionByName(extra), ["event_id"], ["value", "user_id", "event_type"])


@query("join_theta_offset", LADDER + """,
fav AS (SELECT ladder_id, arg_max(idx, px * 100 - idx * 0.001) AS idx FROM ladder GROUP BY 1)
SELECT f.ladder_id, f.idx, p.idx AS partner_idx, p.px AS partner_px
FROM fav f JOIN ladder p ON p.ladder_id = f.ladder_id AND p.idx = f.idx + 1""")
def _(t):
    rungs = ladder(t)
    fav = rungs.groupBy("ladder_id").agg(F.max_by("idx", F.struct("px", -F.col("idx"))).alias("idx"))
    return offset_partner(rungs, fav, "ladder_id", "idx", 1, ["px"])


@query("join_range_membership", """
WITH b AS (SELECT DISTINCT event_type, floor(value / 25) * 25 AS lo FROM events WHERE value < 400),
m AS (SELECT e.event_type, b.lo, b.lo + 20 AS hi, e.value FROM events e JOIN b ON b.event_type = e.event_type
      AND e.value BETWEEN b.lo AND b.lo + 20)
SELECT event_type, lo, hi, count(*) AS n, round(sum(value), 2) AS total FROM m GROUP BY 1,2,3""")
def _(t):
    e = t.events.select("event_type", "value")
    lo = F.floor(F.col("value") / 25) * 25.0
    buckets = e.filter("value < 400").select("event_type", lo.alias("lo")).distinct().withColumn("hi", F.col("lo") + 20)
    found = bucket_membership(e, buckets, ["event_type"], "value", "lo", "hi")
    return found.groupBy("event_type", "lo", "hi").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query("join_interval_window", """
SELECT p.event_id, count(v.value) AS n, round(sum(v.value), 6) AS total, max(v.value) AS top, min(v.value) AS low
FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view'
 AND v.ts BETWEEN p.ts - INTERVAL 12 HOUR AND p.ts + INTERVAL 6 HOUR
WHERE p.event_type = 'error' GROUP BY p.event_id""")
def _(t):
    v = F.col("value")
    return window_lookup(
        of_type(t, "error"), of_type(t, "view"), ["user_id"], "event_id", "ts", "ts", -12 * 3600, 6 * 3600,
        n=("count", v), total=("sum", v), top=("max", v), low=("min", v),
    ).withColumn("total", F.round("total", 6))


@query("event_study", """
WITH p AS (SELECT event_id, user_id, ts, floor(value / 50) AS size_band FROM events WHERE event_type = 'purchase'),
a AS (SELECT p.*, o.m, p.ts + to_hours(o.m) AS at FROM p CROSS JOIN (VALUES (-6),(-1),(0),(1),(6)) o(m)),
v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
j AS (SELECT a.event_id, a.size_band, a.m, v.value FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.at >= v.ts)
SELECT CAST(size_band AS BIGINT) AS size_band, count(DISTINCT event_id) AS n,
 round(avg(value) FILTER (WHERE m=-6),6) AS before_6, round(avg(value) FILTER (WHERE m=-1),6) AS before_1,
 round(avg(value) FILTER (WHERE m=0),6) AS at_0, round(avg(value) FILTER (WHERE m=1),6) AS after_1,
 round(avg(value) FILTER (WHERE m=6),6) AS after_6 FROM j GROUP BY 1""")
def _(t):
    anchors = {"before_6": -6 * 3600, "before_1": -3600, "at_0": 0, "after_1": 3600, "after_6": 6 * 3600}
    p = of_type(t, "purchase")
    wide = asof_anchors(p, of_type(t, "view"), ["user_id"], "event_id", "ts", "ts", "value", anchors)
    sized = p.select("event_id", F.floor(F.col("value") / 50).alias("size_band"))
    return sized.join(wide, "event_id").groupBy("size_band").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(a), 6).alias(a) for a in anchors]
    )


def _probe_quote(t):
    return of_type(t, "purchase"), of_type(t, "view")


@query("asof_backward", """
SELECT p.event_id, q.event_id AS quote_id, q.value AS price, epoch_us(q.ts) AS quote_us
FROM (SELECT * FROM events WHERE event_type='purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='view') q ON p.user_id=q.user_id AND p.ts >= q.ts""")
def _(t):
    p, q = _probe_quote(t)
    out = asof_join(p, q, ["user_id"], "ts", "ts", {"quote_id": "event_id", "price": "value", "q_ts": "ts"}, seq=["event_id"])
    return out.select("event_id", "quote_id", "price", us("q_ts", "quote_us"))


@query("asof_forward", """
WITH p AS (SELECT *, ts + INTERVAL 5 MINUTE AS at FROM events WHERE event_type='purchase')
SELECT p.event_id, q.event_id AS quote_id, q.value AS price, epoch_us(q.ts) AS quote_us
FROM p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='view') q ON p.user_id=q.user_id AND p.at <= q.ts""")
def _(t):
    p, q = _probe_quote(t)
    p = p.withColumn("at", F.col("ts") + F.expr("INTERVAL 5 MINUTES"))
    out = asof_join(p, q, ["user_id"], "at", "ts", {"quote_id": "event_id", "price": "value", "q_ts": "ts"},
                    seq=["event_id"], direction="forward")
    return out.select("event_id", "quote_id", "price", us("q_ts", "quote_us"))


@query("asof_forward_tolerance", """
SELECT p.event_id, CASE WHEN q.ts <= p.ts + INTERVAL 3 HOUR THEN q.value END AS price
FROM (SELECT * FROM events WHERE event_type='purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='view') q ON p.user_id=q.user_id AND p.ts <= q.ts""")
def _(t):
    p, q = _probe_quote(t)
    return asof_join(p, q, ["user_id"], "ts", "ts", {"price": "value"}, seq=["event_id"], direction="forward",
                     tolerance="3 hours").select("event_id", "price")


@query("price_with_fallback", """
WITH bars AS (SELECT user_id, date_trunc('hour', ts) AS h, arg_max(value, ts) AS px FROM events WHERE event_type='view' GROUP BY 1,2),
p AS (SELECT event_id, user_id, date_trunc('hour', ts) AS h FROM events WHERE event_type='purchase'),
e AS (SELECT p.*, b.px AS exact_px FROM p LEFT JOIN bars b ON b.user_id=p.user_id AND b.h=p.h)
SELECT e.event_id, coalesce(e.exact_px, b.px) AS price, e.exact_px IS NOT NULL AS exact
FROM e ASOF LEFT JOIN bars b ON e.user_id=b.user_id AND e.h > b.h""")
def _(t):
    p, q = _probe_quote(t)
    bars = q.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("px")
    )
    p = p.withColumn("h", F.date_trunc("hour", "ts"))
    exact = p.join(bars.withColumnRenamed("px", "exact_px"), ["user_id", "h"], "left")
    back = asof_join(exact, bars, ["user_id"], "h", "h", {"early_px": "px"}, exact=False)
    return back.select(
        "event_id", F.coalesce("exact_px", "early_px").alias("price"), F.col("exact_px").isNotNull().alias("exact")
    )


@query("asof_nearest", """
WITH p AS (SELECT * FROM events WHERE event_type='purchase'), q AS (SELECT * FROM events WHERE event_type='view'),
b AS (SELECT p.event_id, p.user_id, p.ts, q.ts AS bts, q.value AS bv FROM p ASOF LEFT JOIN q ON p.user_id=q.user_id AND p.ts >= q.ts),
f AS (SELECT b.*, q.ts AS fts, q.value AS fv FROM b ASOF LEFT JOIN q ON b.user_id=q.user_id AND b.ts <= q.ts),
l AS (SELECT *, CASE WHEN bts >= ts - INTERVAL 2 HOUR THEN epoch_us(ts)-epoch_us(bts) END AS db,
  CASE WHEN fts <= ts + INTERVAL 2 HOUR THEN epoch_us(fts)-epoch_us(ts) END AS df FROM f)
SELECT event_id, CASE WHEN db IS NOT NULL AND (df IS NULL OR db <= df) THEN bv WHEN df IS NOT NULL THEN fv END AS price FROM l""")
def _(t):
    p, q = _probe_quote(t)
    return asof_nearest(p, q, ["user_id"], "ts", "ts", {"price": "value"}, seq=["event_id"], tolerance="2 hours").select(
        "event_id", "price"
    )


_ANCHORS = {"at_0": 0, "after_10s": 10, "after_60s": 60, "after_1h": 3600, "after_6h": 21600}


@query("asof_multi_anchor", """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type='purchase'),
v AS (SELECT user_id, ts, value FROM events WHERE event_type <> 'purchase')
SELECT p.event_id,
 (SELECT arg_max(value, ts) FROM v WHERE v.user_id=p.user_id AND v.ts <= p.ts) AS at_0,
 (SELECT arg_max(value, ts) FROM v WHERE v.user_id=p.user_id AND v.ts <= p.ts + INTERVAL 10 SECOND) AS after_10s,
 (SELECT arg_max(value, ts) FROM v WHERE v.user_id=p.user_id AND v.ts <= p.ts + INTERVAL 60 SECOND) AS after_60s,
 (SELECT arg_max(value, ts) FROM v WHERE v.user_id=p.user_id AND v.ts <= p.ts + INTERVAL 3600 SECOND) AS after_1h,
 (SELECT arg_max(value, ts) FROM v WHERE v.user_id=p.user_id AND v.ts <= p.ts + INTERVAL 21600 SECOND) AS after_6h
FROM p""")
def _(t):
    quotes = t.events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts", "value")
    return asof_anchors(of_type(t, "purchase"), quotes, ["user_id"], "event_id", "ts", "ts", "value", _ANCHORS, seq=["event_id"])


@query("quote_reconstruct", """
WITH p AS (SELECT * FROM events WHERE event_type='purchase'),
b AS (SELECT p.*, q.value AS ask, q.ts AS ats FROM p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='click') q
  ON p.user_id=q.user_id AND p.ts > q.ts)
SELECT b.event_id, b.ask, epoch_us(b.ats) AS ask_us, s.value AS bid, epoch_us(s.ts) AS bid_us
FROM b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='view') s ON b.user_id=s.user_id AND b.ts > s.ts""")
def _(t):
    sides = {"click": "ask", "view": "bid"}
    probes = of_type(t, "purchase").withColumn("event_type", F.explode(F.array(*map(F.lit, sides))))
    fills = t.events.filter(F.col("event_type").isin(*sides)).select("event_id", "user_id", "event_type", "ts", "value")
    hit = asof_join(probes.select("event_id", "user_id", "event_type", "ts"), fills, ["user_id", "event_type"], "ts", "ts",
                    {"px": "value", "at": "ts"}, seq=["event_id"], exact=False)
    picks = []
    for kind, name in sides.items():
        mine = F.col("event_type") == kind
        picks += [F.max(F.when(mine, F.col("px"))).alias(name),
                  F.max(F.when(mine, F.unix_micros("at"))).alias(f"{name}_us")]
    return hit.groupBy("event_id").agg(*picks)


@query("quote_window_extreme", """
SELECT p.event_id, round(1 - max(f.value/1000) FILTER (WHERE f.event_type='view'), 6) AS ask,
 round(1 - min(f.value/1000) FILTER (WHERE f.event_type='click'), 6) AS bid,
 count(*) FILTER (WHERE f.event_type='view') AS n_sell, count(*) FILTER (WHERE f.event_type='click') AS n_buy
FROM events p LEFT JOIN events f ON f.user_id=p.user_id AND f.ts BETWEEN p.ts - INTERVAL 300 MINUTE AND p.ts + INTERVAL 300 MINUTE
WHERE p.event_type='purchase' GROUP BY p.event_id""")
def _(t):
    px, kind = F.col("value") / 1000, F.col("event_type")
    sell, buy = F.when(kind == "view", px), F.when(kind == "click", px)
    fills = t.events.filter(kind.isin("view", "click")).select("user_id", "ts", "event_type", "value")
    got = window_lookup(
        of_type(t, "purchase"), fills, ["user_id"], "event_id", "ts", "ts", -300 * 60, 300 * 60,
        hi_sell=("max", sell), lo_buy=("min", buy), n_sell=("count", sell), n_buy=("count", buy),
    )
    return got.select(
        "event_id", F.round(1 - F.col("hi_sell"), 6).alias("ask"), F.round(1 - F.col("lo_buy"), 6).alias("bid"), "n_sell", "n_buy"
    )


def forecast_runs(t):
    """Forecast runs on the driver tables: each click is a run with three valid times."""
    lead = F.explode(F.array(F.lit(6), F.lit(18), F.lit(30))).alias("lead")
    return of_type(t, "click").select("user_id", F.col("ts").alias("runtime"), "value", lead).select(
        "user_id", "runtime", plus_hours("runtime", F.col("lead")).alias("ftime"),
        (F.col("value") + F.col("lead")).alias("n_x"), F.lit("UTC").alias("tz"),
    )


@query("asof_run_latest", """
WITH r AS (SELECT user_id, ts AS runtime, ts + to_hours(l) AS ftime, value + l AS n_x FROM events
  CROSS JOIN (VALUES (6),(18),(30)) x(l) WHERE event_type='click'),
p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type='view'),
c AS (SELECT p.user_id, p.d, r.runtime, max(r.n_x) AS v FROM p JOIN r ON r.user_id=p.user_id
  AND r.runtime <= p.d + INTERVAL 15 HOUR AND r.runtime >= p.d + INTERVAL 15 HOUR - INTERVAL 48 HOUR
  AND r.ftime BETWEEN p.d + INTERVAL 12 HOUR AND p.d + INTERVAL 22 HOUR GROUP BY 1,2,3)
SELECT p.user_id, CAST(p.d AS VARCHAR) AS d, arg_max(c.v, c.runtime) AS pred
FROM p LEFT JOIN c ON c.user_id=p.user_id AND c.d=p.d GROUP BY 1,2""")
def _(t):
    maxima = run_maxima(forecast_runs(t), "user_id", "runtime", "ftime", "n_x", "tz")
    probes = of_type(t, "view").select("user_id", F.to_date("ts").alias("local_date")).distinct().withColumn(
        "cutoff", plus_hours(F.col("local_date").cast("timestamp"), 15)
    )
    out = latest_run_max(probes, maxima, "user_id", "cutoff", "runtime", "n_x", "pred", look_back="48 hours")
    return out.select("user_id", F.col("local_date").cast("string").alias("d"), "pred")


def gridded(t):
    """Gridded points on the driver tables: station = event type, hourly inits with leads 0-5."""
    init = F.date_trunc("hour", "ts")
    return t.events.select(
        F.col("event_type").alias("station"), init.alias("init_time"),
        plus_hours(init, F.col("event_id") % 6).alias("valid_time"), "value",
    ).groupBy("station", "init_time", "valid_time").agg(F.max("value").alias("value"))


@query("asof_latest_per_valid", """
WITH g AS (SELECT event_type AS station, date_trunc('hour', ts) AS init, date_trunc('hour', ts) + to_hours(event_id % 6) AS valid,
  max(value) AS v FROM events GROUP BY 1,2,3),
p AS (SELECT DISTINCT event_type AS station, CAST(ts AS DATE) AS d FROM events),
k AS (SELECT p.station, p.d, g.valid, arg_max(g.v, g.init) AS v FROM p JOIN g ON g.station=p.station
  AND g.init <= p.d + INTERVAL 19 HOUR AND g.valid BETWEEN p.d + INTERVAL 12 HOUR AND p.d + INTERVAL 22 HOUR GROUP BY 1,2,3),
m AS (SELECT station, d, max(v) AS v, count(DISTINCT hour(valid)) AS n FROM k GROUP BY 1,2)
SELECT p.station, CAST(p.d AS VARCHAR) AS d, CASE WHEN m.n >= 8 THEN m.v END AS peak
FROM p LEFT JOIN m ON m.station=p.station AND m.d=p.d""")
def _(t):
    probes = t.events.select(F.col("event_type").alias("station"), F.to_date("ts").alias("local_date")).distinct()
    probes = probes.withColumns({
        "cutoff": plus_hours(F.col("local_date").cast("timestamp"), 19), "tz": F.lit("UTC"),
        "probe_id": F.concat_ws("|", "station", F.col("local_date").cast("string")),
    })
    out = gridded_peak(probes, gridded(t), "station", "probe_id", "cutoff", "init_time", "valid_time", "value", "tz", "peak", 8)
    return out.select("station", F.col("local_date").cast("string").alias("d"), "peak")


@query("join_grid_cross", """
WITH s AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS d FROM events),
g AS (SELECT s.event_type, s.d, b.b FROM s CROSS JOIN (SELECT unnest(range(0, 11)) AS b) b),
c AS (SELECT event_type, CAST(ts AS DATE) AS d, user_id % 11 AS b, count(*) AS n FROM events GROUP BY 1,2,3)
SELECT g.event_type, CAST(g.d AS VARCHAR) AS d, g.b AS bucket, coalesce(c.n, 0) AS n
FROM g LEFT JOIN c ON c.event_type=g.event_type AND c.d=g.d AND c.b=g.b""")
def _(t):
    e = t.events.select("event_type", F.to_date("ts").alias("d"), (F.col("user_id") % 11).alias("bucket"))
    grid = e.select("event_type", "d").distinct().withColumn(
        "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long")))
    )
    counts = e.groupBy("event_type", "d", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["event_type", "d", "bucket"], "left").select(
        "event_type", F.col("d").cast("string").alias("d"), "bucket", F.coalesce("n", F.lit(0)).alias("n")
    )


@query("join_values_cross", LADDER + """,
fav AS (SELECT ladder_id, arg_max(idx, px * 100 - idx * 0.001) AS idx FROM ladder GROUP BY 1)
SELECT o.k AS leg, count(*) AS n, round(sum(l.px), 2) AS cost FROM fav f
CROSS JOIN (VALUES (-1),(0),(1),(2)) o(k) JOIN ladder l ON l.ladder_id=f.ladder_id AND l.idx = f.idx + o.k GROUP BY 1""")
def _(t):
    rungs = ladder(t)
    fav = rungs.groupBy("ladder_id").agg(F.max_by("idx", F.struct("px", -F.col("idx"))).alias("fav"))
    legs = fav.withColumn("leg", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1, 2)]))).withColumn(
        "idx", F.col("fav") + F.col("leg")
    )
    return legs.join(rungs, ["ladder_id", "idx"]).groupBy("leg").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("px"), 2).alias("cost")
    )


@query("join_scalar_total", """
WITH h AS (SELECT hour(ts) AS hr, sum(value) AS usd FROM events GROUP BY 1)
SELECT CAST(hr AS BIGINT) AS hr, round(usd, 2) AS usd, round(usd / (SELECT sum(usd) FROM h), 6) AS share FROM h""")
def _(t):
    total = t.events.agg(F.sum("value")).scalar()
    by_hour = t.events.groupBy(F.hour("ts").cast("long").alias("hr")).agg(F.sum("value").alias("usd"))
    return by_hour.select("hr", F.round("usd", 2).alias("usd"), F.round(F.col("usd") / total, 6).alias("share"))


@query("join_lateral_expr", """
SELECT event_type, x.ask_band, count(*) AS n FROM events, LATERAL (SELECT CAST(floor((1000 - value) / 100) AS BIGINT) AS ask_band) x
GROUP BY 1,2""")
def _(t):
    return t.events.withColumn("ask_band", F.floor((1000 - F.col("value")) / 100)).groupBy("event_type", "ask_band").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("join_cross_model", """
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS v, ts, value FROM events WHERE event_type='view'),
b AS (SELECT user_id, CAST(ts AS DATE) AS v, ts, value FROM events WHERE event_type='click')
SELECT count(*) AS n, round(corr(a.value, b.value), 6) AS r, round(avg(a.value - b.value), 6) AS mean_diff
FROM a JOIN b ON a.user_id=b.user_id AND a.v=b.v AND abs(epoch_us(a.ts)-epoch_us(b.ts)) <= 3600000000""")
def _(t):
    a = of_type(t, "view").select("user_id", F.to_date("ts").alias("v"), F.col("ts").alias("ta"), F.col("value").alias("x"))
    b = of_type(t, "click").select("user_id", F.to_date("ts").alias("v"), F.col("ts").alias("tb"), F.col("value").alias("y"))
    return near_runs(a, b, ["user_id", "v"], "ta", "tb", 3600).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r"),
        F.round(F.avg(F.col("x") - F.col("y")), 6).alias("mean_diff"),
    )


@query("anti_join_orphans", """
SELECT l_partkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey=l_partkey AND p_size > 10)
GROUP BY 1""")
def _(t):
    known = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).join(known, "l_partkey", "left_anti")


@query("semi_join_present", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE user_id IN (SELECT user_id FROM events WHERE event_type='purchase' AND value > 150) GROUP BY 1""")
def _(t):
    big = t.events.filter("event_type = 'purchase' AND value > 150").select("user_id").distinct()
    return t.events.select("user_id", "event_type", "value").join(big, "user_id", "left_semi").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query("join_mismatch", """
WITH d AS (SELECT DISTINCT o_custkey, o_orderkey % 25 AS claimed FROM orders)
SELECT c_nationkey, count(*) AS n_tuples, count(*) FILTER (WHERE claimed <> c_nationkey) AS n_mismatch
FROM d JOIN customer ON c_custkey=o_custkey GROUP BY 1""")
def _(t):
    claims = t.orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 25).alias("claimed")).distinct()
    return claims.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n_tuples"), F.count_if(F.col("claimed") != F.col("c_nationkey")).alias("n_mismatch")
    )


@query("join_first_last_compare", """
WITH a AS (SELECT user_id, arg_max(value, ts) AS last_view, max(ts) AS last_at FROM events WHERE event_type='view' GROUP BY 1),
b AS (SELECT user_id, arg_min(value, ts) AS first_buy, min(ts) AS first_at FROM events WHERE event_type='purchase' GROUP BY 1)
SELECT a.user_id, last_view, first_buy, round(last_view - first_buy, 6) AS diff, last_at > first_at AS overlaps FROM a JOIN b USING (user_id)""")
def _(t):
    key = F.struct("ts", "event_id")
    a = of_type(t, "view").groupBy("user_id").agg(F.max_by("value", key).alias("last_view"), F.max("ts").alias("at"))
    b = of_type(t, "purchase").groupBy("user_id").agg(F.min_by("value", key).alias("first_buy"), F.min("ts").alias("bt"))
    return a.join(b, "user_id").select(
        "user_id", "last_view", "first_buy", F.round(F.col("last_view") - F.col("first_buy"), 6).alias("diff"),
        (F.col("at") > F.col("bt")).alias("overlaps"),
    )


@query("lookup_by_key", """
WITH k AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment='BUILDING'),
f AS (SELECT user_id, max(value) AS top, count(*) AS n FROM events
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' GROUP BY 1)
SELECT c_custkey, top, n FROM k LEFT JOIN f ON f.user_id=c_custkey""")
def _(t):
    day = t.events.filter("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
    found = day.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n"))
    wanted = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return wanted.join(found, "c_custkey", "left")
