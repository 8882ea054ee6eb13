"""Aggregation queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.calendar import local_date, local_time
from ..operators import ladder as rungs
from ..operators.asof import asof_join
from ..operators.ordered import running
from ..operators.quantiles import exact_quantiles
from ..operators.resample import bar_last
from ..plans import stats
from ..session import stage
from .joins import LADDER, ladder, us
from .registry import query
from .windows import ANCHOR_HOURS, BUCKET_PATH, bucket_path, ev

ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "UTC")
SQL_ZONE = "CASE user_id % 5 " + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(ZONES)) + " END"


def zoned(t):
    """Events with an IANA zone per user, and the local day and hour."""
    zone = F.element_at(F.array(*map(F.lit, ZONES)), (F.col("user_id") % 5 + 1).cast("int"))
    e = ev(t).withColumn("tz", zone)
    return e.withColumns({"local_day": local_date("ts", "tz"), "local_hour": F.hour(local_time("ts", "tz"))})


SQL_ZONED = f"WITH z AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE ({SQL_ZONE}) AS lt FROM events)"


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query("agg_daily_extremes", SQL_ZONED + """
SELECT user_id, CAST(CAST(lt AS DATE) AS VARCHAR) AS d, max(value) AS top, count(*) AS n,
 round(avg(value) FILTER (WHERE hour(lt) BETWEEN 12 AND 14), 6) AS noon, round(avg(value) FILTER (WHERE hour(lt) BETWEEN 6 AND 9), 6) AS morning,
 round(avg(value) FILTER (WHERE hour(lt) < 6), 6) AS dawn FROM z GROUP BY 1,2""")
def _(t):
    h, v = F.col("local_hour"), F.col("value")
    return zoned(t).groupBy("user_id", F.col("local_day").cast("string").alias("d")).agg(
        F.max(v).alias("top"), F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(h.between(12, 14), v)), "noon"),
        r6(F.avg(F.when(h.between(6, 9), v)), "morning"), r6(F.avg(F.when(h < 6, v)), "dawn"),
    )


@query("agg_daily_effective_max", SQL_ZONED + """
SELECT user_id, CAST(CAST(lt AS DATE) AS VARCHAR) AS d, CAST(round(max(greatest(value, CASE WHEN event_type='view' THEN value * 1.8 + 32 END))) AS BIGINT) AS eff_max
FROM z GROUP BY 1,2 HAVING count(*) >= 2""")
def _(t):
    extra = F.when(F.col("event_type") == "view", F.col("value") * 1.8 + 32)
    daily = zoned(t).groupBy("user_id", F.col("local_day").cast("string").alias("d")).agg(
        F.round(F.max(F.greatest(F.col("value"), extra))).cast("long").alias("eff_max"), F.count(F.lit(1)).alias("n")
    )
    return daily.filter("n >= 2").drop("n")


@query("agg_daily_forecast_max", SQL_ZONED + """
SELECT user_id, CAST(CAST(lt AS DATE) AS VARCHAR) AS d, max(value) AS pred, count(*) AS n FROM z WHERE hour(ts) <= 12 AND event_type <> 'error' GROUP BY 1,2""")
def _(t):
    morning = zoned(t).filter((F.hour("ts") <= 12) & (F.col("event_type") != "error"))
    return morning.groupBy("user_id", F.col("local_day").cast("string").alias("d")).agg(
        F.max("value").alias("pred"), F.count(F.lit(1)).alias("n")
    )


@query("agg_filtered", """
SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag='R') AS n_ret, round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS usd_disc,
 max(l_quantity) FILTER (WHERE l_linestatus='O') AS max_open FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
        F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), 2).alias("usd_disc"),
        F.max(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("max_open"),
    )


@query("agg_distinct", """
SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers")
    )


@query("agg_argmax", LADDER + """
SELECT ladder_id, idx, px, qty FROM ladder QUALIFY row_number() OVER (PARTITION BY ladder_id ORDER BY px DESC, idx) = 1""")
def _(t):
    return rungs.favorite(ladder(t), ["ladder_id"], "idx", "px", "qty")


_Q = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


@query("agg_quantiles", "SELECT event_type, " + ", ".join(
    f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in _Q.items()) + " FROM events GROUP BY 1")
def _(t):
    out = exact_quantiles(t.events.select("event_type", "value"), ["event_type"], "value", _Q)
    return out.select("event_type", *[r6(n, n) for n in _Q])


@query("agg_moments", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_px, round(stddev_samp(l_extendedprice), 4) AS sd_px,
 round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1,2""")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_px"),
        F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd_px"), r6(F.corr("l_quantity", "l_extendedprice"), "r"),
    )


_EDGES = [10.0, 25.0, 50.0, 100.0, 200.0]
_BANDS = ["1:[0-10)", "2:[10-25)", "3:[25-50)", "4:[50-100)", "5:[100-200)", "6:[200+)"]
_SQL_BAND = "CASE " + " ".join(f"WHEN value < {e} THEN '{b}'" for e, b in zip(_EDGES, _BANDS)) + f" ELSE '{_BANDS[-1]}' END"


@query("agg_histogram", f"SELECT event_type, {_SQL_BAND} AS band, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1,2")
def _(t):
    return t.events.groupBy("event_type", pricing.bands("value", _EDGES, _BANDS).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean_value")
    )


@query("agg_pivot_rank", LADDER + """, r AS (SELECT *, row_number() OVER (PARTITION BY ladder_id ORDER BY px DESC, idx) AS rk FROM ladder)
SELECT ladder_id, max(px) FILTER (WHERE rk=1) AS px_1, max(px) FILTER (WHERE rk=2) AS px_2, max(px) FILTER (WHERE rk=3) AS px_3,
 max(px) FILTER (WHERE rk=4) AS px_4, max(idx) FILTER (WHERE rk=1) AS idx_1 FROM r GROUP BY 1""")
def _(t):
    w = Window.partitionBy("ladder_id").orderBy(F.desc("px"), "idx")
    ranked = ladder(t).withColumn("rk", F.row_number().over(w)).filter("rk <= 4")
    return ranked.groupBy("ladder_id").agg(
        *[F.max(F.when(F.col("rk") == k, F.col("px"))).alias(f"px_{k}") for k in (1, 2, 3, 4)],
        F.max(F.when(F.col("rk") == 1, F.col("idx"))).alias("idx_1"),
    )


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("agg_pivot_unstack", "SELECT CAST(hour(ts) AS BIGINT) AS hr, " + ", ".join(
    f"round(avg(value) FILTER (WHERE event_type='{k}'), 6) AS {k}" for k in _TYPES) + " FROM events GROUP BY 1")
def _(t):
    wide = t.events.groupBy(F.hour("ts").cast("long").alias("hr")).pivot("event_type", _TYPES).agg(F.avg("value"))
    return wide.select("hr", *[r6(k, k) for k in _TYPES])


@query("agg_pivot_path", """
WITH m AS (SELECT date_trunc('hour', ts) AS h, event_type, avg(value) AS p FROM events GROUP BY 1,2)
SELECT epoch_us(h) AS h_us, """ + ", ".join(f"round(max(p) FILTER (WHERE event_type='{k}'), 6) AS {k}" for k in _TYPES) + """,
 round(sum(p), 6) AS total, arg_max(event_type, p) AS fav FROM m GROUP BY h""")
def _(t):
    m = t.events.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").agg(F.avg("value").alias("p"))
    return m.groupBy("h").agg(
        *[F.round(F.max(F.when(F.col("event_type") == k, F.col("p"))), 6).alias(k) for k in _TYPES],
        r6(F.sum("p"), "total"), F.max_by("event_type", F.struct("p", "event_type")).alias("fav"),
    ).select(us("h"), *_TYPES, "total", "fav")


@query("agg_time_profile", """
SELECT CAST((hour(ts) * 60 + minute(ts)) % 120 AS BIGINT) AS cycle_minute, count(*) AS n, round(sum(value), 2) AS usd, count(DISTINCT user_id) AS users
FROM events GROUP BY 1""")
def _(t):
    minute = F.pmod(F.hour("ts") * 60 + F.minute("ts"), F.lit(120)).cast("long")
    return t.events.groupBy(minute.alias("cycle_minute")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("usd"), F.count_distinct("user_id").alias("users")
    )


@query("agg_bar_last", """
SELECT event_type, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS bar_s, arg_max(value, ts) AS close_px, count(*) AS n FROM events GROUP BY 1,2""")
def _(t):
    bars = bar_last(ev(t), ["event_type"], "ts", ["event_id"], "value", 900)
    return bars.select("event_type", F.unix_seconds("bar").alias("bar_s"), F.col("value").alias("close_px"), "n")


@query("agg_minute_mean", """
WITH m AS (SELECT user_id, date_trunc('minute', ts) AS m, avg(value) AS p FROM events GROUP BY 1,2)
SELECT user_id, CAST(CAST(m AS DATE) AS VARCHAR) AS d, round(avg(p) FILTER (WHERE hour(m) < 12), 6) AS before, round(avg(p) FILTER (WHERE hour(m) >= 12), 6) AS after,
 round(max(p), 6) AS peak, round(max(p) / nullif(avg(p) FILTER (WHERE hour(m) < 12), 0) - 1, 6) AS rel_move FROM m GROUP BY 1,2""")
def _(t):
    m = t.events.groupBy("user_id", F.date_trunc("minute", "ts").alias("m")).agg(F.avg("value").alias("p"))
    early = F.avg(F.when(F.hour("m") < 12, F.col("p")))
    return m.groupBy("user_id", F.to_date("m").cast("string").alias("d")).agg(
        r6(early, "before"), r6(F.avg(F.when(F.hour("m") >= 12, F.col("p"))), "after"), r6(F.max("p"), "peak"),
        r6(F.try_divide(F.max("p"), early) - 1, "rel_move"),
    )


@query("ladder_sum", """
WITH q AS (SELECT CAST(ts AS DATE) AS d, user_id % 11 AS bucket, arg_max(value, ts) / 600 AS bid, arg_max(value, ts) / 600 + 0.01 AS ask FROM events GROUP BY 1,2)
SELECT CAST(d AS VARCHAR) AS d, count(DISTINCT bucket) AS n_buckets, round(sum(bid), 6) AS sum_bid, round(sum(ask), 6) AS sum_ask,
 round(sum(bid) - 1, 6) AS overround FROM q GROUP BY 1 HAVING count(DISTINCT bucket) >= 9""")
def _(t):
    last = F.max_by("value", F.struct("ts", "event_id"))
    q = ev(t).groupBy(F.to_date("ts").cast("string").alias("d"), (F.col("user_id") % 11).alias("bucket")).agg(
        (last / 600).alias("bid"), (last / 600 + 0.01).alias("ask"))
    out = rungs.ladder_sums(q, ["d"], "bucket", "bid", "ask", 9)
    return out.select("d", "n_buckets", *[r6(c, c) for c in ("sum_bid", "sum_ask", "overround")])


@query("ladder_shape", LADDER + """, s AS (SELECT *, px / sum(px) OVER (PARTITION BY ladder_id) AS p,
 dense_rank() OVER (PARTITION BY ladder_id ORDER BY px DESC) AS dr FROM ladder)
SELECT ladder_id, count(*) AS n, round(-sum(p * log2(p + 1e-12)), 6) AS entropy, round(sum(p * p), 6) AS concentration,
 count(*) FILTER (WHERE px >= 20000) AS n_visible, round(max(px) / max(px) FILTER (WHERE dr = 2), 6) AS peak_ratio FROM s GROUP BY 1""")
def _(t):
    out = rungs.ladder_shape(ladder(t), ["ladder_id"], "px", visible=20000)
    entropy = F.round("entropy", 6)
    return out.select("ladder_id", "n", F.when(entropy == 0, 0.0).otherwise(entropy).alias("entropy"),
                      r6("concentration", "concentration"), "n_visible", r6("peak_ratio", "peak_ratio"))


@query("ladder_fresh_sum", """
WITH e AS (SELECT user_id % 11 AS bucket, ts, value FROM events),
p AS (SELECT DISTINCT CAST(ts AS DATE) AS d, bucket, CAST(ts AS DATE) + INTERVAL 18 HOUR AS at FROM e),
j AS (SELECT p.d, p.bucket, e.value / 600 AS px, (epoch_us(p.at) - epoch_us(e.ts)) / 1e6 AS age FROM p ASOF JOIN e ON p.bucket = e.bucket AND p.at >= e.ts)
SELECT CAST(d AS VARCHAR) AS d, max_age, count(*) FILTER (WHERE age <= max_age) AS n_fresh, round(sum(px) FILTER (WHERE age <= max_age), 6) AS fresh_sum
FROM j CROSS JOIN (VALUES (900),(3600),(21600)) v(max_age) GROUP BY 1,2""")
def _(t):
    e = ev(t).withColumn("bucket", F.col("user_id") % 11)
    p = e.select(F.to_date("ts").alias("d"), "bucket").distinct().withColumn("at", F.col("d").cast("timestamp") + F.expr("INTERVAL 18 HOURS"))
    j = asof_join(p, e, ["bucket"], "at", "ts", {"px": "value", "qt": "ts"}, seq=["event_id"], how="inner")
    j = j.withColumns({"age": (F.unix_micros("at") - F.unix_micros("qt")) / 1e6, "px": F.col("px") / 600})
    out = rungs.fresh_sums(j, ["d"], "px", "age", [900, 3600, 21600])
    return out.select(F.col("d").cast("string").alias("d"), "max_age", "n_fresh", r6("fresh_sum", "fresh_sum"))


@query("orderflow_net", """
SELECT user_id, count(*) FILTER (WHERE event_type='click') - count(*) FILTER (WHERE event_type='view') AS net_flow,
 round(sum(CASE event_type WHEN 'click' THEN value WHEN 'view' THEN -value ELSE 0 END), 4) AS net_usd FROM events GROUP BY 1""")
def _(t):
    k, v = F.col("event_type"), F.col("value")
    sign = F.when(k == "click", 1).when(k == "view", -1).otherwise(0)
    return t.events.groupBy("user_id").agg(F.sum(sign).alias("net_flow"), F.round(F.sum(sign * v), 4).alias("net_usd"))


@query("participant_pnl", """
SELECT c_custkey, c_mktsegment, count(*) AS fills, round(sum(l_extendedprice), 2) AS usd, count(DISTINCT l_partkey) AS markets, count(DISTINCT l_shipdate) AS days,
 round(sum(l_extendedprice) FILTER (WHERE l_returnflag='R'), 2) AS usd_win, round(avg(CASE WHEN l_returnflag='R' THEN 1.0 ELSE 0.0 END), 6) AS win_share
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey GROUP BY 1,2 ORDER BY usd DESC, c_custkey LIMIT 100""")
def _(t):
    owners = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(t.customer.select("c_custkey"), "c_custkey", "left_semi")
    fills = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_shipdate", "l_extendedprice", "l_returnflag").join(owners, "o_orderkey")
    usd = F.round(F.sum("l_extendedprice"), 2).alias("usd")
    # Volume first: the distinct counts are then taken for the hundred largest participants only.
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("l_extendedprice"))
    top = per_order.join(owners, "o_orderkey").groupBy("c_custkey").agg(usd).orderBy(F.desc("usd"), "c_custkey").limit(100).select("c_custkey")
    won = F.col("l_returnflag") == "R"
    detail = fills.join(F.broadcast(top), "c_custkey").groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("fills"), usd, F.count_distinct("l_partkey").alias("markets"), F.count_distinct("l_shipdate").alias("days"),
        F.round(F.sum(F.when(won, F.col("l_extendedprice"))), 2).alias("usd_win"), r6(F.avg(won.cast("double")), "win_share"),
    )
    return detail.join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")


@query("spread_by_regime", """
WITH q AS (SELECT CASE WHEN l_extendedprice < 20000 THEN 'low' WHEN l_extendedprice < 60000 THEN 'mid' ELSE 'high' END AS regime,
 l_extendedprice * l_discount / 1000 AS spread FROM lineitem)
SELECT regime, count(*) AS n, round(avg(spread), 6) AS mean_spread, round(quantile_cont(spread, 0.5), 6) AS median_spread, round(quantile_cont(spread, 0.95), 6) AS p95_spread
FROM q GROUP BY 1""")
def _(t):
    px = F.col("l_extendedprice")
    q = t.lineitem.select(pricing.bands(px, [20000.0, 60000.0], ["low", "mid", "high"]).alias("regime"),
                          (px * F.col("l_discount") / 1000).alias("spread"))
    means = q.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("spread"), "mean_spread"))
    quant = exact_quantiles(q, ["regime"], "spread", {"median_spread": 0.5, "p95_spread": 0.95})
    return means.join(quant, "regime").select("regime", "n", "mean_spread", *[r6(c, c) for c in ("median_spread", "p95_spread")])


@query("quote_fingerprint", """
WITH b AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type='click') AS nb, count(*) FILTER (WHERE event_type='view') AS na,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hrs,
  count(*) FILTER (WHERE abs(value - round_even(value, 0)) > 0.001) AS frac,
  count(*) FILTER (WHERE abs(value - round_even(value, 0)) <= 0.001 AND round_even(value, 0) IN (5,10,15,20,25,30,40,50,60,75,100,125,150,200,250,500,1000)) AS rnd,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1)
SELECT user_id, n, round(n / nullif(hrs, 0), 6) AS per_hour, round(least(nb, na) / nullif(greatest(nb, na), 0), 6) AS two_sided,
 round(frac / n, 6) AS fractional, round(rnd / n, 6) AS round_lots, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM b""")
def _(t):
    e = t.events.select("user_id", "ts", "event_type", "value").withColumn("sz", pricing.size_class("value"))
    nb, na = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")
    n = F.count(F.lit(1))
    hours = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9
    base = e.groupBy("user_id").agg(
        n.alias("n"), r6(F.try_divide(n, hours), "per_hour"), r6(F.try_divide(F.least(nb, na), F.greatest(nb, na)), "two_sided"),
        r6(F.count_if(F.col("sz") == "fractional") / n, "fractional"), r6(F.count_if(F.col("sz") == "round") / n, "round_lots"),
    )
    q = exact_quantiles(e, ["user_id"], "value", {"p50": 0.5, "p90": 0.9})
    return base.join(q, "user_id").select(*base.columns, r6("p50", "p50"), r6("p90", "p90"))


def books(t):
    """Books on the driver tables: negative components are bids, the others asks, size grows with distance."""
    level = lambda x: F.struct(F.abs(x.cast("double")).alias("price"), (F.abs(x.cast("double")) * 100 + 1).alias("size"))
    return t.embeddings.select(
        "vec_id", F.transform(F.filter("embedding", lambda x: x < 0), level).alias("bids"),
        F.transform(F.filter("embedding", lambda x: x >= 0), level).alias("asks"),
    )


SQL_BOOKS = """WITH b AS (SELECT vec_id, [CAST(-x AS DOUBLE) FOR x IN embedding IF x < 0] AS bids, [CAST(x AS DOUBLE) FOR x IN embedding IF x >= 0] AS asks FROM embeddings)"""


@query("top_book", SQL_BOOKS + """
SELECT vec_id, round(list_max(bids), 6) AS best_bid, round(list_min(asks), 6) AS best_ask, round((list_max(bids) + list_min(asks)) / 2, 6) AS mid,
 round(list_min(asks) - list_max(bids), 6) AS spread, CAST(len(bids) AS INT) AS n_bid, CAST(len(asks) AS INT) AS n_ask FROM b""")
def _(t):
    bid, ask = pricing.best_bid("bids"), pricing.best_ask("asks")
    return books(t).select(
        "vec_id", r6(bid, "best_bid"), r6(ask, "best_ask"), r6(pricing.mid(bid, ask), "mid"), r6(pricing.spread(bid, ask), "spread"),
        pricing.level_count("bids").alias("n_bid"), pricing.level_count("asks").alias("n_ask"),
    )


@query("book_depth_within", SQL_BOOKS + """
SELECT vec_id, """ + ", ".join(
    f"round(list_sum([x * 100 + 1 FOR x IN bids IF x >= list_max(bids) - {d} - 1e-9]), 4) AS bid_{n}" for n, d in (("0", 0), ("2", 0.02), ("5", 0.05))
) + """, round(list_sum([x * (x * 100 + 1) FOR x IN bids IF x >= list_max(bids) - 0.05 - 1e-9]), 4) AS bid_usd_5 FROM b WHERE len(bids) > 0""")
def _(t):
    b = books(t).filter(F.size("bids") > 0)
    near = F.filter("bids", lambda x: x["price"] >= pricing.best_bid("bids") - 0.05 - 1e-9)
    usd = F.aggregate(near, F.lit(0.0), lambda a, x: a + x["price"] * x["size"])
    return b.select("vec_id", *[F.round(pricing.bid_depth_within("bids", d), 4).alias(f"bid_{n}") for n, d in (("0", 0.0), ("2", 0.02), ("5", 0.05))],
                    F.round(usd, 4).alias("bid_usd_5"))


@query("book_takeable", SQL_BOOKS + """
SELECT vec_id, round(coalesce(list_sum([x * 100 + 1 FOR x IN asks IF x <= 0.22]), 0), 4) AS takeable FROM b""")
def _(t):
    return books(t).select("vec_id", F.round(pricing.takeable("asks", F.lit(0.22)), 4).alias("takeable"))


@query("book_walk", """
WITH l AS (SELECT l_partkey, l_discount * 100 + l_linenumber AS price, sum(l_quantity) AS size FROM lineitem GROUP BY 1,2),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY l_partkey ORDER BY price DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
w AS (SELECT c.*, n.target, greatest(0, least(size, n.target - before)) AS take FROM c CROSS JOIN (VALUES (20.0),(100.0),(500.0)) n(target))
SELECT l_partkey, CAST(target AS DOUBLE) AS target, sum(take) AS filled, round(sum(take * 0.05 * price / 20 * (1 - price / 20)), 6) AS fee,
 round(sum(take * price) / sum(take), 6) AS avg_price FROM w GROUP BY 1,2""")
def _(t):
    levels = t.lineitem.groupBy("l_partkey", (F.col("l_discount") * 100 + F.col("l_linenumber")).alias("price")).agg(
        F.sum("l_quantity").alias("size"))
    out = rungs.book_walk(levels, ["l_partkey"], "price", "size", [20, 100, 500], fee_price=F.col("price") / 20)
    return out.select("l_partkey", "target", "filled", F.round("fee", 6).alias("fee"), r6("avg_price", "avg_price"))


TRADES = """WITH tr AS (SELECT l_orderkey, l_shipdate, l_returnflag AS fold, l_linestatus AS city, l_discount + 0.2 AS price,
 CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS won FROM lineitem),
t AS (SELECT *, won - price - 0.05 * price * (1 - price) AS pnl FROM tr)"""


def trades(t):
    """Trades on the driver tables: price from the discount, won when the quantity is above 25."""
    base = t.lineitem.select(
        "l_orderkey", "l_shipdate", F.col("l_returnflag").alias("fold"), F.col("l_linestatus").alias("city"),
        (F.col("l_discount") + 0.2).alias("price"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("won"),
    )
    return base.withColumn("pnl", pricing.trade_pnl("price", "won"))


_STATS = """count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl <= 0) AS losses, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit,
 round(avg(pnl), 6) AS per_trade, round(sum(pnl), 4) AS total, round(avg(pnl) / (stddev_samp(pnl) / sqrt(count(*))), 4) AS t"""


def rounded_stats(df, *by):
    return df.select(*by, "n", "wins", "losses", r6("hit", "hit"), r6("per_trade", "per_trade"), F.round("total", 4).alias("total"),
                     F.round("t", 4).alias("t"))


@query("trade_stats", TRADES + f" SELECT fold, city, {_STATS} FROM t GROUP BY 1,2")
def _(t):
    return rounded_stats(stats.trade_stats(trades(t), ["fold", "city"]), "fold", "city")


@query("group_rollup_report", TRADES + f""", w AS (SELECT *, CAST(year(l_shipdate) AS BIGINT) AS yr FROM t)
SELECT fold, city, yr, {_STATS} FROM w GROUP BY GROUPING SETS ((), (fold), (city), (yr))""")
def _(t):
    yearly = trades(t).withColumn("yr", F.year("l_shipdate").cast("long"))
    return rounded_stats(stats.rollup_report(yearly, ["fold", "city", "yr"]), "fold", "city", "yr")


@query("daily_risk", TRADES + """, d AS (SELECT fold, l_shipdate, sum(pnl) AS p, sum(price) AS c FROM t GROUP BY 1,2)
SELECT fold, count(*) AS days, count(*) FILTER (WHERE p > 0) AS positive_days, round(avg(p) / stddev_samp(p), 6) AS daily_sharpe,
 round(avg(p) / stddev_samp(p) * sqrt(252), 4) AS annual_sharpe, round(sum(p) / sum(c), 6) AS return_on_capital FROM d GROUP BY 1""")
def _(t):
    out = stats.daily_risk(trades(t), "l_shipdate", "pnl", "price", ["fold"])
    return out.select("fold", "days", "positive_days", r6("daily_sharpe", "daily_sharpe"), F.round("annual_sharpe", 4).alias("annual_sharpe"),
                      r6("return_on_capital", "return_on_capital"))


@query("fixed_stake_pnl", TRADES + """, s AS (SELECT fold, 10 * pnl / price AS p FROM t),
o AS (SELECT fold, p, row_number() OVER (PARTITION BY fold ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM s)
SELECT fold, count(*) AS n, count(*) FILTER (WHERE p > 0) AS wins, round(avg(p), 6) AS mean_pnl, round(max(p) FILTER (WHERE i = n // 2), 6) AS median_pnl,
 round(max(p), 6) AS best, round(min(p), 6) AS worst, round(sum(p), 2) AS total, round(sum(p) / (10 * count(*)), 6) AS on_stake FROM o GROUP BY 1""")
def _(t):
    s = trades(t).select("fold", (F.lit(10) * F.col("pnl") / F.col("price")).alias("p"))
    n = F.count(F.lit(1))
    base = s.groupBy("fold").agg(
        n.alias("n"), F.count_if(F.col("p") > 0).alias("wins"), r6(F.avg("p"), "mean_pnl"), r6(F.max("p"), "best"), r6(F.min("p"), "worst"),
        F.round(F.sum("p"), 2).alias("total"), r6(F.sum("p") / (n * 10), "on_stake"),
    )
    median = exact_quantiles(s, ["fold"], "p", {"median_pnl": 0.5}, method="higher")
    return base.join(median, "fold").withColumn("median_pnl", F.round("median_pnl", 6))


@query("pnl_concentration", """
WITH c AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS pnl FROM orders GROUP BY 1), k AS (SELECT * FROM c ORDER BY pnl DESC, o_custkey LIMIT 10)
SELECT o_custkey, pnl, round(sum(pnl) OVER (ORDER BY pnl DESC, o_custkey ROWS UNBOUNDED PRECEDING) / (SELECT sum(pnl) FROM c), 6) AS cum_share FROM k""")
def _(t):
    bets = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("pnl"))
    total = bets.agg(F.sum("pnl")).scalar()
    top = bets.orderBy(F.desc("pnl"), "o_custkey").limit(10)
    # Ten rows are left, so a window without partitions is harmless.
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("pnl"), "o_custkey").rowsBetween(Window.unboundedPreceding, 0)
    return top.select("o_custkey", "pnl", F.sum("pnl").over(w).alias("c")).select("o_custkey", "pnl", r6(F.col("c") / total, "cum_share"))


@query("rejection_counts", LADDER + """, g AS (SELECT ladder_id, count(*) AS n, max(px) AS top, sum(px) AS s FROM ladder GROUP BY 1)
SELECT CASE WHEN n < 3 THEN 'too few buckets' WHEN top < 30000 THEN 'price floor' WHEN top / s > 0.6 THEN 'too peaked' ELSE 'kept' END AS reason, count(*) AS n FROM g GROUP BY 1""")
def _(t):
    g = ladder(t).groupBy("ladder_id").agg(F.count(F.lit(1)).alias("n"), F.max("px").alias("top"), F.sum("px").alias("s"))
    reason = F.when(F.col("n") < 3, "too few buckets").when(F.col("top") < 30000, "price floor").when(
        F.col("top") / F.col("s") > 0.6, "too peaked").otherwise("kept")
    return g.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("capacity_daily", """
WITH b AS (SELECT l_shipdate, l_returnflag, min(l_extendedprice) AS best FROM lineitem GROUP BY 1,2),
d AS (SELECT l.l_shipdate, l.l_returnflag, sum(l_quantity) FILTER (WHERE l_extendedprice <= best * 1.2) AS near, sum(l_quantity) FILTER (WHERE l_extendedprice <= best * 5) AS wide,
 sum(l_extendedprice) FILTER (WHERE l_extendedprice <= best * 5) AS usd FROM lineitem l JOIN b ON b.l_shipdate=l.l_shipdate AND b.l_returnflag=l.l_returnflag GROUP BY 1,2),
p AS (SELECT l_shipdate, sum(near) AS near, sum(wide) AS wide, sum(usd) AS usd FROM d GROUP BY 1)
SELECT count(*) AS days, round(avg(near), 6) AS mean_near, round(quantile_cont(near, 0.5), 6) AS p50_near, round(quantile_cont(wide, 0.1), 6) AS p10_wide,
 round(quantile_cont(wide, 0.9), 6) AS p90_wide, round(avg(usd), 2) AS mean_usd FROM p""")
def _(t):
    li = t.lineitem.select("l_shipdate", "l_returnflag", "l_extendedprice", "l_quantity")
    px, q = F.col("l_extendedprice"), F.col("l_quantity")
    # Price points first; the best price of a book is a total over it, carried range by range so that a
    # busy day is never held in one task.
    points = li.groupBy("l_shipdate", "l_returnflag", "l_extendedprice").agg(F.sum("l_quantity").alias("l_quantity"), F.count(F.lit(1)).alias("k"))
    keys = ["l_shipdate", "l_returnflag"]
    priced = running(points, keys, ["l_extendedprice"], best=("total_min", px))
    per_day = priced.groupBy("l_shipdate").agg(
        F.sum(F.when(px <= F.col("best") * 1.2, q)).alias("near"), F.sum(F.when(px <= F.col("best") * 5, q)).alias("wide"),
        F.sum(F.when(px <= F.col("best") * 5, px * F.col("k"))).alias("usd"))
    per_day = stage(per_day, "per_day")
    means = per_day.agg(F.count(F.lit(1)).alias("days"), r6(F.avg("near"), "mean_near"), F.round(F.avg("usd"), 2).alias("mean_usd"))
    near = exact_quantiles(per_day, [], "near", {"p50_near": 0.5})
    wide = exact_quantiles(per_day, [], "wide", {"p10_wide": 0.1, "p90_wide": 0.9})
    return means.withColumns({
        "p50_near": F.round(near.scalar(), 6), "p10_wide": F.round(wide.select("p10_wide").scalar(), 6),
        "p90_wide": F.round(wide.select("p90_wide").scalar(), 6)})


@query("error_metrics", """
WITH f AS (SELECT event_type, value AS actual, avg(value) OVER (PARTITION BY event_type) AS m1, event_id % 97 AS m2, 50.0 AS m3 FROM events),
l AS (SELECT event_type, 'group mean' AS model, m1 AS pred, actual FROM f UNION ALL SELECT event_type, 'counter', m2, actual FROM f UNION ALL SELECT event_type, 'constant', m3, actual FROM f)
SELECT event_type, model, count(*) AS n, round(avg(abs(pred-actual)), 6) AS mae, round(sqrt(avg((pred-actual)*(pred-actual))), 6) AS rmse, round(avg(pred-actual), 6) AS bias,
 round(stddev_pop(pred-actual), 6) AS sd, round(avg(CASE WHEN abs(pred-actual) <= 1 THEN 1.0 ELSE 0 END), 6) AS within_1, round(avg(CASE WHEN abs(pred-actual) <= 5 THEN 1.0 ELSE 0 END), 6) AS within_5,
 round(max(abs(pred-actual)), 6) AS max_error, round(quantile_cont(abs(pred-actual), 0.5), 6) AS median_error FROM l GROUP BY 1,2""")
def _(t):
    e = t.events.select("event_id", "event_type", "value")
    # Group totals are small: the join is left to the size estimate, so that the rows need not move.
    means = e.groupBy("event_type").agg((F.sum("value") / F.count(F.lit(1))).alias("m1"))
    wide = e.join(means, "event_type").withColumns({"m2": F.col("event_id") % 97, "m3": F.lit(50.0)})
    long = stats.unpivot_models(wide, ["event_type", "value"], {"group mean": "m1", "counter": "m2", "constant": "m3"})
    long = long.withColumn("abs_error", F.abs(F.col("pred") - F.col("value")))
    m = stats.error_metrics(long, ["event_type", "model"], "pred", "value")
    med = exact_quantiles(long, ["event_type", "model"], "abs_error", {"median_error": 0.5})
    names = ["mae", "rmse", "bias", "sd", "within_1", "within_5", "max_error", "median_error"]
    return m.join(med, ["event_type", "model"]).select(
        "event_type", "model", "n", *[F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6)).alias(c) for c in names])


@query("calibration_table", """
WITH p AS (SELECT least(n_chars / 4000.0, 1.0) AS p, quality AS y FROM documents JOIN labels USING (doc_id)),
m AS (SELECT min(p) AS lo, max(p) AS hi FROM p)
SELECT CAST(greatest(1, ceil((p - lo) / (hi - lo) * 10)) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM p, m GROUP BY 1""")
def _(t):
    p = t.documents.select("doc_id", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("p")).join(t.labels.select("doc_id", "quality"), "doc_id")
    return stats.equal_width_bin(p, "p", 10).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("p"), "mean_p"), r6(F.avg("quality"), "observed"))


def tall_path(t):
    path = bucket_path(t)
    win = path.groupBy("d").agg(F.max_by("bucket", F.struct("score", -F.col("bucket"))).alias("winner"))
    return path.select("d", "bucket", "score", F.inline(F.array(*[
        F.struct(F.lit(h).cast("long").alias("h"), F.col(f"p{h}").alias("p")) for h in ANCHOR_HOURS]))).join(win, "d")


@query("brier_score", BUCKET_PATH + """
SELECT CAST(h AS BIGINT) AS h, bucket % 2 = 0 AS even_kind, count(*) AS n, round(avg(power(least(p / 300, 1) - CASE WHEN bucket = winner THEN 1 ELSE 0 END, 2)), 6) AS brier
FROM path JOIN win USING (d) WHERE p IS NOT NULL GROUP BY 1,2""")
def _(t):
    y = F.when(F.col("bucket") == F.col("winner"), 1).otherwise(0)
    err = F.least(F.col("p") / 300, F.lit(1.0)) - y
    return tall_path(t).filter("p IS NOT NULL").groupBy("h", (F.col("bucket") % 2 == 0).alias("even_kind")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(err * err), "brier"))


@query("reaction_fraction", BUCKET_PATH + """,
w AS (SELECT d, bucket, any_value(score) AS score, max(p) FILTER (WHERE h=6) AS p0, max(p) FILTER (WHERE h=12) AS p1, max(p) FILTER (WHERE h=24) AS p2 FROM path GROUP BY 1,2),
f AS (SELECT (p1 - p0) / (score - p0) AS f1, (p2 - p0) / (score - p0) AS f2 FROM w WHERE p0 IS NOT NULL AND abs(score - p0) > 1)
SELECT count(*) AS n, round(avg(f1), 6) AS mean_12h, round(avg(f2), 6) AS mean_24h, round(quantile_cont(f1, 0.5), 6) AS median_12h, round(quantile_cont(f2, 0.5), 6) AS median_24h FROM f""")
def _(t):
    w = bucket_path(t).filter(F.col("p6").isNotNull() & (F.abs(F.col("score") - F.col("p6")) > 1))
    gap = F.col("score") - F.col("p6")
    f = w.select(*[F.try_divide(F.col(f"p{h}") - F.col("p6"), gap).alias(f"f{h}") for h in (12, 24)])
    means = f.agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(f"f{h}"), f"mean_{h}h") for h in (12, 24)])
    return means.withColumns({
        f"median_{h}h": F.round(exact_quantiles(f, [], f"f{h}", {"m": 0.5}).scalar(), 6) for h in (12, 24)})


@query("mispricing_surface", LADDER + """,
g AS (SELECT ladder_id, arg_max(idx, px * 100 - idx * 0.001) AS fav, arg_max(idx, qty * 100 - idx * 0.001) AS win, sum(px) AS s FROM ladder GROUP BY 1),
r AS (SELECT o_orderpriority AS city, l.idx - g.fav AS off, l.px / g.s AS p, CASE WHEN l.idx = g.win THEN 1 ELSE 0 END AS y
 FROM ladder l JOIN g USING (ladder_id) JOIN orders ON o_orderkey = l.ladder_id)
SELECT city, CAST(off AS INT) AS off, count(*) AS n, round(avg(p), 6) AS implied, round(avg(y), 6) AS realised, round(avg(y) - avg(p), 6) AS gap,
 round(avg(y - p - 0.05 * p * (1 - p)), 6) AS long_pnl, round(avg((1 - y) - (1 - p) - 0.05 * p * (1 - p)), 6) AS short_pnl FROM r GROUP BY 1,2 HAVING count(*) >= 5""")
def _(t):
    rows = ladder(t)
    g = rows.groupBy("ladder_id").agg(
        F.max_by("idx", F.struct("px", -F.col("idx"))).alias("fav"), F.max_by("idx", F.struct("qty", -F.col("idx"))).alias("win"), F.sum("px").alias("s"))
    city = t.orders.select(F.col("o_orderkey").alias("ladder_id"), F.col("o_orderpriority").alias("city"))
    r = rows.join(g, "ladder_id").join(city, "ladder_id").select(
        "city", (F.col("idx") - F.col("fav")).alias("off"), (F.col("px") / F.col("s")).alias("p"),
        F.when(F.col("idx") == F.col("win"), 1).otherwise(0).alias("y"))
    p, y = F.col("p"), F.col("y")
    return r.groupBy("city", "off").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(p), "implied"), r6(F.avg(y), "realised"), r6(F.avg(y) - F.avg(p), "gap"),
        r6(F.avg(pricing.trade_pnl(p, y)), "long_pnl"), r6(F.avg(pricing.trade_pnl(1 - p, 1 - y)), "short_pnl")).filter("n >= 5")
