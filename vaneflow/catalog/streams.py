"""Streaming queries: the driver tables are replayed through file streams until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.readers import read_book_messages
from ..streaming import book
from ..streaming.runner import drain, drain_batches, rocksdb, write_slices
from .aggregates import r6
from .joins import us
from .registry import query
from .sources import book_messages
from .windows import ev

EVENTS = "event_id LONG, user_id LONG, event_type STRING, ts TIMESTAMP, value DOUBLE"
SLICES = ("2024-01-08", "2024-01-16", "2024-01-24")


def sliced(t, df=None, bounds=SLICES) -> str:
    path = t.scratch("stream_in")
    write_slices(ev(t) if df is None else df, path, "ts", bounds)
    return path


def stream(t, path: str, schema: str = EVENTS, files: int = 64):
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def result(t, path: str, schema: str):
    return t.spark.read.schema(schema).parquet(path)


@query("sink_event_log", """
SELECT strftime(ts, '%Y-%m-%d') AS utc_date, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def _(t):
    out = t.scratch("log")
    log = stream(t, sliced(t)).withColumn("utc_date", F.date_format("ts", "yyyy-MM-dd"))
    drain(log, out, t.scratch("ckpt"), ["utc_date"], fmt="json")
    back = t.spark.read.schema(EVENTS + ", utc_date STRING").json(out)
    return back.groupBy("utc_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_book_ingest", """
SELECT strftime(ts, '%Y-%m-%d-%H') AS hour, CASE WHEN event_type <> 'view' AND user_id % 2 = 0 THEN 'slug-' || user_id END AS slug, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1,2""")
def _(t):
    raw, out = t.scratch("book"), t.scratch("ingest")
    book_messages(t).write.text(raw)
    users = t.events.select("user_id").distinct().filter("user_id % 2 = 0")
    tokens = users.select(F.concat(F.lit("tok-"), "user_id").alias("asset_id"), F.concat(F.lit("slug-"), "user_id").alias("slug"))
    routed = book.route_messages(read_book_messages(t.spark, raw, streaming=True), tokens)
    routed = routed.select("asset_id", "slug", "event_type", "received_at", "hour", F.substring("hour", 1, 10).alias("day"))
    drain(routed, out, t.scratch("ckpt"), ["day"])
    return result(t, out, "asset_id STRING, slug STRING, event_type STRING, received_at TIMESTAMP, hour STRING, day STRING").groupBy("hour", "slug").agg(F.count(F.lit(1)).alias("n"))


@query("stream_tob", """
WITH b AS (SELECT 'tok-' || user_id AS asset_id, 'book' AS event_type, epoch_us(ts) AS received_us, greatest(round(value / 500, 4), round(value / 600, 4)) AS bid, round(value / 500 + 0.02, 4) AS ask, 2::INT AS nb, 3::INT AS na FROM events WHERE event_type='click'
 UNION ALL SELECT 'tok-' || user_id, 'price_change', epoch_us(ts), round(value / 500, 4), round(value / 500 + 0.01, 4), NULL, NULL FROM events WHERE event_type='view'
 UNION ALL SELECT 'no-' || user_id, 'price_change', epoch_us(ts), round(1 - value / 500, 4), round(1.01 - value / 500, 4), NULL, NULL FROM events WHERE event_type='view')
SELECT asset_id, event_type, received_us, bid AS best_bid, ask AS best_ask, round((bid + ask) / 2, 6) AS mid, round(ask - bid, 6) AS spread, nb AS n_bid_levels, na AS n_ask_levels FROM b""")
def _(t):
    raw, out = t.scratch("book"), t.scratch("tob")
    book_messages(t).write.text(raw)
    drain(book.top_of_book(read_book_messages(t.spark, raw, streaming=True)), out, t.scratch("ckpt"))
    rows = result(t, out, "received_at TIMESTAMP, server_ts TIMESTAMP, event_type STRING, asset_id STRING, best_bid DOUBLE, best_ask DOUBLE, n_bid_levels INT, n_ask_levels INT, mid DOUBLE, spread DOUBLE")
    return rows.select("asset_id", "event_type", us("received_at", "received_us"), "best_bid", "best_ask", r6("mid", "mid"), r6("spread", "spread"), "n_bid_levels", "n_ask_levels")


@query("stream_ladder_alert", """
WITH RECURSIVE q AS (SELECT event_type AS ladder, user_id % 11 AS bucket, ts, event_id, value FROM events),
p AS (SELECT q.ladder, q.ts, q.event_id, b.b FROM q CROSS JOIN (SELECT unnest(range(0, 11)) AS b) b),
j AS (SELECT p.ladder, p.ts, p.event_id, q.value, q.ts AS qts FROM p ASOF JOIN q ON q.ladder = p.ladder AND q.bucket = p.b AND p.ts >= q.ts),
c AS (SELECT ladder, ts, any_value(event_id) AS event_id, round(sum(value), 4) AS sum_bid FROM j GROUP BY ladder, ts HAVING count(*) = 11 AND max(ts - qts) <= INTERVAL 16 HOUR AND round(sum(value), 4) >= 560),
a AS (SELECT ladder, min(ts) AS ts FROM c GROUP BY 1 UNION ALL SELECT x.ladder, x.ts FROM (SELECT a.ladder, (SELECT min(c.ts) FROM c WHERE c.ladder = a.ladder AND c.ts >= a.ts + INTERVAL 10 MINUTE) AS ts FROM a) x WHERE x.ts IS NOT NULL)
SELECT a.ladder, epoch_us(a.ts) AS at_us, c.sum_bid FROM a JOIN c ON c.ladder = a.ladder AND c.ts = a.ts""")
def _(t):
    root = t.scratch("alerts")
    quotes = stream(t, sliced(t)).select(F.col("event_type").alias("ladder"), (F.col("user_id") % 11).alias("bucket"), "ts", F.col("value").alias("bid"), "event_id")
    watch = book.LadderAlerts(t.spark, root, "ladder", "bucket", "ts", "bid", "event_id", n_buckets=11, max_age_seconds=16 * 3600, threshold=560.0, min_gap_seconds=600)
    drain_batches(quotes, watch, t.scratch("ckpt"))
    return t.spark.read.schema("ladder STRING, ts TIMESTAMP, event_id LONG, sum_bid DOUBLE, batch INT").parquet(f"{root}/alerts").select(
        "ladder", us("ts", "at_us"), F.round("sum_bid", 4).alias("sum_bid"))


@query("stream_incremental_features", """
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, max(value) AS top, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1,2""")
def _(t):
    # A slice edge inside a day makes two batches touch the same keys.
    path = sliced(t, bounds=("2024-01-08 09:00:00", "2024-01-16 15:00:00"))
    rows = stream(t, path, files=2).withColumn("d", F.to_date("ts").cast("string"))
    v = F.col("value")
    features = book.MergeableState(t.scratch("features"), ["user_id", "d"], {"top": ("max", v), "n": ("count", v), "total": ("sum", v)}, compact_every=3)
    drain_batches(rows, features, t.scratch("ckpt"))
    return features.read(t.spark).select("user_id", "d", "top", "n", r6(F.col("total") / F.col("n"), "mean_value"))


@query("stream_high_water", """
SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS run, count(*) AS n, epoch_us(max(ts)) AS high_us FROM events GROUP BY 1""")
def _(t):
    path, out, ckpt = t.scratch("stream_in"), t.scratch("landed"), t.scratch("ckpt")
    e = ev(t)
    halves = [e.filter("ts < TIMESTAMP '2024-01-16'"), e.filter("ts >= TIMESTAMP '2024-01-16'")]
    for run, part in enumerate(halves, start=1):
        part.write.mode("append").parquet(path)
        # The checkpoint remembers what was read: the second run lands only the second half.
        drain(stream(t, path).withColumn("run", F.lit(run)), out, ckpt)
    return result(t, out, EVENTS + ", run INT").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("ts")).alias("high_us"))


@query("stream_dedupe", """
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT user_id, ts, value FROM events) GROUP BY 1""")
def _(t):
    # Slices of four days, and a last fetch that overlaps what came before by three: a row is at most that much late.
    path, out = sliced(t, bounds=("2024-01-05", "2024-01-09", "2024-01-13", "2024-01-17", "2024-01-21", "2024-01-25", "2024-01-29")), t.scratch("unique")
    ev(t).filter("ts >= TIMESTAMP '2024-01-29'").write.mode("append").parquet(path)
    unique = stream(t, path, files=4).withWatermark("ts", "7 days").dropDuplicatesWithinWatermark(["user_id", "ts"])
    with rocksdb(t.spark):
        drain(unique, out, t.scratch("ckpt"))
    return result(t, out, EVENTS).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_window_count", """
SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, ts) AS close_px FROM events GROUP BY 1, date_trunc('hour', ts)
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def _(t):
    out = t.scratch("windows")
    counted = stream(t, sliced(t)).withWatermark("ts", "2 hours").groupBy("event_type", F.window("ts", "1 hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("close_px"))
    with rocksdb(t.spark):
        drain(counted.select("event_type", F.col("window.start").alias("start"), "n", "total", "close_px"), out, t.scratch("ckpt"))
    return result(t, out, "event_type STRING, start TIMESTAMP, n LONG, total DOUBLE, close_px DOUBLE").select(
        "event_type", us("start"), "n", F.round("total", 4).alias("total"), "close_px")


@query("stream_session", """
WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n, max(value) AS peak FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    out = t.scratch("sessions")
    runs = stream(t, sliced(t)).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    # session_window ends one gap after the last row.
    with rocksdb(t.spark):
        drain(runs.select("user_id", F.col("s.start").alias("start"), (F.col("s.end") - F.expr("INTERVAL 2 HOURS")).alias("end"), "n", "peak"), out, t.scratch("ckpt"))
    return result(t, out, "user_id LONG, start TIMESTAMP, end TIMESTAMP, n LONG, peak DOUBLE").select("user_id", us("start"), us("end"), "n", "peak")
