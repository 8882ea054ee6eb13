"""Sources and sinks: the driver tables are written in a feed's raw form with Spark, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import plus_hours
from ..sources import readers, sinks
from .joins import of_type, us
from .registry import query
from .scalars import SQL_FILLS, SQL_RAW, raw_fills, raw_text
from .windows import ev


def write_lines(df, path: str, folder: str, *order: str) -> None:
    """Text files with lines in order, one folder per value and at most 100k lines of it per file."""
    out = df.repartition(F.col(folder), F.col("_piece")).sortWithinPartitions(folder, "_piece", *order)
    out.select(folder, "_piece", "value").write.partitionBy(folder, "_piece").text(path)


def csv_feed(t, path: str, columns: dict[str, object], rows, preamble: str, folder: str = "_station") -> None:
    """Each file starts with a comment and a header, then data lines."""
    fields = [F.coalesce(c.cast("string"), F.lit("")) for c in columns.values()]
    data = rows.select(F.col(folder), F.floor(F.col("event_id") / 100_000).alias("_piece"), F.lit(2).alias("_k"), "event_id",
                       F.concat_ws(",", *fields).alias("value"))
    heads = data.select(folder, "_piece").distinct().select(
        "*", F.lit(-1).cast("long").alias("event_id"),
        F.inline(F.array(F.struct(F.lit(0).alias("_k"), F.lit(preamble).alias("value")), F.struct(F.lit(1).alias("_k"), F.lit(",".join(columns)).alias("value")))))
    write_lines(data.unionByName(heads), path, folder, "_k", "event_id")


@query("scan_obs_csv", SQL_RAW + """
SELECT 'S' || (event_id % 5) AS station, epoch_us(date_trunc('minute', ts)) AS valid_us, try_cast(raw AS DOUBLE) AS tmpf, CASE WHEN raw = 'T' THEN 0.0001::DOUBLE ELSE try_cast(raw AS DOUBLE) END AS p01i,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'CLR' END AS skyc1 FROM r""")
def _(t):
    rows = raw_text(t).withColumn("_station", F.col("event_id") % 5)
    path = t.scratch("obs_csv")
    csv_feed(t, path, {
        "station": F.concat(F.lit("S"), "_station"), "valid(UTC)": F.date_format("ts", "yyyy-MM-dd HH:mm"), "tmpf": F.col("raw"), "p01i": F.col("raw"),
        "skyc1": F.when(F.col("event_id") % 4 == 0, "M").otherwise("CLR")}, rows, "#DEBUG: feed")
    obs = readers.read_observations(t.spark, path, ["station", "valid(UTC)", "tmpf", "p01i", "skyc1"])
    return obs.select("station", us("valid"), "tmpf", "p01i", "skyc1")


@query("scan_mos_csv", """
SELECT 'K' || user_id AS station, epoch_us(date_trunc('minute', ts)) AS run_us, epoch_us(date_trunc('minute', ts) + to_hours(event_id % 60)) AS valid_us, event_id % 60 AS lead_hours,
 CASE WHEN event_id % 6 > 0 THEN CAST(floor(value) AS INT) END AS tmp_f FROM events WHERE event_type = 'view'""")
def _(t):
    rows = of_type(t, "view").withColumn("_station", F.col("event_id") % 5)
    run = F.date_trunc("minute", "ts")
    path = t.scratch("mos_csv")
    fmt = "yyyy-MM-dd HH:mm:ss"
    csv_feed(t, path, {"station": F.concat(F.lit("K"), "user_id"), "runtime": F.date_format(run, fmt), "ftime": F.date_format(plus_hours(run, F.col("event_id") % 60), fmt),
                       "tmp_f": F.when(F.col("event_id") % 6 > 0, F.floor("value"))}, rows, "#forecast")
    out = readers.read_forecast_csv(t.spark, path, ["station", "runtime", "ftime", "tmp_f"], ["tmp_f"])
    return out.select("station", us("runtime", "run_us"), us("ftime", "valid_us"), "lead_hours", "tmp_f")


@query("scan_csv_union_by_name", """
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 <> 2 THEN event_type END AS kind, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS who FROM events""")
def _(t):
    path = t.scratch("drift_csv")
    e = t.events.select("event_id", "event_type", "user_id", (F.col("event_id") % 3).alias("_station"))
    kinds = {0: {"id": "event_id", "kind": "event_type"}, 1: {"who": "user_id", "id": "event_id", "kind": "event_type"}, 2: {"id": "event_id", "who": "user_id"}}
    for k, cols in kinds.items():
        csv_feed(t, f"{path}/{k}", {n: F.col(c) for n, c in cols.items()}, e.filter(F.col("_station") == k), "#part")
    return readers.read_csv_union_by_name(t.spark, path).select("id", "kind", "who")


@query("scan_parquet_glob", """
SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS usd FROM orders
WHERE o_orderdate >= DATE '1997-11-01' AND o_orderdate < DATE '1998-03-01' GROUP BY 1,2""")
def _(t):
    root = t.scratch("glob")
    sinks.write_partitioned(sinks.year_month(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderdate"), root, ["year", "month"], ["o_orderdate"])
    tree = readers.read_parquet_tree(t.spark, root, "o_orderkey LONG, o_totalprice DOUBLE, o_orderdate TIMESTAMP, year INT, month INT")
    return tree.filter(sinks.partition_filter("1997-11-01", "1998-02-28")).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("usd"))


@query("scan_market_json", """
SELECT 'm-' || p_partkey AS slug, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 2 END AS n_tokens, CASE WHEN p_partkey % 9 > 0 THEN 'Y' || p_partkey END AS yes_token_id, CASE WHEN p_partkey % 9 > 0 THEN 'N' || p_partkey END AS no_token_id,
 CASE WHEN p_partkey % 4 > 0 THEN round(p_size / 100, 2) END AS p_yes, p_partkey % 11 AS threshold, p_retailprice AS volume_num FROM part""")
def _(t):
    k = F.col("p_partkey")
    tokens = F.to_json(F.array(F.concat(F.lit("Y"), k), F.concat(F.lit("N"), k)))
    price = F.round(F.col("p_size") / 100, 2).cast("string")
    doc = F.to_json(F.struct(
        F.concat(F.lit("m-"), k).alias("slug"), k.cast("string").alias("conditionId"), F.when(k % 9 == 0, "[broken").otherwise(tokens).alias("clobTokenIds"),
        F.when(k % 4 > 0, F.to_json(F.array(price, F.lit("0.5")))).alias("outcomePrices"), (k % 11).cast("string").alias("groupItemThreshold"),
        F.when(k % 2 == 0, F.col("p_retailprice")).alias("volumeNum"), F.col("p_retailprice").cast("string").alias("volume")))
    path = t.scratch("markets")
    # Indented and over several lines, as the feed writes its documents: a list of at most 500 for each file.
    listed = t.part.select(doc.alias("doc"), F.floor(k / 500).alias("piece")).groupBy("piece").agg(F.concat(F.lit("[\n  "), F.array_join(F.collect_list("doc"), ",\n  "), F.lit("\n]")).alias("value"))
    listed.write.partitionBy("piece").text(path)
    m = readers.read_markets(t.spark, path)
    return m.select("slug", F.size("clob_token_ids").alias("n_tokens"), "yes_token_id", "no_token_id", F.get("outcome_prices", F.lit(0)).alias("p_yes"),
                    F.col("group_item_threshold").alias("threshold"), "volume_num")


@query("scan_fills_json", SQL_FILLS + """
SELECT 'm-' || l_suppkey AS slug, outcome, CASE WHEN k IN (1, 2) THEN 'buy' ELSE 'sell' END AS side, count(*) AS n, round(sum(shares), 2) AS shares, round(sum(price * shares), 6) AS usd,
 CAST(min(epoch(l_shipdate)) AS BIGINT) AS first_s FROM f GROUP BY 1, 2, 3""")
def _(t):
    raw = raw_fills(t, "l_suppkey").withColumn("slug", F.concat(F.lit("m-"), "l_suppkey"))
    event = F.struct(F.col("ma").alias("makerAssetId"), F.col("ta").alias("takerAssetId"), F.col("mq").cast("string").alias("makerAmountFilled"),
                     F.col("tq").cast("string").alias("takerAmountFilled"), F.unix_seconds("l_shipdate").cast("string").alias("timestamp"))
    # One document per file, as the feed writes them: a map from token to events.  A market's fills are dealt to as
    # many documents as their number asks for, so that none grows with a hot market.
    pieces = raw.groupBy("slug").agg(F.ceil(F.count(F.lit(1)) / 2_000).cast("int").alias("pieces"))
    placed = raw.join(pieces, "slug").withColumn("piece", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.col("pieces")))
    token = F.when(F.col("ma") == "0", F.col("ta")).otherwise(F.col("ma"))
    per_token = placed.groupBy("slug", "piece", token.alias("token")).agg(F.collect_list(event).alias("events"))
    documents = per_token.groupBy("slug", "piece").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("token", "events")))).alias("value"))
    path = t.scratch("fills")
    # Files bear the slug, so folders need not: a few hundred for each piece however many markets there are.
    folder = F.concat_ws("/", F.col("piece"), F.substring(F.md5("slug"), 1, 2))
    sinks.write_documents(documents.withColumn("folder", folder), path, "folder", "slug", "value")
    k = F.col("s_suppkey")
    markets = t.supplier.select(F.concat(F.lit("m-"), k).alias("slug"), k.cast("string").alias("condition_id"), F.concat(F.lit("Y"), k).alias("yes_token_id"), F.concat(F.lit("N"), k).alias("no_token_id"))
    fills = readers.type_fills(readers.read_fill_documents(t.spark, path), markets)
    return fills.groupBy("slug", "outcome", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("shares"), 2).alias("shares"), F.round(F.sum("usd"), 6).alias("usd"),
                                                        F.unix_seconds(F.min("timestamp")).alias("first_s"))


@query("scan_price_history_json", """
SELECT 'u-' || user_id AS slug, 'hour' AS series, CAST(floor(epoch(ts)) AS BIGINT) AS t_s, value AS p_yes, CAST(floor(epoch(ts)) AS BIGINT) + 60 AS fetched_s FROM events WHERE event_id % 10 > 0
UNION ALL SELECT 'u-' || user_id, 'minute', CAST(floor(epoch(ts)) AS BIGINT), 0.5, CAST(floor(epoch(ts)) AS BIGINT) + 60 FROM events""")
def _(t):
    point = lambda p: F.array(F.struct(F.unix_seconds("ts").alias("t"), p.alias("p")))
    e = t.events
    doc = F.to_json(F.struct(F.concat(F.lit("u-"), F.col("user_id")).alias("slug"), point(F.when(F.col("event_id") % 10 > 0, F.col("value"))).alias("history_max_h60"),
                             point(F.lit(0.5)).alias("history_1d_min1"),
                             F.date_format(F.timestamp_seconds(F.unix_seconds("ts") + 60), "yyyy-MM-dd HH:mm:ss").alias("fetched_at")))
    path = t.scratch("history")
    e.select(doc.alias("value")).write.text(path)
    series = {"hour": "history_max_h60", "minute": "history_1d_min1"}
    rows = [readers.read_price_history(t.spark, path, column).withColumn("series", F.lit(name)) for name, column in series.items()]
    return rows[0].union(rows[1]).select("slug", "series", F.unix_seconds("timestamp").alias("t_s"), "p_yes", F.unix_seconds("fetched_at").alias("fetched_s"))


def book_messages(t):
    """Book messages derived from events: snapshots, two-token changes and broken lines."""
    v = F.col("value")
    px = lambda x: F.round(x, 4).cast("string")
    level = lambda p, s: F.struct(px(p).alias("price"), F.lit(s).alias("size"))
    received = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("_received_at")
    ms = F.floor(F.unix_micros("ts") / 1000).cast("string").alias("timestamp")
    asset = F.concat(F.lit("tok-"), F.col("user_id")).alias("asset_id")
    book = F.to_json(F.struct(F.lit("book").alias("event_type"), asset, ms, received, F.array(level(v / 500, "10"), level(v / 600, "5")).alias("bids"),
                              F.array(level(v / 500 + 0.02, "7"), level(v / 500 + 0.05, "9"), level(v / 500 + 0.03, "1")).alias("asks")))
    leg = lambda tok, b, a: F.struct(tok.alias("asset_id"), px(b).alias("best_bid"), px(a).alias("best_ask"))
    change = F.to_json(F.struct(F.lit("price_change").alias("type"), ms, received, F.array(
        leg(F.concat(F.lit("tok-"), F.col("user_id")), v / 500, v / 500 + 0.01), leg(F.concat(F.lit("no-"), F.col("user_id")), 1 - v / 500, 1.01 - v / 500)).alias("price_changes")))
    line = F.when(F.col("event_type") == "click", book).when(F.col("event_type") == "view", change).when(F.col("event_type") == "error", F.lit("{broken")).otherwise(
        F.to_json(F.struct(F.lit("tick_size_change").alias("event_type"), asset, received)))
    return t.events.select(line.alias("value"))


@query("scan_book_jsonl", """
SELECT CASE event_type WHEN 'click' THEN 'book' WHEN 'view' THEN 'price_change' ELSE 'tick_size_change' END AS event_type, count(*) AS n,
 CAST(sum(CASE event_type WHEN 'click' THEN 2 ELSE 0 END) AS BIGINT) AS n_bids, CAST(sum(CASE event_type WHEN 'view' THEN 2 ELSE 0 END) AS BIGINT) AS n_changes FROM events WHERE event_type <> 'error' GROUP BY 1""")
def _(t):
    path = t.scratch("book")
    book_messages(t).write.text(path)
    n = lambda c: F.sum(F.coalesce(F.size(F.col(c)), F.lit(0))).alias
    m = readers.read_book_messages(t.spark, path)
    sized = m.select("event_type", F.greatest(F.size("bids"), F.lit(0)).alias("b"), F.greatest(F.size("price_changes"), F.lit(0)).alias("c"))
    return sized.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("n_bids"), F.sum("c").alias("n_changes"))


@query("source_selection", """
WITH p AS (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1','Brand#2') AND p_partkey IN (SELECT l_partkey FROM lineitem)) SELECT p_partkey FROM p ORDER BY 1 LIMIT 25""")
def _(t):
    listed = readers.select_sources(t.part, "p_brand", ["Brand#1", "Brand#2"])
    traded = t.lineitem.select(F.col("l_partkey").alias("p_partkey")).distinct()
    return readers.select_sources(readers.select_sources(listed, "p_partkey", traded), "p_partkey", first=25).select("p_partkey")


_GEO = """WITH s AS (SELECT s_suppkey, 25 + (s_suppkey * 37 % 2500) / 100 AS lat, -125 + (s_suppkey * 91 % 5700) / 100 AS lon FROM supplier),
g AS (SELECT p_partkey, 25 + (p_partkey * 7919 % 2503) / 100 AS lat, -125 + (p_partkey * 104729 % 5701) / 100 AS lon FROM part)"""


@query("nearest_grid_point", _GEO + """
SELECT s_suppkey, p_partkey, round(d2, 6) AS d2 FROM (SELECT s.s_suppkey, g.p_partkey, power(g.lat - s.lat, 2) + power(g.lon - s.lon, 2) AS d2 FROM s, g)
QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY round(d2, 9), p_partkey) = 1""")
def _(t):
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    stations = t.supplier.select("s_suppkey", (25 + (k * 37 % 2500) / 100).alias("lat"), (-125 + (k * 91 % 5700) / 100).alias("lon"))
    lon = -125 + (p * 104729 % 5701) / 100
    grid = t.part.select("p_partkey", (25 + (p * 7919 % 2503) / 100).alias("lat"), (lon + F.when(lon < 0, 360).otherwise(0)).alias("lon"))
    out = readers.nearest_grid_point(stations, grid, "s_suppkey", ["p_partkey"])
    return out.select("s_suppkey", "p_partkey", F.round("d2", 6).alias("d2"))


@query("sink_hive_partitioned", """
SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, count(*) AS n, round(sum(l_extendedprice), 2) AS usd FROM lineitem GROUP BY 1,2""")
def _(t):
    root = t.scratch("hive")
    fills = sinks.year_month(t.lineitem.select("l_orderkey", "l_shipdate", "l_extendedprice"), "l_shipdate")
    sinks.write_partitioned(fills, root, ["year", "month"], ["l_orderkey"], file_rows=20_000)
    back = t.spark.read.schema("l_orderkey LONG, l_shipdate TIMESTAMP, l_extendedprice DOUBLE, year INT, month INT").parquet(root)
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("usd"))


@query("sink_sorted_partitions", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, count(*) AS n, round(sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN value * 2 ELSE value END), 4) AS total FROM events GROUP BY 1""")
def _(t):
    root = t.scratch("sorted")
    e = ev(t).withColumn("d", F.to_date("ts").cast("string"))
    sinks.write_partitioned(e, root, ["d"], ["user_id", "ts"], file_rows=5_000)
    again = e.filter("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'").withColumn("value", F.col("value") * 2)
    sinks.write_partitioned(again, root, ["d"], ["user_id", "ts"], file_rows=5_000)
    back = t.spark.read.schema("event_id LONG, user_id LONG, event_type STRING, ts TIMESTAMP, value DOUBLE, d STRING").parquet(root)
    return back.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("sink_per_entity", """
SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1,2""")
def _(t):
    root = t.scratch("entity")
    e = ev(t, "event_id", "event_type", "ts").withColumn("month", F.date_format("ts", "yyyy-MM"))
    sinks.write_partitioned(e, root, ["event_type", "month"], ["ts"], file_rows=5_000)
    back = t.spark.read.schema("event_id LONG, ts TIMESTAMP, event_type STRING, month STRING").parquet(root)
    return back.groupBy("event_type", "month").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("ts")).alias("last_us"))


def _old_new(t):
    e = ev(t, "event_id", "user_id", "ts", "value")
    old = e.filter("ts < TIMESTAMP '2024-01-20'")
    new = e.filter("ts >= TIMESTAMP '2024-01-15'").select("event_id", "user_id", "ts", (F.col("value") + 1000).alias("value"), F.lit("fresh").alias("note"))
    return old, new


@query("upsert_last_write_wins", """
SELECT event_id, user_id, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value + 1000 ELSE value END AS value, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 'fresh' END AS note FROM events""")
def _(t):
    root, (old, new) = t.scratch("upsert"), [d.withColumn("d", F.to_date("ts").cast("string")) for d in _old_new(t)]
    schema = "event_id LONG, user_id LONG, ts TIMESTAMP, value DOUBLE, note STRING, d STRING"
    sinks.write_partitioned(old, root, ["d"], ["event_id"])
    # The batch overlaps the last days of the table; the folders of earlier days are neither read nor written.
    sinks.merge_partitions(new, root, ["event_id"], ["d"], schema, ["ts"])
    return t.spark.read.schema(schema).parquet(root).select("event_id", "user_id", "value", "note")


@query("merge_forecast_rows", """
WITH b AS (SELECT user_id, date_trunc('day', ts) AS run, date_trunc('hour', ts) AS valid, 0 AS p, value, event_id FROM events WHERE ts < TIMESTAMP '2024-01-20'
 UNION ALL SELECT user_id, date_trunc('day', ts), date_trunc('hour', ts), 1, value + 1000, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15')
SELECT user_id, epoch_us(run) AS run_us, epoch_us(valid) AS valid_us, value FROM b QUALIFY row_number() OVER (PARTITION BY user_id, run, valid ORDER BY p DESC, event_id DESC) = 1""")
def _(t):
    keyed = [d.withColumns({"run": F.date_trunc("day", "ts"), "valid": F.date_trunc("hour", "ts")}) for d in _old_new(t)]
    old, new = [d.withColumn("d", F.to_date("run").cast("string")) for d in keyed]
    root, schema = t.scratch("forecasts"), "event_id LONG, user_id LONG, ts TIMESTAMP, value DOUBLE, run TIMESTAMP, valid TIMESTAMP, note STRING, d STRING"
    first = sinks.upsert(old.limit(0), old, ["user_id", "run", "valid"], ["event_id"])
    sinks.write_partitioned(first, root, ["d"], ["user_id", "valid"])
    sinks.merge_partitions(new, root, ["user_id", "run", "valid"], ["d"], schema, ["event_id"])
    return t.spark.read.schema(schema).parquet(root).select("user_id", us("run"), us("valid"), "value")


@query("incremental_rebuild", """
SELECT user_id, count(*) AS n_new, max(value) AS top FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20') GROUP BY 1""")
def _(t):
    root = t.scratch("stored")
    ev(t).filter("ts < TIMESTAMP '2024-01-20'").write.parquet(root)
    stored = t.spark.read.schema("event_id LONG, user_id LONG, event_type STRING, ts TIMESTAMP, value DOUBLE").parquet(root)
    return sinks.newer_than(ev(t), stored, "ts").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_new"), F.max("value").alias("top"))


@query("run_manifest", """
SELECT event_type AS source, 'ok' AS status, count(*) AS rows_written, count(*) FILTER (WHERE user_id IS NULL) AS rows_null_key FROM events GROUP BY 1""")
def _(t):
    root = t.scratch("manifest")
    sinks.write_sources_with_manifest(ev(t), f"{root}/events", f"{root}/runs", "run", "event_type", "user_id", ["ts"])
    return t.spark.read.schema(sinks.RUNS_SCHEMA).parquet(f"{root}/runs").select("source", "status", "rows_written", "rows_null_key")
