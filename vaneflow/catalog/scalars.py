"""Scalar expressions on text and numbers derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, parsing, pricing
from ..plans.stats import equal_width_bin
from .aggregates import SQL_ZONE, SQL_ZONED, r6, zoned
from .registry import query

I = "event_id"  # noqa: E741


def raw_text(t):
    """Raw readings derived from events: numbers, markers, traces and junk."""
    i = F.col(I)
    raw = F.when(i % 7 == 0, "M").when(i % 7 == 1, "").when(i % 7 == 2, "T").when(i % 7 == 3, F.concat(F.lit("a"), F.col("value").cast("string"))).otherwise(
        F.col("value").cast("string"))
    return t.events.select(I, "ts", "value", raw.alias("raw"))


SQL_RAW = """WITH r AS (SELECT event_id, ts, value, CASE event_id % 7 WHEN 0 THEN 'M' WHEN 1 THEN '' WHEN 2 THEN 'T' WHEN 3 THEN 'a' || value
 ELSE CAST(value AS VARCHAR) END AS raw FROM events)"""


@query("cast_numeric_lenient", SQL_RAW + " SELECT event_id, try_cast(raw AS DOUBLE) AS v FROM r")
def _(t):
    return raw_text(t).select(I, parsing.lenient_double(parsing.null_markers("raw")).alias("v"))


@query("trace_sentinel", SQL_RAW + " SELECT event_id, CASE WHEN raw = 'T' THEN 0.0001::DOUBLE ELSE try_cast(raw AS DOUBLE) END AS v FROM r")
def _(t):
    return raw_text(t).select(I, parsing.trace_double(parsing.null_markers("raw")).alias("v"))


@query("parse_utc_timestamp", """
SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 5 <> 1 THEN epoch_us(date_trunc('minute', ts)) END AS v_us FROM events""")
def _(t):
    good = F.date_format("ts", "yyyy-MM-dd HH:mm")
    text = F.when(F.col(I) % 5 == 0, F.concat(F.lit("bad "), good)).when(F.col(I) % 5 == 1, F.regexp_replace(good, "^2024-01", "2024-17")).otherwise(good)
    return t.events.select(I, F.unix_micros(parsing.utc_minute(text)).alias("v_us"))


@query("epoch_to_timestamp", """
SELECT event_id, CAST(date_trunc('second', ts) AS VARCHAR) AS from_s, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS from_ms FROM events""")
def _(t):
    s, ms = F.floor(F.unix_micros("ts") / 1_000_000), F.floor(F.unix_micros("ts") / 1000)
    return t.events.select(I, F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss").alias("from_s"),
                           F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS").alias("from_ms"))


@query("coalesce_first_present", """
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN value * 2 END, try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS v FROM events""")
def _(t):
    i, v = F.col(I), F.col("value")
    return t.events.select(I, parsing.first_present(
        F.when(i % 3 == 0, v), F.when(i % 2 == 0, v * 2), F.get_json_object("props", "$.k").try_cast("double")).alias("v"))


@query("local_calendar", SQL_ZONED + " SELECT event_id, CAST(CAST(lt AS DATE) AS VARCHAR) AS d, CAST(hour(lt) AS BIGINT) AS hr FROM z")
def _(t):
    return zoned(t).select(I, F.col("local_day").cast("string").alias("d"), F.col("local_hour").cast("long").alias("hr"))


@query("local_midnight_window", f"""
WITH z AS (SELECT DISTINCT o_orderdate AS d, user_id, {SQL_ZONE} AS tz FROM (SELECT o_orderdate, o_custkey % 5 AS user_id FROM orders)),
m AS (SELECT d, user_id, (d AT TIME ZONE tz) AT TIME ZONE 'UTC' AS mid FROM z)
SELECT user_id AS zone_id, CAST(CAST(d AS DATE) AS VARCHAR) AS d, epoch_us(mid + INTERVAL 12 HOUR) AS start_us, epoch_us(mid + INTERVAL 22 HOUR) AS end_us FROM m""")
def _(t):
    from .aggregates import ZONES

    zone = F.element_at(F.array(*map(F.lit, ZONES)), (F.col("zone_id") + 1).cast("int"))
    days = t.orders.select((F.col("o_custkey") % 5).alias("zone_id"), F.to_date("o_orderdate").alias("day")).distinct().withColumn("tz", zone)
    start, end = calendar.peak_window("day", "tz")
    return days.select("zone_id", F.col("day").cast("string").alias("d"), F.unix_micros(start).alias("start_us"), F.unix_micros(end).alias("end_us"))


@query("calendar_parts", """
SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(month(o_orderdate) AS INT) AS mon, CAST(dayofweek(o_orderdate) AS INT) AS dow, dayname(o_orderdate) AS day_name FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.dayofyear(d).alias("doy"), F.month(d).alias("mon"), (F.dayofweek(d) - 1).alias("dow"),
                           F.date_format(d, "EEEE").alias("day_name"))


@query("lead_hours", "SELECT event_id, date_diff('hour', ts, ts + to_minutes(event_id % 4000)) AS lead FROM events")
def _(t):
    valid = F.timestamp_micros(F.unix_micros("ts") + (F.col(I) % 4000) * 60_000_000)
    return t.events.select(I, calendar.lead_hours("ts", valid).alias("lead"))


@query("unit_convert", "SELECT event_id, round((value + 200 - 273.15) * 9 / 5 + 32, 6) AS k_to_f, round(value * 1.8 + 32, 6) AS c_to_f FROM events")
def _(t):
    v = F.col("value")
    return t.events.select(I, r6((v + 200 - 273.15) * 9 / 5 + 32, "k_to_f"), r6(v * 1.8 + 32, "c_to_f"))


@query("row_greatest_effective_max", """
SELECT event_id, nullif(greatest(coalesce(CASE WHEN event_id % 5 > 0 THEN value END, -999), coalesce(CASE WHEN event_id % 3 = 0 THEN value * 1.8 + 32 END, -999)), -999) AS eff FROM events""")
def _(t):
    i, v = F.col(I), F.col("value")
    return t.events.select(I, F.greatest(F.when(i % 5 > 0, v), F.when(i % 3 == 0, v * 1.8 + 32)).alias("eff"))


def titles(t):
    lo = F.col("p_size") - 25
    k = F.col("p_partkey") % 4
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    s = lo.cast("string")
    title = F.when(k == 0, text(s, "-", (lo + 1).cast("string"), "°F")).when(k == 1, text(s, "°F or below")).when(
        k == 2, text(s, "°F or higher")).otherwise(text("about ", s, "°F"))
    return t.part.select("p_partkey", lo.alias("lo0"), title.alias("title"))


@query("bucket_title_parse", """
WITH p AS (SELECT p_partkey, CAST(p_size - 25 AS DOUBLE) AS n, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'range' WHEN 1 THEN 'or_below' WHEN 2 THEN 'or_higher' END AS kind,
 CASE k WHEN 0 THEN n WHEN 1 THEN '-infinity'::DOUBLE WHEN 2 THEN n END AS lo, CASE k WHEN 0 THEN n + 1 WHEN 1 THEN n WHEN 2 THEN 'infinity'::DOUBLE END AS hi,
 CASE k WHEN 0 THEN n + 0.5 WHEN 1 THEN n - 1 WHEN 2 THEN n + 1 END AS center,
 CASE k WHEN 0 THEN n - 0.5 WHEN 1 THEN -999.0 WHEN 2 THEN n - 0.5 END AS lo_c, CASE k WHEN 0 THEN n + 1.5 WHEN 1 THEN n + 0.5 WHEN 2 THEN 999.0 END AS hi_c,
 CASE k WHEN 0 THEN n WHEN 3 THEN NULL ELSE n END AS lo_f FROM p""")
def _(t):
    b, c = parsing.bucket_bounds("title"), parsing.bucket_bounds("title", "continuity")
    s = parsing.signed_bucket_edges("title")
    parsed = titles(t).select("p_partkey", b.alias("b"), c.alias("c"), s.alias("s"))
    return parsed.select("p_partkey", "b.kind", "b.lo", "b.hi", "b.center", F.col("c.lo").alias("lo_c"), F.col("c.hi").alias("hi_c"),
                         F.col("s.lo_f").cast("double").alias("lo_f"))


def slugs(t):
    d = F.col("o_orderdate")
    month = F.lower(F.date_format(d, "MMMM"))
    day = F.when(F.col("o_orderkey") % 9 == 0, F.lit("31")).otherwise(F.date_format(d, "d"))
    k = F.col("o_orderkey") % 4
    lo = F.col("o_orderkey") % 60 + 30
    tail = F.when(k == 0, F.concat(F.lit("-"), lo, F.lit("-"), lo + 1, F.lit("f"))).when(k == 1, F.concat(F.lit("-"), lo, F.lit("forbelow"))).when(
        k == 2, F.concat(F.lit("-"), lo, F.lit("forhigher"))).otherwise(F.lit(""))
    slug = F.concat(F.lit("highest-temperature-in-nyc-on-"), month, F.lit("-"), day, F.lit("-"), F.date_format(d, "yyyy"), tail)
    return t.orders.select("o_orderkey", slug.alias("slug"))


@query("slug_date_parse", """
SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN CASE WHEN o_orderkey % 9 = 0 THEN CAST(try_cast(strftime(o_orderdate, '%Y-%m-') || '31' AS DATE) AS VARCHAR)
 ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS d FROM orders""")
def _(t):
    return slugs(t).select("o_orderkey", parsing.slug_date("slug").cast("string").alias("d"))


@query("slug_strike_parse", """
WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderkey % 60 + 30 AS INT) AS n FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'range' WHEN 1 THEN 'or_below' WHEN 2 THEN 'or_higher' END AS kind, CASE WHEN k IN (0, 2) THEN n END AS lo,
 CASE k WHEN 0 THEN CAST(n + 1 AS INT) WHEN 1 THEN n END AS hi FROM o""")
def _(t):
    return slugs(t).select("o_orderkey", parsing.slug_strike("slug").alias("s")).select("o_orderkey", "s.kind", "s.lo", "s.hi")


_CITIES = ["NYC", "New York", "Atlanta", "d.c.", "San Francisco", "LA", "sf"]
_CITY_OUT = ["New York City", "New York City", "Atlanta", "d.c", "San Francisco", "Los Angeles", "San Francisco"]  # the trailing dot goes before the lookup


@query("city_from_question", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN '' ELSE [" + ", ".join(f"'{c}'" for c in _CITY_OUT) + "][(o_orderkey % 8) + 1] END AS city FROM orders")
def _(t):
    k = (F.col("o_orderkey") % 8).cast("int")
    name = F.get(F.array(*map(F.lit, _CITIES)), k)
    q = F.when(k == 7, "Will it rain tomorrow?").otherwise(F.concat(F.lit("Will the Highest  temperature in "), name, F.lit(" be 50-51°F on "), F.date_format("o_orderdate", "MMMM d"), F.lit("?")))
    return t.orders.select("o_orderkey", parsing.city_from_question(q).alias("city"))


@query("station_code_normalize", """
WITH s AS (SELECT s_suppkey, upper(trim(CASE s_suppkey % 4 WHEN 0 THEN ' k' || substr(s_name, 1, 3) WHEN 1 THEN substr(s_name, 1, 3) || ' ' WHEN 2 THEN 'kabcd' ELSE 'Kat' END)) AS c FROM supplier),
n AS (SELECT s_suppkey, CASE WHEN length(c) = 4 AND c[1] = 'K' THEN substr(c, 2) ELSE c END AS code FROM s)
SELECT s_suppkey, code, CASE WHEN length(code) = 3 THEN 'K' || code ELSE code END AS forecast_code FROM n""")
def _(t):
    k, name = F.col("s_suppkey") % 4, F.substring("s_name", 1, 3)
    raw = F.when(k == 0, F.concat(F.lit(" k"), name)).when(k == 1, F.concat(name, F.lit(" "))).when(k == 2, "kabcd").otherwise("Kat")
    code = parsing.station_code(raw)
    return t.supplier.select("s_suppkey", code.alias("code"), parsing.forecast_station_code(code).alias("forecast_code"))


@query("tag_aggregate", """
SELECT l_orderkey, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS tag FROM lineitem) GROUP BY 1""")
def _(t):
    # The tags are distinct before they are collected, so a list holds at most one entry per tag.
    tags = t.lineitem.select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("tag")).distinct()
    return tags.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


def raw_fills(t, market: str = "l_partkey"):
    """Exchange events derived from lineitem: buys, sells, token swaps and zero amounts; `market` numbers the tokens."""
    yes, no = F.concat(F.lit("Y"), F.col(market)), F.concat(F.lit("N"), F.col(market))
    k = F.col("l_linenumber") % 7
    token = F.when(F.col("l_returnflag") == "A", yes).when(F.col("l_returnflag") == "N", no).otherwise("Z")
    usd = F.round(F.col("l_extendedprice") * 100).cast("long")
    shares = (F.col("l_quantity") * 1_000_000).cast("long")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", yes.alias("yes"), no.alias("no"),
        F.when(k.isin(1, 2, 3), "0").otherwise(token).alias("ma"), F.when(k.isin(1, 2, 3), token).when(k == 6, "W").otherwise("0").alias("ta"),
        F.when(k.isin(1, 2, 3), usd).when(k == 5, 0).otherwise(shares).alias("mq"),
        F.when(k == 3, 0).when(k.isin(1, 2), shares).otherwise(usd).alias("tq"),
    )


SQL_FILLS = """WITH f AS (SELECT l_orderkey, l_linenumber, l_linenumber % 7 AS k, CASE l_returnflag WHEN 'A' THEN 'YES' WHEN 'N' THEN 'NO' ELSE 'UNKNOWN' END AS outcome,
 l_quantity AS shares, CAST(round(l_extendedprice * 100) AS BIGINT) / (l_quantity * 1e6) AS price, l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_linenumber % 7 NOT IN (3, 5, 6))"""


@query("derive_fill", SQL_FILLS + """
SELECT outcome, CASE WHEN k IN (1, 2) THEN 'buy' ELSE 'sell' END AS side, l_partkey, count(*) AS n, round(sum(shares), 2) AS shares, round(sum(price * shares), 6) AS usd,
 round(sum(price), 12) AS price_sum FROM f GROUP BY 1,2,3""")
def _(t):
    typed = raw_fills(t).withColumns(pricing.fill_fields("ma", "ta", "mq", "tq", "yes", "no")).filter("price IS NOT NULL")
    return typed.groupBy("outcome", "side", "l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("shares"), 2).alias("shares"), r6(F.sum("usd"), "usd"),
        F.round(F.sum("price"), 12).alias("price_sum"))


@query("mid_spread", """
WITH q AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN value END AS b, CASE WHEN event_id % 5 > 0 THEN value + 0.5 END AS a FROM events)
SELECT event_id, round((b + a) / 2, 6) AS mid, round(a - b, 6) AS spread FROM q""")
def _(t):
    b, a = F.when(F.col(I) % 4 > 0, F.col("value")), F.when(F.col(I) % 5 > 0, F.col("value") + 0.5)
    return t.events.select(I, r6(pricing.mid(b, a), "mid"), r6(pricing.spread(b, a), "spread"))


@query("complement_price", "SELECT event_id, round(1 - value / 1000, 6) AS ask_no, round(1 - (value + 1) / 1000, 6) AS bid_no FROM events")
def _(t):
    v = F.col("value")
    return t.events.select(I, r6(pricing.complement(v / 1000), "ask_no"), r6(pricing.complement((v + 1) / 1000), "bid_no"))


@query("fee_pnl", """
WITH q AS (SELECT event_id, least(value / 300, 1) AS p, event_id % 2 AS won FROM events)
SELECT event_id, round(0.05 * p * (1 - p), 8) AS fee, round(won - p - 0.05 * p * (1 - p), 8) AS long_yes, round((1 - won) - (1 - p) - 0.05 * (1 - p) * p, 8) AS long_no FROM q""")
def _(t):
    p, won = F.least(F.col("value") / 300, F.lit(1.0)), F.col(I) % 2
    r8 = lambda c, n: F.round(c, 8).alias(n)
    return t.events.select(I, r8(pricing.fee_per_share(p), "fee"), r8(pricing.trade_pnl(p, won), "long_yes"),
                           r8(pricing.trade_pnl(pricing.complement(p), 1 - won), "long_no"))


@query("ratio_return", """
WITH q AS (SELECT event_id, least(value / 300, 1) AS p, event_id % 2 AS y FROM events)
SELECT event_id, round(y / nullif(p * 1.02, 0) - 1, 6) AS long_ret, round((1 - y) / ((1 - p + 0.03) * 1.02) - 1, 6) AS short_ret FROM q""")
def _(t):
    p, y = F.least(F.col("value") / 300, F.lit(1.0)), F.col(I) % 2
    return t.events.select(I, r6(pricing.net_return(y, p), "long_ret"), r6(pricing.short_return(y, p), "short_ret"))


@query("band_label", """
SELECT l_linestatus, CASE WHEN l_discount < 0.025 THEN 'tight' WHEN l_discount < 0.055 THEN 'medium' ELSE 'wide' END AS band, count(*) AS n FROM lineitem GROUP BY 1,2""")
def _(t):
    band = pricing.bands("l_discount", [0.025, 0.055], ["tight", "medium", "wide"])
    return t.lineitem.groupBy("l_linestatus", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("equal_width_bins", """
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(greatest(1, ceil((o_totalprice - lo) / (hi - lo) * 10)) AS BIGINT) AS bin, count(*) AS n, min(o_totalprice) AS lo_px, max(o_totalprice) AS hi_px FROM orders, m GROUP BY 1""")
def _(t):
    return equal_width_bin(t.orders.select("o_totalprice"), "o_totalprice", 10).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo_px"), F.max("o_totalprice").alias("hi_px"))


@query("size_class", """
WITH s AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN value ELSE round_even(value, 0) END AS s FROM events)
SELECT event_type, CASE WHEN abs(s - round_even(s, 0)) > 0.001 THEN 'fractional' WHEN round_even(s, 0) IN (5,10,15,20,25,30,40,50,60,75,100,125,150,200,250,500,1000) THEN 'round'
 WHEN s < 49.5 THEN 'small-odd' ELSE 'large-odd' END AS size_class, count(*) AS n FROM s GROUP BY 1,2""")
def _(t):
    size = F.when(F.col(I) % 3 == 0, F.col("value")).otherwise(F.rint("value"))
    return t.events.groupBy("event_type", pricing.size_class(size).alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


_THREE = "CASE WHEN event_id % 4 > 0 THEN value END, CASE WHEN event_id % 5 > 0 THEN value * 1.1 END, CASE WHEN event_id % 6 > 0 THEN 60.0 END"


@query("consensus_spread", f"""
WITH f AS (SELECT event_id, list_filter([{_THREE}], lambda x: x IS NOT NULL) AS l FROM events)
SELECT event_id, CASE WHEN len(l) = 3 THEN round(list_max(l) - list_min(l), 6) END AS spread_all, CASE WHEN len(l) >= 2 THEN round(list_max(l) - list_min(l), 6) END AS spread_any2 FROM f""")
def _(t):
    i, v = F.col(I), F.col("value")
    three = [F.when(i % 4 > 0, v), F.when(i % 5 > 0, v * 1.1), F.when(i % 6 > 0, F.lit(60.0))]
    return t.events.select(I, r6(pricing.forecast_spread(*three), "spread_all"), r6(pricing.forecast_spread(*three, minimum=2), "spread_any2"))


@query("fold_assign", """
SELECT CASE WHEN o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'IS' WHEN o_orderdate BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' THEN 'OOS' ELSE 'OOB' END AS fold,
 count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    fold = calendar.fold_label(F.to_date("o_orderdate"), ("1995-01-01", "1998-12-31"), ("1999-01-01", "2000-12-31"))
    return t.orders.groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BOLT%' AND p_brand ILIKE 'brand#1%' AND starts_with(p_type, 'S')")
def _(t):
    return t.part.filter(F.col("p_name").ilike("%BOLT%") & F.col("p_brand").ilike("brand#1%") & F.col("p_type").startswith("S")).select("p_partkey", "p_name")


def raw_reports(t):
    """Surface reports derived from events, with a remark section on most of them."""
    i = F.col(I)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    sign = F.when(i % 3 == 0, "1").otherwise("0")
    when = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise(F.lit(""))
    body = F.concat(F.lit("KATL 011653Z 18005KT 10SM FEW050 "), pad(i % 35, 2), F.lit("/M"), pad(i % 20, 2), F.lit(" A3012"))
    remarks = F.concat(
        F.lit(" RMK AO2"), when(i % 2 == 0, F.lit(" SLP"), pad(i % 1000, 3)), when(i % 4 == 0, F.lit(" T"), sign, pad(i % 400, 3), F.lit("0"), pad(i % 300, 3)),
        when(i % 5 == 0, F.lit(" 1"), sign, pad(i % 380, 3)), when(i % 5 == 1, F.lit(" 20"), pad(i % 250, 3)),
        when(i % 7 == 0, F.lit(" 4"), sign, pad(i % 390, 3), F.lit("1"), pad(i % 90, 3)), when(i % 6 == 0, F.lit(" 5"), (i % 9).cast("string"), pad(i % 80, 3)),
        when(i % 8 == 0, F.lit(" 6"), pad(i % 500, 4)), when(i % 9 == 0, F.lit(" 7"), pad(i % 900, 4)), when(i % 10 == 0, F.lit(" 4/"), pad(i % 40, 3)),
        when(i % 11 == 0, F.lit(" PRESRR")), when(i % 13 == 0, F.lit(" PRESFR")), when(i % 14 == 0, F.lit(" TSB"), pad(i % 60, 2), F.lit(" TSE13"), pad(i % 59, 2)))
    return t.events.select(I, F.when(i % 17 == 0, None).when(i % 19 == 0, body).otherwise(F.concat(body, remarks)).alias("metar"))


@query("remark_decode", """
WITH e AS (SELECT event_id AS i, event_id % 17 <> 0 AND event_id % 19 <> 0 AS r, event_id % 17 <> 0 AS b, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS s FROM events)
SELECT i AS event_id, CASE WHEN r AND i%4=0 THEN s*(i%400)/10 WHEN b THEN CAST(i%35 AS DOUBLE) END AS temp_c, CASE WHEN r AND i%4=0 THEN (i%300)/10 WHEN b THEN CAST(-(i%20) AS DOUBLE) END AS dewpt_c,
 CASE WHEN r AND i%2=0 THEN CASE WHEN i%1000 > 500 THEN 900 ELSE 1000 END + (i%1000)/10 END AS slp_mb_rmk, CASE WHEN r AND i%5=0 THEN s*(i%380)/10 END AS max_temp_6hr_c,
 CASE WHEN r AND i%5=1 THEN (i%250)/10 END AS min_temp_6hr_c, CASE WHEN r AND i%7=0 THEN s*(i%390)/10 END AS max_temp_24hr_c, CASE WHEN r AND i%7=0 THEN -(i%90)/10 END AS min_temp_24hr_c,
 CASE WHEN r AND i%8=0 THEN (i%500)/100 END AS precip_6hr_in, CASE WHEN r AND i%9=0 THEN (i%900)/100 END AS precip_24hr_in, CASE WHEN r AND i%10=0 THEN CAST(i%40 AS DOUBLE) END AS snowdepth_in_rmk,
 CASE WHEN r AND i%6=0 THEN (i%80)/10 END AS press_tendency_3hr_mb, CASE WHEN r AND i%6=0 THEN i%9 END AS press_tendency_3hr_code, r AND i%11=0 AS presrr, r AND i%13=0 AS presfr,
 CASE WHEN r AND i%14=0 THEN i%60 END AS tsb_minute, CASE WHEN r AND i%14=0 THEN i%59 END AS tse_minute FROM e""")
def _(t):
    out = raw_reports(t).select(I, *[c.alias(n) for n, c in parsing.remark_fields("metar").items()])
    # The sign of zero carries no meaning.
    return out.withColumns({n: F.when(F.col(n) == 0, 0.0).otherwise(F.col(n)) for n, k in out.dtypes if k == "double"})


