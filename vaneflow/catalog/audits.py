"""Data-quality audits of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import parsing, pricing
from ..functions.calendar import lead_hours, plus_hours
from ..operators.asof import asof_join
from ..operators.audit import (
    Rule, audit, bounds_rules, count_reconcile, duplicates, missing, null_parity, ratio_fidelity, schema_audit, time_spine, value_fidelity,
)
from ..operators.quantiles import exact_quantiles
from ..sources.sinks import RUNS_SCHEMA, write_partitioned, write_sources_with_manifest
from .aggregates import SQL_BOOKS, books, r6
from .joins import of_type
from .registry import query
from .scalars import SQL_RAW, raw_fills, raw_reports, raw_text
from .windows import ev


def sql_audit(prefix: str, source: str, rules: list[tuple[str, int, str, float, str]]) -> str:
    """SQL for an audit: one UNION branch per rule (check, level, bad predicate, allowed share, severity)."""
    parts = [
        f"SELECT '{c}' AS \"check\", {lv} AS level, CASE WHEN count(*) FILTER (WHERE {bad}) <= count(*) * {ok} THEN 'ok' ELSE '{sev}' END AS status,"
        f" count(*) FILTER (WHERE {bad}) AS n_bad, count(*) AS n_total FROM {source}" for c, lv, bad, ok, sev in rules
    ]
    return prefix + " " + " UNION ALL ".join(parts)


@query("dq_completeness", """
WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d FROM events),
p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)
SELECT CAST(d.d AS VARCHAR) AS d, count(*) AS n_expected, count(*) FILTER (WHERE p.user_id IS NULL) AS n_missing
FROM u CROSS JOIN d LEFT JOIN p ON p.user_id=u.user_id AND p.d=d.d GROUP BY 1""")
def _(t):
    e = t.events.select("user_id", F.to_date("ts").alias("d"))
    lo, hi = e.agg(F.min("d")).scalar(), e.agg(F.max("d")).scalar()
    expected = e.select("user_id").distinct().withColumn("d", F.explode(F.sequence(lo, hi)))
    present = e.distinct().withColumn("here", F.lit(1))
    return expected.join(present, ["user_id", "d"], "left").groupBy(F.col("d").cast("string").alias("d")).agg(
        F.count(F.lit(1)).alias("n_expected"), F.count_if(F.col("here").isNull()).alias("n_missing"))


@query("dq_expected_spine", """
WITH g AS (SELECT DISTINCT event_type AS station, date_trunc('hour', ts) AS h, event_id % 6 AS fxx FROM events),
b AS (SELECT station, min(h) AS lo, least(max(h), (SELECT max(ts) FROM events) - INTERVAL 2 HOUR) AS hi FROM g GROUP BY 1),
s AS (SELECT station, CAST(unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS TIMESTAMP) AS h FROM b),
x AS (SELECT s.station, s.h, f.f FROM s CROSS JOIN (SELECT unnest(range(0, 6)) AS f) f)
SELECT x.station, x.f AS fxx, count(*) AS n_expected, count(*) FILTER (WHERE g.h IS NULL) AS n_missing FROM x LEFT JOIN g ON g.station=x.station AND g.h=x.h AND g.fxx=x.f GROUP BY 1,2""")
def _(t):
    g = t.events.select(F.col("event_type").alias("station"), F.date_trunc("hour", "ts").alias("slot"), (F.col("event_id") % 6).alias("fxx")).distinct()
    cutoff = F.lit(t.events.agg(F.max("ts")).scalar()) - F.expr("INTERVAL 2 HOURS")
    spine = time_spine(g, ["station"], "slot", "1 HOUR", until=cutoff)
    expected = spine.withColumn("fxx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    present = g.withColumn("here", F.lit(1))
    return expected.join(present, ["station", "slot", "fxx"], "left").groupBy("station", "fxx").agg(
        F.count(F.lit(1)).alias("n_expected"), F.count_if(F.col("here").isNull()).alias("n_missing"))


@query("dq_run_reconcile", """
WITH r AS (SELECT CAST(year(l_shipdate) AS INT) AS yr, count(*) AS n FROM lineitem GROUP BY 1),
a AS (SELECT CASE WHEN year(l_shipdate) = 1994 THEN 2094 ELSE CAST(year(l_shipdate) AS INT) END AS yr, count(*) AS n FROM lineitem WHERE NOT (year(l_shipdate) % 2 = 0 AND l_orderkey % 50 = 0) GROUP BY 1)
SELECT CAST(coalesce(a.yr, r.yr) AS VARCHAR) AS source, coalesce(r.n, 0) AS recorded, coalesce(a.n, 0) AS actual, coalesce(r.n, 0) = coalesce(a.n, 0) AS ok FROM a FULL JOIN r ON a.yr = r.yr""")
def _(t):
    root = t.scratch("reconcile")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", F.year("l_shipdate").alias("yr"))
    write_sources_with_manifest(rows, f"{root}/table", f"{root}/runs", "run", "yr", "l_orderkey", ["l_shipdate"])
    recorded = t.spark.read.schema(RUNS_SCHEMA).parquet(f"{root}/runs").filter("status = 'ok'").select("source", F.col("rows_written").alias("n"))
    # What became of the table since: even years lost some orders, and one year was moved to another.
    stored = t.spark.read.schema(rows.schema).parquet(f"{root}/table")
    lost = (F.col("yr") % 2 == 0) & (F.col("l_orderkey") % 50 == 0)
    moved = F.when(F.col("yr") == 1994, 2094).otherwise(F.col("yr")).cast("string")
    actual = stored.filter(~lost).groupBy(moved.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return count_reconcile(recorded, actual, ["source"])


_EXPECTED = "event_id LONG, ts TIMESTAMP, value DOUBLE"


@query("dq_schema", """
WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT event_type, unnest(['event_id', 'ts', 'value']) AS subject, unnest(['bigint', 'timestamp', 'double']) AS wanted FROM n UNION ALL SELECT 'signup', 'note', 'extra')
SELECT event_type, subject, wanted AS expected, CASE WHEN event_type = 'error' AND subject = 'value' THEN 'string' WHEN event_type = 'view' AND subject = 'ts' THEN 'missing' WHEN subject = 'note' THEN 'string' ELSE wanted END AS actual, n,
 NOT (event_type = 'error' AND subject = 'value' OR event_type = 'view' AND subject = 'ts' OR subject = 'note') AS ok FROM c JOIN n USING (event_type)
UNION ALL SELECT event_type, 'props', 'k', CAST(array_to_string(json_keys(props), ',') AS VARCHAR), count(*), array_to_string(json_keys(props), ',') = 'k' FROM events GROUP BY event_type, json_keys(props)""")
def _(t):
    # A table for each feed; one wrote its numbers as text, one left out its time and one added a column.
    plain = {"event_id": F.col("event_id"), "ts": F.col("ts"), "value": F.col("value")}
    drift = {"error": plain | {"value": F.col("value").cast("string")}, "view": {c: plain[c] for c in ("event_id", "value")}, "signup": plain | {"note": F.lit("x")}}
    root, tables = t.scratch("schemas"), {}
    for kind in ("click", "error", "purchase", "signup", "view"):
        of_type(t, kind).select(*[c.alias(n) for n, c in drift.get(kind, plain).items()]).write.parquet(f"{root}/{kind}")
        tables[kind] = t.spark.read.parquet(f"{root}/{kind}")
    columns = schema_audit(tables, StructType.fromDDL(_EXPECTED)).select(F.col("source").alias("event_type"), F.col("column_name").alias("subject"), "expected", "actual", "n", "ok")
    fields = F.array_join(F.array_sort(F.json_object_keys("props")), ",")
    sets = t.events.groupBy("event_type", fields.alias("actual")).agg(F.count(F.lit(1)).alias("n"))
    return columns.unionByName(sets.select("event_type", F.lit("props").alias("subject"), F.lit("k").alias("expected"), "actual", "n", (F.col("actual") == "k").alias("ok")))


@query("dq_required_fields", """
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS missing_k, count(*) FILTER (WHERE json_extract_string(props, '$.note') IS NULL) AS missing_note,
 round(100.0 * count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50) / count(*), 4) AS pct_large FROM events GROUP BY 1""")
def _(t):
    k, note = F.get_json_object("props", "$.k"), F.get_json_object("props", "$.note")
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(k.isNull()).alias("missing_k"), F.count_if(note.isNull()).alias("missing_note"),
        F.round(F.count_if(k.cast("int") > 50) * 100.0 / F.count(F.lit(1)), 4).alias("pct_large"))


@query("dq_row_fidelity", """
WITH r AS (SELECT user_id % 10 AS source, event_type, count(*) AS n FROM events GROUP BY 1,2),
e AS (SELECT source, sum(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END * n) AS expected_max FROM r GROUP BY 1),
p AS (SELECT user_id % 10 AS source, count(*) FILTER (WHERE event_type = 'view') + 2 * count(*) FILTER (WHERE event_type = 'click' AND event_id % 9 <> 0) + count(*) FILTER (WHERE event_type = 'click' AND event_id % 9 = 0) AS n FROM events GROUP BY 1),
legs AS (SELECT e.source, CAST(expected_max AS BIGINT) AS expected_max, p.n AS n_rows, CASE WHEN p.n > expected_max THEN 'fail' WHEN p.n < expected_max * 0.95 THEN 'warn' ELSE 'ok' END AS status
FROM e JOIN p ON p.source = e.source)
SELECT 'legs' AS rule, source, expected_max, n_rows, '' AS leads, status FROM legs
UNION ALL SELECT 'sub_hourly', h.source, 3 * h.n, s.n, s.leads, CASE WHEN s.n <> 3 * h.n THEN 'fail' WHEN s.leads <> '315,330,345' THEN 'fail' ELSE 'ok' END
FROM (SELECT user_id % 10 AS source, count(*) AS n FROM events GROUP BY 1) h
JOIN (SELECT source, count(*) AS n, string_agg(DISTINCT fm::VARCHAR, ',' ORDER BY fm::VARCHAR) AS leads FROM (SELECT user_id % 10 AS source, CASE WHEN user_id % 10 = 4 AND event_id % 40 = 0 AND m.m = 345 THEN 360 ELSE m.m END AS fm
 FROM events, (VALUES (315), (330), (345)) m(m) WHERE NOT (user_id % 10 = 3 AND event_id % 50 = 0 AND m.m = 345)) GROUP BY 1) s ON s.source = h.source""")
def _(t):
    e = t.events.select((F.col("user_id") % 10).alias("source"), "event_type", "event_id")
    weight = F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    expected = e.groupBy("source").agg(F.sum(weight).alias("expected_max"))
    legs = F.when(F.col("event_type") == "view", 1).when((F.col("event_type") == "click") & (F.col("event_id") % 9 == 0), 1).when(
        F.col("event_type") == "click", 2).otherwise(0)
    processed = e.withColumn("leg", F.explode(F.filter(F.sequence(F.lit(1), F.lit(2)), lambda x: x <= legs)))
    rows = processed.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    status = F.when(F.col("n_rows") > F.col("expected_max"), "fail").when(F.col("n_rows") < F.col("expected_max") * 0.95, "warn").otherwise("ok")
    legs = expected.join(rows, "source").select(F.lit("legs").alias("rule"), "source", "expected_max", "n_rows", F.lit("").alias("leads"), status.alias("status"))
    # Sub-hourly rows, three for each hourly one: one source lacks some of them, another has a lead that none should have.
    hourly = t.events.select((F.col("user_id") % 10).alias("source"), "event_id")
    finer = hourly.withColumn("minutes", F.explode(F.array(F.lit(315), F.lit(330), F.lit(345))))
    last = F.col("minutes") == 345
    finer = finer.filter(~(last & (F.col("source") == 3) & (F.col("event_id") % 50 == 0))).withColumn(
        "minutes", F.when(last & (F.col("source") == 4) & (F.col("event_id") % 40 == 0), 360).otherwise(F.col("minutes")))
    ratio = ratio_fidelity(hourly, finer, "source", "minutes", 3, (315, 330, 345))
    return legs.unionByName(ratio.select(F.lit("sub_hourly").alias("rule"), "source", (3 * F.col("n_base")).alias("expected_max"), F.col("n_finer").alias("n_rows"), "leads",
                                         F.when(F.col("rows_ok") & F.col("leads_ok"), "ok").otherwise("fail").alias("status")))


@query("dq_null_parity", SQL_RAW + """,
p AS (SELECT try_cast(raw AS DOUBLE) AS strict, CASE WHEN raw = 'T' THEN 0.0001 ELSE try_cast(raw AS DOUBLE) END AS traced, raw FROM r)
SELECT 'strict' AS column_name, count(*) FILTER (WHERE raw IN ('M','')) AS raw_nulls, count(*) FILTER (WHERE strict IS NULL) AS processed_nulls, count(*) FILTER (WHERE raw IN ('M','')) = count(*) FILTER (WHERE strict IS NULL) AS ok FROM p
UNION ALL SELECT 'traced', count(*) FILTER (WHERE raw IN ('M','') OR raw LIKE 'a%'), count(*) FILTER (WHERE traced IS NULL), count(*) FILTER (WHERE raw IN ('M','') OR raw LIKE 'a%') = count(*) FILTER (WHERE traced IS NULL) FROM p""")
def _(t):
    raw = raw_text(t)
    clean = parsing.null_markers("raw")
    processed = raw.select(parsing.lenient_double(clean).alias("strict"), parsing.trace_double(clean).alias("traced"))
    marker = F.col("raw").isin(*parsing.NULL_MARKERS)
    return null_parity(raw, processed, {"strict": marker, "traced": marker | F.col("raw").startswith("a")}, ["strict", "traced"])


@query("dq_value_fidelity", """
WITH b AS (SELECT event_id, CASE WHEN event_id % 211 = 0 AND day(ts) % 3 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE NOT (event_id % 307 = 0 AND day(ts) % 5 = 0)),
j AS (SELECT a.event_id AS l, b.event_id AS r, a.value AS lv, b.value AS rv FROM events a FULL JOIN b ON a.event_id = b.event_id)
SELECT 'value' AS column_name, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS n_both, count(*) FILTER (WHERE r IS NULL) AS n_left_only, count(*) FILTER (WHERE l IS NULL) AS n_right_only,
 count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL AND abs(lv - rv) > 1e-6) AS n_diff FROM j""")
def _(t):
    # Every file of both sides; on some days the processed side has wrong values, on others it lacks rows.
    raw = ev(t).withColumn("file", F.date_format("ts", "yyyy-MM-dd"))
    wrong = (F.col("event_id") % 211 == 0) & (F.dayofmonth("ts") % 3 == 0)
    lost = (F.col("event_id") % 307 == 0) & (F.dayofmonth("ts") % 5 == 0)
    processed = raw.filter(~lost).withColumn("value", F.col("value") + F.when(wrong, 1.0).otherwise(0.0))
    return value_fidelity(raw, processed, ["event_id"], ["value"], "file")


_BOUNDS = {"l_quantity": (1.0, 49.0), "l_extendedprice": (950.0, 100000.0), "l_discount": (0.0, 0.09), "l_tax": (0.0, 0.08)}


@query("dq_bounds", sql_audit("", "lineitem", [
    rule for c, (lo, hi) in _BOUNDS.items() for rule in (
        (f"{c} in range", 3, f"NOT ({c} BETWEEN {lo} AND {hi}) AND NOT isnan({c})", 0, "fail"), (f"{c} not nan", 3, f"isnan({c})", 0, "fail"),
        (f"{c} not null", 3, f"{c} IS NULL", 0, "fail"))]))
def _(t):
    return audit(t.lineitem.select(*_BOUNDS), bounds_rules(_BOUNDS))


@query("dq_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*) > 1")
def _(t):
    return duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_cross_partition_overlap", """
WITH p AS (SELECT l_orderkey, l_linenumber, year(l_shipdate) + CASE WHEN l_orderkey % 500 = 0 THEN 1 ELSE 0 END AS folder, year(l_shipdate) AS yr FROM lineitem),
k AS (SELECT l_orderkey, l_linenumber, count(DISTINCT folder) AS n FROM p GROUP BY 1,2)
SELECT (SELECT count(*) FROM k WHERE n > 1) AS n_overlap, (SELECT count(*) FROM p WHERE folder <> yr) AS n_outside, (SELECT count(*) FROM p) AS n_rows""")
def _(t):
    root = t.scratch("partitions")
    placed = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", (F.year("l_shipdate") + F.when(F.col("l_orderkey") % 500 == 0, 1).otherwise(0)).alias("year"))
    write_partitioned(placed, root, ["year"], ["l_shipdate"], file_rows=50_000)
    stored = t.spark.read.schema("l_orderkey LONG, l_linenumber INT, l_shipdate TIMESTAMP, year INT").parquet(root)
    overlap = stored.groupBy("l_orderkey", "l_linenumber").agg(F.count_distinct("year").alias("n")).agg(F.count_if(F.col("n") > 1))
    return stored.agg(F.count_if(F.col("year") != F.year("l_shipdate")).alias("n_outside"), F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_overlap", overlap.scalar())


_TIME_SQL = """WITH f AS (SELECT ts AS run, event_id % 48 AS lead, ts + to_hours(event_id % 48 + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS valid FROM events)"""


@query("dq_time_identity", sql_audit(_TIME_SQL, "f", [
    ("valid = run + lead", 4, "valid <> run + to_hours(lead)", 0, "fail"), ("lead = valid - run", 4, "date_diff('hour', run, valid) <> lead", 0.05, "fail"),
    ("whole minute", 4, "second(run) <> 0", 0, "warn"), ("lead not negative", 4, "lead < 0", 0, "fail")]))
def _(t):
    lead = F.col("event_id") % 48
    f = t.events.select(F.col("ts").alias("run"), lead.alias("lead"), plus_hours("ts", lead + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)).alias("valid"))
    return audit(f, [
        Rule("valid = run + lead", 4, F.col("valid") != plus_hours("run", F.col("lead"))),
        Rule("lead = valid - run", 4, lead_hours("run", "valid") != F.col("lead"), 0.05),
        Rule("whole minute", 4, F.second("run") != 0, severity="warn"), Rule("lead not negative", 4, F.col("lead") < 0)])


_PHYS_SQL = """WITH g AS (SELECT vec_id, 273.15 + embedding[1] * 10 AS t2m, 271 + embedding[2] * 10 AS d2m, 250 + embedding[3] * 10 AS t500, 280 + embedding[4] * 10 AS t850, 273.15 + embedding[5] * 20 AS tsfc,
 50 + embedding[6] * 30 AS tcc, 30 + embedding[7] * 30 AS lcc, 30 + embedding[8] * 30 AS mcc, 30 + embedding[9] * 30 AS hcc, embedding[10] / 50 AS dlat, embedding[11] / 50 AS dlon FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings))"""


@query("dq_physics", sql_audit(_PHYS_SQL, "g", [
    ("dewpoint", 4, "d2m > t2m + 0.1", 0, "fail"), ("lapse rate", 4, "t500 > t850", 0.01, "fail"), ("skin temperature", 4, "abs(t2m - tsfc) > 15", 0, "warn"),
    ("cloud total", 4, "tcc + 5 < greatest(lcc, mcc, hcc)", 0.05, "warn"), ("grid distance", 4, "sqrt(power(dlat * 111000, 2) + power(dlon * 85000, 2)) > 2500", 0, "fail")]))
def _(t):
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    g = t.embeddings.select(
        (273.15 + x(0) * 10).alias("t2m"), (271 + x(1) * 10).alias("d2m"), (250 + x(2) * 10).alias("t500"), (280 + x(3) * 10).alias("t850"),
        (273.15 + x(4) * 20).alias("tsfc"), (50 + x(5) * 30).alias("tcc"), *[(30 + x(6 + i) * 30).alias(c) for i, c in enumerate(("lcc", "mcc", "hcc"))],
        (x(9) / 50).alias("dlat"), (x(10) / 50).alias("dlon"))
    c = F.col
    return audit(g, [
        Rule("dewpoint", 4, c("d2m") > c("t2m") + 0.1), Rule("lapse rate", 4, c("t500") > c("t850"), 0.01),
        Rule("skin temperature", 4, F.abs(c("t2m") - c("tsfc")) > 15, severity="warn"),
        Rule("cloud total", 4, c("tcc") + 5 < F.greatest("lcc", "mcc", "hcc"), 0.05, "warn"),
        Rule("grid distance", 4, F.sqrt(F.pow(c("dlat") * 111000, 2) + F.pow(c("dlon") * 85000, 2)) > 2500)])


@query("dq_cross_source", """
WITH d AS (SELECT event_id AS i, CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 19 <> 0 AND event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * (event_id % 400) / 10 ELSE event_id % 35 END END AS temp_c,
 CASE WHEN event_id % 17 <> 0 THEN (event_id % 35) * 1.8 + 32 END AS tmpf, event_id % 17 <> 0 AND event_id % 19 <> 0 AS r FROM events)
SELECT i % 10 AS station, count(*) AS n, count(*) FILTER (WHERE abs(temp_c * 1.8 + 32 - tmpf) > 1.0001) AS n_off, count(*) FILTER (WHERE r) AS n_routine, count(*) FILTER (WHERE NOT r) AS n_special FROM d GROUP BY 1""")
def _(t):
    i = F.col("event_id")
    d = raw_reports(t).select("event_id", parsing.remark_fields("metar")["temp_c"].alias("temp_c"), F.col("metar").contains(" RMK ").alias("routine"))
    tmpf = F.when(i % 17 != 0, (i % 35) * 1.8 + 32)
    return d.groupBy((i % 10).alias("station")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("temp_c") * 1.8 + 32 - tmpf) > 1.0001).alias("n_off"),
        F.count_if(F.coalesce("routine", F.lit(False))).alias("n_routine"), F.count_if(~F.coalesce("routine", F.lit(False))).alias("n_special"))


@query("dq_book_sanity", sql_audit(SQL_BOOKS + ", q AS (SELECT list_max(bids) AS bid, list_min(asks) AS ask, (list_max(bids) + list_min(asks)) / 2 AS mid FROM b)", "q", [
    ("bid in [0,1]", 3, "NOT (bid BETWEEN 0 AND 1)", 0, "fail"), ("ask in [0,1]", 3, "NOT (ask BETWEEN 0 AND 1)", 0, "fail"), ("not crossed", 3, "bid > ask", 0, "fail"),
    ("mid identity", 3, "abs(mid - (bid + ask) / 2) > 1e-9", 0, "fail"), ("one side missing", 3, "bid IS NULL OR ask IS NULL", 0.01, "warn")]))
def _(t):
    q = books(t).select(pricing.best_bid("bids").alias("bid"), pricing.best_ask("asks").alias("ask")).withColumn("mid", pricing.mid("bid", "ask"))
    c = F.col
    return audit(q, [
        Rule("bid in [0,1]", 3, ~c("bid").between(0, 1)), Rule("ask in [0,1]", 3, ~c("ask").between(0, 1)), Rule("not crossed", 3, c("bid") > c("ask")),
        Rule("mid identity", 3, F.abs(c("mid") - (c("bid") + c("ask")) / 2) > 1e-9), Rule("one side missing", 3, c("bid").isNull() | c("ask").isNull(), 0.01, "warn")])


@query("dq_complement", """
WITH y AS (SELECT user_id, ts, value / 300 AS mid FROM events WHERE event_type='click'), n AS (SELECT user_id, ts, 1 - value / 300 AS mid FROM events WHERE event_type='view'),
j AS (SELECT y.user_id, abs(y.mid + n.mid - 1) AS dev FROM y ASOF JOIN n ON y.user_id=n.user_id AND y.ts >= n.ts)
SELECT user_id, count(*) AS n, round(avg(dev), 6) AS mean_dev, round(max(dev), 6) AS max_dev FROM j GROUP BY 1""")
def _(t):
    y = of_type(t, "click").select("user_id", "ts", (F.col("value") / 300).alias("mid"))
    n = of_type(t, "view").select("user_id", "ts", (1 - F.col("value") / 300).alias("mid"), "event_id")
    j = asof_join(y, n, ["user_id"], "ts", "ts", {"no_mid": "mid"}, seq=["event_id"], how="inner")
    dev = F.abs(F.col("mid") + F.col("no_mid") - 1)
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(dev), "mean_dev"), r6(F.max(dev), "max_dev"))


@query("dq_token_routing", """
SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_unknown FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def _(t):
    token = F.when(F.col("ma") == "0", F.col("ta")).otherwise(F.col("ma"))
    known = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.concat(F.lit("Y"), "p_partkey").alias("py"), F.concat(F.lit("N"), "p_partkey").alias("pn"))
    counted = raw_fills(t).groupBy("l_partkey", token.alias("token")).agg(F.count(F.lit(1)).alias("k"))
    foreign = (F.col("token") != F.col("py")) & (F.col("token") != F.col("pn"))
    return counted.join(known, "l_partkey").groupBy("p_brand").agg(
        F.sum("k").alias("n"), F.sum(F.when(foreign, F.col("k")).otherwise(0)).alias("n_unknown"))


@query("dq_volume_reconcile", """
WITH s AS (SELECT l_orderkey, sum(l_extendedprice) / 2 AS v FROM lineitem GROUP BY 1), r AS (SELECT o_orderpriority, v / o_totalprice AS ratio FROM orders JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderpriority, count(*) AS n, round(quantile_cont(ratio, 0.5), 6) AS median_ratio, quantile_cont(ratio, 0.5) BETWEEN 0.95 AND 1.05 AS ok FROM r GROUP BY 1""")
def _(t):
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_extendedprice") / 2).alias("v"))
    r = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").join(sums, "o_orderkey").select("o_orderpriority", F.try_divide("v", "o_totalprice").alias("ratio"))
    q = exact_quantiles(r, ["o_orderpriority"], "ratio", {"m": 0.5})
    return r.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).join(q, "o_orderpriority").select(
        "o_orderpriority", "n", r6("m", "median_ratio"), F.col("m").between(0.95, 1.05).alias("ok"))


@query("dq_lifetime", """
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE l_shipdate < o_orderdate - INTERVAL 7 DAY) AS n_early FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1""")
def _(t):
    trades = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").agg(F.count(F.lit(1)).alias("k"))
    j = trades.join(t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderkey")
    early = F.col("l_shipdate") < F.col("o_orderdate") - F.expr("INTERVAL 7 DAYS")
    return j.groupBy("o_orderpriority").agg(F.sum("k").alias("n"), F.sum(F.when(early, F.col("k")).otherwise(0)).alias("n_early"))


@query("dq_nonempty", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def _(t):
    return missing(t.orders.filter("o_totalprice > 100").select("o_orderkey", "o_totalprice"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("dq_density", """
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1,2), b AS (SELECT event_type, min(h) AS lo, max(h) AS hi FROM h GROUP BY 1),
s AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS TIMESTAMP) AS h FROM b), j AS (SELECT s.event_type, s.h, coalesce(h.n, 0) AS n FROM s LEFT JOIN h ON h.event_type=s.event_type AND h.h=s.h)
SELECT event_type, count(*) AS hours, count(*) FILTER (WHERE n < 3) AS sparse_hours, count(*) FILTER (WHERE n = 0) AS empty_hours, round(avg(n), 6) AS mean_n, max(n) AS max_n FROM j GROUP BY 1""")
def _(t):
    h = t.events.groupBy("event_type", F.date_trunc("hour", "ts").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    dense = time_spine(h, ["event_type"], "slot", "1 HOUR").join(h, ["event_type", "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n")
    return dense.groupBy("event_type").agg(F.count(F.lit(1)).alias("hours"), F.count_if(n < 3).alias("sparse_hours"), F.count_if(n == 0).alias("empty_hours"),
                                           r6(F.avg(n), "mean_n"), F.max(n).alias("max_n"))


