"""Golden fixtures: parsing, calendar, prices, ladders, models, sinks, audits and alerts."""

import datetime as dt
import math
import random
from pathlib import Path

import __spark_entry__
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vaneflow.functions import calendar, parsing, pricing
from vaneflow.functions.parsing import bucket_bounds, city_from_question
from vaneflow.operators import series
from vaneflow.operators.audit import Rule, audit, bounds_rules, compare_schema, evenly_spaced, time_spine, value_fidelity
from vaneflow.operators.joins import near_runs
from vaneflow.operators.ladder import book_walk, favorite, ladder_shape, nearest_bucket
from vaneflow.operators.resample import resample_ffill
from vaneflow.plans import models, stats
from vaneflow.plans.backtest import first_consensus_hour
from vaneflow.plans.forecasts import gridded_peak, latest_run_max, run_maxima
from vaneflow.session import SCHEMAS, scratch_path
from vaneflow.sources import sinks
from vaneflow.sources.readers import nearest_grid_point
from vaneflow.streaming import book

UTC = dt.timezone.utc
REPORT = ("KATL 011653Z 18005KT 10SM FEW050 17/M03 A3012 RMK AO2 PRESRR SLP132 TSB25 TSE1340 T01171083 10128 20056 401281056 "
          "52013 60012 70045 4/012")


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_remark_fields(spark):
    df = spark.createDataFrame([(REPORT,), (None,), ("KATL 011653Z 25/20 A2992",), ("X RMK SLP987 T10171020",)], "m STRING")
    full, none, plain, cold = df.select(*[c.alias(n) for n, c in parsing.remark_fields("m").items()]).collect()
    assert (full.temp_c, full.dewpt_c, full.slp_mb_rmk) == (11.7, -8.3, 1013.2)
    assert (full.max_temp_6hr_c, full.min_temp_6hr_c, full.max_temp_24hr_c, full.min_temp_24hr_c) == (12.8, 5.6, 12.8, -5.6)
    assert (full.precip_6hr_in, full.precip_24hr_in, full.snowdepth_in_rmk) == (0.12, 0.45, 12.0)
    assert (full.press_tendency_3hr_code, full.press_tendency_3hr_mb, full.tsb_minute, full.tse_minute) == (2, 1.3, 25, 40)
    assert full.presrr and not full.presfr
    assert none.presrr is False and none.temp_c is None and none.tsb_minute is None
    assert (plain.temp_c, plain.dewpt_c, plain.slp_mb_rmk) == (25.0, 20.0, None)
    assert (cold.temp_c, cold.dewpt_c, cold.slp_mb_rmk) == (-1.7, -2.0, 998.7)


def test_type_observations(spark):
    raw = spark.createDataFrame([("S1", "2026-01-01 00:51", "abc", "T"), ("M", "bad", "", "M")], "station STRING, valid STRING, tmpf STRING, p01i STRING")
    a, b = parsing.type_observations(raw).collect()
    assert (a.tmpf, a.p01i, a.valid) == (None, 0.0001, dt.datetime(2026, 1, 1, 0, 51))
    assert tuple(b) == (None, None, None, None)


@pytest.mark.parametrize("title,kind,lo,hi,center,edges", [
    ("58-59°F", "range", 58, 59, 58.5, (57.5, 59.5)), ("57°F or below", "or_below", -math.inf, 57, 56, (-999, 57.5)),
    ("66°F or higher", "or_higher", 66, math.inf, 67, (65.5, 999)), ("about 60°F", None, None, None, None, (None, None))])
def test_bucket_titles(spark, title, kind, lo, hi, center, edges):
    r = one(spark, b=parsing.bucket_bounds(F.lit(title)), c=parsing.bucket_bounds(F.lit(title), "continuity"))
    assert tuple(r.b) == (kind, lo, hi, center) and (r.c.lo, r.c.hi) == edges


def test_signed_title_and_slugs(spark):
    r = one(spark, s=parsing.signed_bucket_edges(F.lit("-5--4°F")), d=parsing.slug_date(F.lit("highest-temperature-in-nyc-on-april-1-2026-50-51f")),
            x=parsing.slug_date(F.lit("a-on-april-31-2026")), y=parsing.slug_date(F.lit("a-on-april-3-1999")), k=parsing.slug_strike(F.lit("z-2026-49forbelow")))
    assert (r.s.kind, r.s.lo_f, r.s.hi_f) == ("range", -5, -4)
    assert r.d == dt.date(2026, 4, 1) and r.x is None and r.y is None
    assert (r.k.kind, r.k.lo, r.k.hi) == ("or_below", None, 49)


def test_peak_window_is_elapsed_hours_on_clock_change(spark):
    def ends(day, tz):
        a, b = calendar.peak_window(F.lit(day).cast("date"), F.lit(tz))
        r = one(spark, a=F.unix_seconds(a), b=F.unix_seconds(b))
        return tuple(dt.datetime.fromtimestamp(x, UTC).hour for x in r)

    assert ends("2026-03-08", "America/New_York") == (17, 3)
    assert ends("2025-11-02", "America/New_York") == (16, 2)
    assert ends("2026-07-01", "America/Chicago") == (17, 3)


def test_lead_hours_counts_boundaries(spark):
    r = one(spark, a=calendar.lead_hours(F.lit("2026-01-01 00:59:00").cast("timestamp"), F.lit("2026-01-01 01:01:00").cast("timestamp")))
    assert r.a == 1


def test_fills(spark):
    cases = [("0", "Y", 40, 100), ("N", "0", 100, 30), ("Y", "N", 5, 5), ("0", "Y", 5, 0), ("Q", "0", 10, 1)]
    df = spark.createDataFrame(cases, "ma STRING, ta STRING, mq LONG, tq LONG")
    r = df.withColumns(pricing.fill_fields("ma", "ta", "mq", "tq", F.lit("Y"), F.lit("N"))).collect()
    assert [(x.outcome, x.side, x.price) for x in r] == [
        ("YES", "buy", 0.4), ("NO", "sell", 0.3), ("UNKNOWN", None, None), ("YES", "buy", None), ("UNKNOWN", "sell", 0.1)]
    assert r[0].shares == 100 / 1e6


def test_book_arrays(spark):
    df = spark.createDataFrame([([("0.40", "10"), ("0.42", "5"), ("x", "9")], [("0.45", "3"), ("0.44", "2")]), ([], None)],
                               "bids ARRAY<STRUCT<price: STRING, size: STRING>>, asks ARRAY<STRUCT<price: STRING, size: STRING>>")
    a, b = df.select(pricing.best_bid("bids").alias("bid"), pricing.best_ask("asks").alias("ask"), pricing.level_count("bids").alias("n"),
                     pricing.level_count("asks").alias("m")).collect()
    assert tuple(a) == (0.42, 0.44, 2, 2) and tuple(b) == (None, None, 0, 0)
    near = df.limit(1).select(pricing.ask_depth_within("asks", 0.01).alias("d"), pricing.takeable("asks", F.lit(0.44)).alias("t")).first()
    assert tuple(near) == (5.0, 2.0)


def test_sizes_fees_spread(spark):
    r = one(spark, f=pricing.size_class(F.lit(34.99)), o=pricing.size_class(F.lit(50.0)), s=pricing.size_class(F.lit(7.0)), l=pricing.size_class(F.lit(77.0)),
            fee=pricing.fee_per_share(F.lit(0.5)), a=pricing.forecast_spread(F.lit(1.0), F.lit(4.0), F.lit(None).cast("double")),
            b=pricing.forecast_spread(F.lit(1.0), F.lit(4.0), F.lit(None).cast("double"), minimum=2))
    assert (r.f, r.o, r.s, r.l, r.fee, r.a, r.b) == ("fractional", "round", "small-odd", "large-odd", 0.0125, None, 3.0)


def test_normal_cdf(spark):
    z = [-30.0, -6.0, -4.1, -1.0, -0.3, 0.0, 0.2, 0.66, 1.96, 5.5, 9.0, math.inf, -math.inf]
    got = pricing.with_normal_cdf(spark.createDataFrame([(x,) for x in z], "z DOUBLE"), p=F.col("z")).collect()
    for r in got:
        want = 0.5 * math.erfc(-r.z / math.sqrt(2))
        assert abs(r.p - want) < 1e-14 and (want == 0 or r.z < -30 or math.isinf(r.z) or abs(r.p / want - 1) < 1e-9)


def test_bucket_probabilities_sum_to_one(spark):
    ladder = spark.createDataFrame([(1, i, -math.inf if i == 0 else 50 + 2 * i - 0.5, math.inf if i == 10 else 52 + 2 * i - 0.5) for i in range(11)],
                                   "g INT, i INT, lo DOUBLE, hi DOUBLE")
    p = [r.model_p for r in models.bucket_probabilities(ladder, ["g"], "lo", "hi", F.lit(60.3), F.lit(2.5)).orderBy("i").collect()]
    assert abs(sum(p) - 1) < 1e-12 and min(p) > 0 and p.index(max(p)) == 5


def test_empirical_probabilities(spark):
    rnd = random.Random(3)
    res = [("a", round(rnd.gauss(0, 3), 1)) for _ in range(400)]
    buckets = [("a", float(lo), float(lo + 2)) for lo in range(50, 72, 3)]
    got = models.empirical_probabilities(
        spark.createDataFrame(buckets, "k STRING, lo DOUBLE, hi DOUBLE"), spark.createDataFrame(res, "k STRING, r DOUBLE"), ["k"],
        F.col("lo") - 0.5 - 60.0, F.col("hi") + 0.5 - 60.0, "r").collect()
    for r in got:
        assert r.model_p == sum(r.lo - 0.5 - 60.0 <= x[1] <= r.hi + 0.5 - 60.0 for x in res) / len(res)


def test_ladder_picks_and_shape(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 60.0), ("a", 2, 0.5, 62.0), ("a", 3, 0.25, 64.0), ("b", 1, 1.0, 60.0)], "g STRING, i INT, p DOUBLE, c DOUBLE")
    assert {r.g: r.i for r in favorite(df, ["g"], "i", "p").collect()} == {"a": 1, "b": 1}
    assert {r.g: r.i for r in nearest_bucket(df.withColumn("f", F.lit(61.0)), ["g"], "i", "c", "f").collect()} == {"a": 1, "b": 1}
    shape = {r.g: r for r in ladder_shape(df, ["g"], "p").collect()}
    q = np.array([0.5, 0.5, 0.25]) / 1.25
    assert abs(shape["a"].entropy + (q * np.log2(q)).sum()) < 1e-12 and abs(shape["a"].concentration - (q * q).sum()) < 1e-12
    assert shape["a"].peak_ratio == 2.0 and shape["b"].peak_ratio is None and shape["b"].entropy == 0


def test_book_walk(spark):
    levels = [(1, 0.40, 10.0), (1, 0.42, 5.0), (1, 0.38, 100.0), (1, 0.41, 1.0), (1, 0.2, 3.0), (2, 0.5, 1.0)]
    got = {(r.b, r.target): r for r in book_walk(spark.createDataFrame(levels, "b INT, p DOUBLE, s DOUBLE"), ["b"], "p", "s", [12, 500]).collect()}
    assert got[1, 12.0].filled == 12 and abs(got[1, 12.0].avg_price - (5 * 0.42 + 0.41 + 6 * 0.4) / 12) < 1e-12
    assert got[1, 500.0].filled == 119 and got[2, 12.0].filled == 1
    assert abs(got[2, 12.0].fee - 0.05 * 0.25) < 1e-12


def test_series_operators(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, t + dt.timedelta(seconds=s), v) for i, (s, v) in enumerate([(0, 1.0), (2, -1.0), (5, -1.0), (6, -1.0), (90000, 2.0)])],
                               "k INT, id INT, ts TIMESTAMP, v DOUBLE")
    s = series.sessionize(df, ["k"], "ts", ["id"], 2.0).orderBy("session").collect()
    assert [r.n for r in s] == [2, 2, 1]
    assert series.longest_streak(df, ["k"], "ts", ["id"], F.col("v") < 0, "n").first().n == 3
    eq = series.equity_curve(df, ["k"], "ts", ["id"], F.col("v"), 0.1).orderBy("id").collect()
    assert abs(eq[-1].equity - 1.1 * 0.9**3 * 1.2) < 1e-12 and abs(max(r.drawdown for r in eq) - (1 - 0.9**3)) < 1e-12


def test_resample_is_gap_free(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 30)
    fills = spark.createDataFrame([(1, 1, t, "y", 0.4, 2.0), (1, 2, t + dt.timedelta(minutes=3), "n", 0.7, 1.0), (1, 3, t + dt.timedelta(minutes=3), "y", 0.5, 1.0)],
                                  "k INT, id INT, ts TIMESTAMP, side STRING, p DOUBLE, s DOUBLE")
    r = resample_ffill(fills, ["k"], "ts", ["id"], "side", {"y": "yes", "n": "no"}, "p", "s", 60).orderBy("bar").collect()
    assert [x.bar.minute for x in r] == [0, 1, 2, 3, 4]
    assert [x.yes_price for x in r] == [0.4, 0.4, 0.4, 0.5, 0.5] and [x.no_price for x in r] == [None, None, None, 0.7, 0.7]
    assert [x.yes_count for x in r] == [1, 1, 1, 2, 2] and r[0].usd_cum == 0.8 and abs(r[-1].usd_cum - 2.0) < 1e-12


def test_point_in_time_forecasts(spark):
    ts = lambda s: dt.datetime.fromisoformat(s)
    runs = spark.createDataFrame([
        ("A", ts("2026-01-02 06:00"), ts("2026-01-02 18:00"), 70.0), ("A", ts("2026-01-02 06:00"), ts("2026-01-02 21:00"), 71.0),
        ("A", ts("2026-01-02 12:00"), ts("2026-01-02 18:00"), 65.0), ("A", ts("2026-01-02 13:00"), ts("2026-01-02 18:00"), 99.0),
        ("A", ts("2026-01-02 12:30"), ts("2026-01-03 09:00"), 12.0)], "st STRING, runtime TIMESTAMP, ftime TIMESTAMP, v DOUBLE").withColumn("tz", F.lit("UTC"))
    probes = spark.createDataFrame([(1, "A", dt.date(2026, 1, 2), ts("2026-01-02 12:00")), (2, "A", dt.date(2026, 1, 2), ts("2026-01-02 11:59")),
                                    (3, "A", dt.date(2026, 1, 2), ts("2026-01-04 12:00"))], "id INT, st STRING, local_date DATE, cutoff TIMESTAMP")
    got = latest_run_max(probes, run_maxima(runs, "st", "runtime", "ftime", "v", "tz"), "st", "cutoff", "runtime", "v", "pred")
    assert {r.id: r.pred for r in got.collect()} == {1: 65.0, 2: 71.0, 3: None}


def test_gridded_peak_needs_coverage(spark):
    base = dt.datetime(2026, 1, 2)
    hour = lambda h: base + dt.timedelta(hours=h)
    grid = [("A", hour(6), hour(12 + i), 50.0 + i) for i in range(6)] + [("A", hour(8), hour(12), 80.0), ("A", hour(11), hour(13), 99.0)]
    grid += [("B", hour(6), hour(12 + i), 50.0) for i in range(5)]
    g = spark.createDataFrame(grid, "st STRING, init TIMESTAMP, valid TIMESTAMP, v DOUBLE")
    probes = spark.createDataFrame([(s, s, dt.date(2026, 1, 2), hour(10)) for s in "AB"], "id STRING, st STRING, local_date DATE, cut TIMESTAMP").withColumn("tz", F.lit("UTC"))
    got = gridded_peak(probes, g, "st", "id", "cut", "init", "valid", "v", "tz", "peak")
    assert {r.id: r.peak for r in got.collect()} == {"A": 80.0, "B": None}


def test_first_consensus_hour(spark):
    panel = spark.createDataFrame([("A", h, h, s) for h, s in ((14, 1.0), (15, 3.1), (16, 3.0), (17, None))], "k STRING, hour INT, cutoff INT, spread DOUBLE")
    r = first_consensus_hour(panel, ["k"], 3.0, 15).collect()
    assert [(x.hour, x.spread) for x in r] == [(16, 3.0)]


def test_trade_stats_single_trade(spark):
    r = stats.trade_stats(spark.createDataFrame([("a", 0.5), ("b", 1.0), ("b", -0.5), ("b", 0.1)], "g STRING, pnl DOUBLE"), ["g"]).orderBy("g").collect()
    v = np.array([1.0, -0.5, 0.1])
    assert r[0].t == 0 and abs(r[1].t - v.mean() / (v.std(ddof=1) / math.sqrt(3))) < 1e-12


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2]
    y = x @ [1.5, -0.3, 4.0] + 2 + rng.normal(size=300)
    df = spark.createDataFrame([(i % 3, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "g INT, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE")

    def closed(x, y, alpha):
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        return w, y.mean() - x.mean(0) @ w

    for alpha in (0.0, 5.0):
        fit = models.ridge(df, ["a", "b", "c"], "y", alpha)
        w, c = closed(x, y, alpha)
        assert np.allclose(fit.coefficients.toArray(), w, atol=1e-6) and abs(fit.intercept - c) < 1e-6
    for r in models.ridge_by_group(df, ["g"], ["a", "b", "c"], "y", 5.0).collect():
        m = np.arange(300) % 3 == r.g
        w, c = closed(x[m], y[m], 5.0)
        assert np.allclose(r.weights, w) and abs(r.intercept - c) < 1e-9
        assert abs(r.sigma - np.std(y[m] - c - x[m] @ w, ddof=1)) < 1e-9


def test_boosting_beats_the_mean(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, size=(400, 2))
    df = spark.createDataFrame([(float(a) if i % 9 else None, float(b), float(a * a + b)) for i, (a, b) in enumerate(x)], "a DOUBLE, b DOUBLE, y DOUBLE")
    fit = models.boosted_regression(df, ["a", "b"], "y", rounds=8)
    mae = fit.transform(df).agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0]
    base = df.agg(F.avg(F.abs(F.col("y") - df.agg(F.avg("y")).first()[0]))).first()[0]
    assert mae < base / 2


def test_upsert_and_shrink_guard(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, v STRING")
    new = spark.createDataFrame([(2, "B", 5), (3, "c", 6)], "id INT, v STRING, extra INT")
    once = sinks.upsert(old, new, ["id"])
    twice = sinks.upsert(once, new, ["id"])
    want = [(1, "a", None), (2, "B", 5), (3, "c", 6)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want
    path = scratch_path(spark, "guard")
    assert sinks.replace_table(once, path, old) == 3
    with pytest.raises(ValueError):
        sinks.replace_table(old.limit(1), path, old)


def test_nearest_grid_point_falls_back_to_wider_tiles(spark):
    stations = spark.createDataFrame([("near", 40.0, -75.0), ("far", 10.0, 100.0)], "s STRING, lat DOUBLE, lon DOUBLE")
    grid = spark.createDataFrame([(1, 40.2, 285.1), (2, 40.4, 284.9), (3, 48.0, 290.0)], "c INT, lat DOUBLE, lon DOUBLE")
    assert {r.s: r.c for r in nearest_grid_point(stations, grid, "s", ["c"]).collect()} == {"near": 1, "far": 3}


def test_audit_and_schema(spark):
    df = spark.createDataFrame([(1.0,), (99.0,), (None,), (float("nan"),)], "x DOUBLE")
    got = {r.check: (r.n_bad, r.status) for r in audit(df, [*bounds_rules({"x": (0, 10)}), Rule("some", 3, F.col("x") > 50, 0.5, "warn")]).collect()}
    assert got == {"x in range": (1, "fail"), "x not nan": (1, "fail"), "x not null": (1, "fail"), "some": (2, "ok")}
    a, b = StructType.fromDDL("a INT, b STRING"), StructType.fromDDL("a LONG, c INT")
    assert compare_schema(a, b) == ["missing c", "a: int instead of bigint"]


def simulate_alerts(quotes, n, max_age, threshold, gap):
    state, last, out = {}, {}, []
    for ladder, bucket, t, bid, i in quotes:
        state.setdefault(ladder, {})[bucket] = (bid, t)
        have = state[ladder]
        if len(have) < n or any((t - u).total_seconds() > max_age for _, u in have.values()) or sum(b for b, _ in have.values()) < threshold - 1e-9:
            continue
        if ladder in last and (t - last[ladder]).total_seconds() < gap:
            continue
        last[ladder] = t
        out.append((ladder, i))
    return sorted(out)


@pytest.mark.parametrize("fan", [2, 3, 7, 256])
def test_thinning_equals_a_replay(spark, fan):
    """Dense, periodic, repeated and sparse times; the tree has several levels with a small fan."""
    rnd = random.Random(fan)
    times = {"dense": [rnd.randrange(0, 4_000) for _ in range(300)], "even": [100 * i for i in range(200)], "same": [5] * 40, "sparse": [5_000 * i for i in range(30)], "one": [7]}
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms), i, float(i)) for k, all_ms in times.items() for i, ms in enumerate(all_ms)]
    want = []
    for k in times:
        last = None
        for _, t, i, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if last is None or t - last >= dt.timedelta(seconds=1):
                last = t
                want.append((k, i))
    got = book.thin(spark.createDataFrame(rows, "ladder STRING, ts TIMESTAMP, seq LONG, x DOUBLE"), "ladder", "ts", "seq", 1.0, fan)
    assert got.columns == ["ladder", "ts", "seq", "x"]
    assert sorted((r.ladder, r.seq) for r in got.collect()) == sorted(want)


def test_thinning_does_not_slow_down_where_many_times_lie_within_the_gap(spark):
    """40,000 candidates of one ladder, 2,000 to a gap: the work of a cell follows its rows, not their square, and candidates are made once."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rnd = random.Random(3)
    ms = sorted(rnd.randrange(20_000) for _ in range(40_000))
    rows = spark.createDataFrame([("l", dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=m), i) for i, m in enumerate(ms)], "ladder STRING, ts TIMESTAMP, seq LONG")
    want, last = [], None
    for i, m in enumerate(ms):
        if last is None or m - last >= 1_000:
            want.append(i)
            last = m
    got = book.thin(rows.mapInPandas(counted, rows.schema), "ladder", "ts", "seq", 1.0)
    assert sorted(r.seq for r in got.collect()) == want
    assert made.value == 40_000


def test_sign_models_read_the_texts_once(spark, tmp_path):
    """Both fits and the scores work on stored statistics; the result no longer reads the documents."""
    docs = [(i, " ".join(["w", "x" * (i % 5 + 1), str(i)] * (i % 7 + 1)), "en", "web", 10 * (i % 7 + 1)) for i in range(200)]
    spark.createDataFrame(docs, SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 3), 0) for i in range(200)], SCHEMAS["labels"]).write.parquet(f"{tmp_path}/labels.parquet")
    out = __spark_entry__.queries()["classify_sign"](spark, str(tmp_path))
    assert not [f for f in out.inputFiles() if "documents.parquet" in f or "labels.parquet" in f]
    rows = out.collect()
    assert {r.model for r in rows} == {"logistic", "boosted"} and all(r.accuracy > 0.9 for r in rows if r.model == "boosted")


def test_late_quotes_follow_the_rule(spark):
    """Quotes that arrive a batch or two late: left out where a newer one of their bucket is known, else counted from the ladder's clock."""
    rnd = random.Random(4)
    arrivals = [[], [], [], []]
    for i in range(900):
        at = rnd.randrange(0, 900_000)
        batch = min(3, at // 225_000 + (rnd.randrange(1, 3) if rnd.random() < 0.15 else 0))
        arrivals[batch].append(("l", rnd.randrange(5), dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=at), round(rnd.uniform(0, 0.5), 3), i))
    newest, clock, replay = {}, dt.datetime(2000, 1, 1), []
    for batch in arrivals:
        ahead = [(q[0], q[1], max(q[2], clock), q[3], q[4]) for q in batch if (q[2], q[4]) > newest.get(q[1], (dt.datetime(2000, 1, 1), -1))]
        ahead.sort(key=lambda q: (q[2], q[4]))
        replay += ahead
        for q in ahead:
            newest[q[1]], clock = (q[2], q[4]), max(clock, q[2])
    assert sum(map(len, arrivals)) > len(replay)
    want = simulate_alerts(replay, 5, 30, 1.3, 1.0)
    root = scratch_path(spark, "alerts")
    watch = book.LadderAlerts(spark, root, "ladder", "bucket", "ts", "bid", "seq", n_buckets=5, max_age_seconds=30, threshold=1.3)
    for b, batch in enumerate(arrivals):
        watch(spark.createDataFrame(batch, "ladder STRING, bucket INT, ts TIMESTAMP, bid DOUBLE, seq LONG"), b)
    got = spark.read.schema("ladder STRING, ts TIMESTAMP, seq LONG, sum_bid DOUBLE, batch INT").parquet(f"{root}/alerts")
    assert sorted((r.ladder, r.seq) for r in got.collect()) == want and len(want) > 20


def test_mergeable_state_is_replay_safe_and_compacted(spark):
    rnd = random.Random(6)
    root = scratch_path(spark, "state")
    state = book.MergeableState(root, ["k"], {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}, compact_every=3)
    batches = [[(rnd.randrange(5), rnd.randrange(100)) for _ in range(20)] for _ in range(8)]
    for i, rows in enumerate(batches):
        for _ in range(1 + i % 2):  # every other batch is repeated
            state(spark.createDataFrame(rows, "k INT, v LONG"), i)
    every = [x for b in batches for x in b]
    want = sorted((k, len(vs), sum(vs), max(vs), min(vs)) for k in {x[0] for x in every} for vs in [[v for q, v in every if q == k]])
    assert sorted(map(tuple, state.read(spark).select("k", "n", "s", "hi", "lo").collect())) == want
    assert state._stored(spark, "base") == [2, 5] and state._stored(spark, "batches") == [3, 4, 5, 6, 7]


def test_merge_touches_only_the_folders_of_the_batch(spark):
    root = scratch_path(spark, "merge")
    old = spark.range(400).select("id", (F.col("id") % 8).cast("string").alias("d"), F.lit(1).alias("v"))
    sinks.write_partitioned(old, root, ["d"], ["id"], file_rows=20)
    place = lambda: {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(root.removeprefix("file://")).rglob("*.parquet")}
    before = place()
    batch = spark.createDataFrame([(3, "3", 7), (11, "3", 8), (1_000, "5", 9)], "id LONG, d STRING, v INT")
    report = sinks.merge_partitions(batch, root, ["id"], ["d"], "id LONG, v INT, d STRING")
    assert sorted(map(tuple, report.collect())) == [("3", 50, 50), ("5", 50, 51)]
    after = place()
    same = {p for p in before if "d=3" not in str(p) and "d=5" not in str(p)}
    assert same and all(after[p] == before[p] for p in same)
    table = spark.read.schema("id LONG, v INT, d STRING").parquet(root)
    assert table.count() == 401 and {r.id: r.v for r in table.filter("v > 1").collect()} == {3: 7, 11: 8, 1_000: 9}


def test_files_of_a_sink_are_even(spark):
    root = scratch_path(spark, "even")
    hot = spark.range(5_000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 10)).alias("d"))
    sinks.write_partitioned(hot, root, ["d"], ["id"], file_rows=300)
    files = spark.read.parquet(root).groupBy("d", F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    sizes = [r.n for r in files]
    assert sum(sizes) == 5_000 and max(sizes) <= 400 and max(sizes) <= 2 * min(sizes)
    for d in {r.d for r in files}:  # each holds a range of the order
        spans = sorted((r.lo, r.hi) for r in files if r.d == d)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_value_fidelity_finds_a_fault_on_any_day(spark):
    raw = spark.range(3_000).select("id", (F.col("id") % 30).alias("day"), (F.col("id") * 0.5).alias("v"))
    for day in (0, 13, 29):
        wrong = raw.withColumn("v", F.when(F.col("id") == day + 60, F.col("v") + 1).otherwise(F.col("v"))).filter(F.col("id") != day + 90)
        assert value_fidelity(raw, wrong, ["id"], ["v"], "day").first().asDict() == {"column_name": "v", "n_both": 2_999, "n_left_only": 1, "n_right_only": 0, "n_diff": 1}
    assert value_fidelity(raw, raw, ["id"], ["v"], "day").first()["n_both"] == 3_000


def test_far_stations_meet_few_tiles(spark):
    rnd = random.Random(12)
    grid = [(i, rnd.uniform(25, 50), rnd.uniform(235, 293)) for i in range(4_000)]
    stations = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(60)]
    got = nearest_grid_point(spark.createDataFrame(stations, "s INT, lat DOUBLE, lon DOUBLE"), spark.createDataFrame(grid, "c INT, lat DOUBLE, lon DOUBLE"), "s", ["c"])
    want = {s: min(((a - y) ** 2 + (o - 360 - x if o > 180 else o - x) ** 2, c) for c, a, o in grid)[1] for s, y, x in stations}
    assert {r.s: r.c for r in got.collect()} == want


def test_hot_slots_are_cut(spark):
    rnd = random.Random(13)
    side = lambda n: [(rnd.choice([1, 1, 1, 2]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.choice([rnd.randrange(5_000), 700])), i) for i in range(n)]
    a, b = side(120), side(150)
    frames = spark.createDataFrame(a, "k INT, ta TIMESTAMP, x LONG"), spark.createDataFrame(b, "k INT, tb TIMESTAMP, y LONG")
    want = sorted((x, y) for k, t, x in a for q, u, y in b if k == q and abs((t - u).total_seconds()) <= 600)
    for rows in (7, 2_000):
        assert sorted((r.x, r.y) for r in near_runs(*frames, ["k"], "ta", "tb", 600, rows).collect()) == want


def test_titles_names_and_spread(spark):
    titles = ["58-59°F", "-5--4°F", "-3-2°F", "-3°F or below", "-10°F or higher", "about 5°F"]
    got = {r.t: r for r in spark.createDataFrame([(t,) for t in titles], "t STRING").select("t", bucket_bounds("t").alias("b"), bucket_bounds("t", "continuity").alias("c")).collect()}
    assert [tuple(got[t].b)[:1] + tuple(got[t].c)[1:3] for t in titles] == [("range", 57.5, 59.5), ("range", -5.5, -3.5), ("range", -3.5, 2.5), ("or_below", -999.0, -2.5), ("or_higher", -10.5, 999.0), (None, None, None)]
    questions = {"Highest temperature in New York City on April 1?": "New York City", "highest temperature in Rio de Janeiro exceed 30°C": "Rio de Janeiro", "temperature in St. Louis be": "St. Louis", "rain?": ""}
    assert {r.q: r.c for r in spark.createDataFrame([(q,) for q in questions], "q STRING").select("q", city_from_question("q").alias("c")).collect()} == questions
    files = spark.createDataFrame([(f"f{i:02}",) for i in range(20)], "f STRING")
    assert evenly_spaced(files, "f", 0).count() == 20 and evenly_spaced(files, "f", 5).count() == 6


def test_spine_has_every_slot(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 6, 1)), (2, dt.datetime(2024, 1, 5))], "k INT, ts TIMESTAMP")
    assert {r.k: r["count"] for r in time_spine(df, ["k"], "ts", "1 HOUR").groupBy("k").count().collect()} == {1: 152 * 24 + 1, 2: 1}


def test_ladder_alerts_equal_a_replay(spark):
    rnd = random.Random(11)
    t, quotes = dt.datetime(2024, 1, 1), []
    for i in range(1500):
        t += dt.timedelta(milliseconds=rnd.randrange(50, 900))
        if i % 400 == 399:
            t += dt.timedelta(seconds=40)
        quotes.append(("hot" if rnd.random() < 0.7 else "cold", rnd.randrange(10), t, round(rnd.uniform(0, 0.21), 3), i))
    schema = "ladder STRING, bucket INT, ts TIMESTAMP, bid DOUBLE, seq LONG"
    df = spark.createDataFrame(quotes, schema)
    want = simulate_alerts(quotes, 10, 30, 1.005, 1.0)
    found = book.alert_candidates(df, "ladder", "bucket", "ts", "bid", "seq", 10, 30, 1.005)
    assert sorted((r.ladder, r.seq) for r in book.thin(found, "ladder", "ts", "seq", 1.0).collect()) == want and len(want) > 50

    root = scratch_path(spark, "alerts")
    watch = book.LadderAlerts(spark, root, "ladder", "bucket", "ts", "bid", "seq", n_buckets=10, max_age_seconds=30, threshold=1.005, min_gap_seconds=1.0)
    for b, (lo, hi) in enumerate(((0, 500), (500, 1000), (1000, 1500))):
        watch(df.filter((F.col("seq") >= lo) & (F.col("seq") < hi)), b)
    watch(df.filter("seq >= 1000"), 2)  # a replayed batch changes nothing
    got = spark.read.schema("ladder STRING, ts TIMESTAMP, seq LONG, sum_bid DOUBLE, batch INT").parquet(f"{root}/alerts")
    assert sorted((r.ladder, r.seq) for r in got.collect()) == want
