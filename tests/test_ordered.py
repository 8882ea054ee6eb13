"""Ordered scans, lookups and quantiles against plain windows and brute force, with one hot key."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vaneflow.operators.asof import asof_anchors, asof_join, asof_nearest, window_lookup
from vaneflow.operators.ordered import (
    CELL, RANGE, cut, depth_cells, neighbours, previous, running, shift, time_cell, value_cell,
)
from vaneflow.operators.quantiles import exact_quantiles
from vaneflow.operators.series import bursts

T0 = dt.datetime(2024, 1, 1)


def rows(n=900, seed=1):
    """A third of all rows belongs to key 0, times repeat, some values are null."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rnd.random() < 0.34 else rnd.randrange(1, 12)
        t = T0 + dt.timedelta(minutes=rnd.randrange(0, 6000))
        out.append((i, key, t, None if rnd.random() < 0.1 else round(rnd.uniform(-50, 50), 2)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "id LONG, k LONG, ts TIMESTAMP, v DOUBLE").cache()


def same(a, b, *cols):
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    got, want = key(a), key(b)
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert all(p == q or (p is not None and q is not None and abs(p - q) < 1e-9) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_equals_plain_window(data, reverse, exclusive):
    v = F.col("v")
    got = running(data, ["k"], ["ts", "id"], time_cell("ts", "7 hours"), reverse=reverse, exclusive=exclusive,
                  s=("sum", v), n=("count", v), hi=("max", v), lo=("min", v), last=("last", v), total=("total_sum", v))
    order = [F.desc("ts"), F.desc("id")] if reverse else [F.asc("ts"), F.asc("id")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    whole = Window.partitionBy("k")
    want = data.withColumns({"s": F.sum(v).over(w), "n": F.count(v).over(w), "hi": F.max(v).over(w), "lo": F.min(v).over(w),
                             "last": F.last(v, True).over(w), "total": F.sum(v).over(whole)})
    same(got, want, "id", "s", "n", "hi", "lo", "last", "total")


def test_running_without_keys(data):
    got = running(data, [], ["ts", "id"], time_cell("ts", "5 hours"), n=("count", F.lit(1)), total=("total_count", F.lit(1)))
    w = Window.orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(got, data.withColumns({"n": F.count(F.lit(1)).over(w), "total": F.lit(900)}), "id", "n", "total")


def test_previous_and_next(data):
    w = Window.partitionBy("k").orderBy("ts", "id")
    got = previous(data, ["k"], ["ts", "id"], time_cell("ts", "3 hours"), p=F.col("v"))
    got = previous(got, ["k"], ["ts", "id"], time_cell("ts", "3 hours"), reverse=True, q=F.col("v"))
    same(got, data.withColumns({"p": F.lag("v").over(w), "q": F.lead("v").over(w)}), "id", "p", "q")


def test_neighbours_across_blocks(data):
    w = Window.partitionBy("k").orderBy("ts", "id")
    got = neighbours(data, ["k"], ["ts", "id"], time_cell("ts"), {
        "a": shift("v", 5), "b": shift("v", -7), "m": lambda win: F.avg("v").over(win(-9, 0))}, before=9, after=7, block=20)
    want = data.withColumns({"a": F.lag("v", 5).over(w), "b": F.lead("v", 7).over(w), "m": F.avg("v").over(w.rowsBetween(-9, 0))})
    same(got, want, "id", "a", "b", "m")
    with pytest.raises(ValueError):
        neighbours(data, ["k"], ["ts", "id"], time_cell("ts"), {}, before=20, block=20)


@pytest.mark.parametrize("reverse", [False, True])
def test_running_over_ranges_equals_plain_window(data, reverse):
    """Without a cell the rows are cut into ranges, in which a hot key spans several."""
    ranged = cut(data, ["k"], ["ts", "id"], rows=50)
    assert ranged.filter("k = 0").select(RANGE).distinct().count() > 3
    assert ranged.filter("k > 0 AND k < 3").agg(F.max(RANGE)).first()[0] <= 2
    order = [F.desc("ts"), F.desc("id")] if reverse else [F.asc("ts"), F.asc("id")]
    w = Window.partitionBy("k").orderBy(*order)
    want = data.withColumns({"s": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "last": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    specs = {"s": ("sum", F.col("v")), "last": ("last", F.col("v"))}
    for got in (running(data, ["k"], ["ts", "id"], reverse=reverse, **specs), running(ranged, ["k"], ["ts", "id"], F.col(RANGE), reverse=reverse, **specs)):
        same(got, want, "id", "s", "last")


def test_ranges_do_not_grow_with_the_rows(data):
    """Ten times the rows at the same keys and times: more ranges, not larger ones."""
    more = data.withColumn("id", F.explode(F.sequence(F.col("id") * 10, F.col("id") * 10 + 9)))
    largest = [cut(df, ["k"], ["ts", "id"], rows=60).groupBy("k", RANGE).count().agg(F.max("count")).first()[0] for df in (data, more)]
    assert max(largest) <= 2 * 60, largest


@pytest.mark.parametrize("order, kinds", [(["t"], "t TIMESTAMP"), (["x"], "x DOUBLE"), (["n"], "n LONG"), (["w"], "w STRING"), (["d", "n"], "d DATE, n LONG"), (["same", "n"], "same TIMESTAMP, n LONG")])
def test_depth_cells_follow_the_order(spark, order, kinds):
    """Cells never decrease along any order, hold at most twice the bound, and split rows of one instant by what comes next."""
    rnd = random.Random(8)
    made = {
        "t": lambda: T0 + dt.timedelta(microseconds=rnd.randrange(0, 3_000_000)), "x": lambda: rnd.choice([rnd.uniform(-1, 1), rnd.uniform(1e6, 1.001e6)]),
        "n": lambda: rnd.randrange(-500, 500), "w": lambda: f"common{rnd.randrange(900)}", "d": lambda: T0.date(), "same": lambda: T0,
    }
    table = [(rnd.choice([1, 1, 1, 2]), *(made[c]() for c in order)) for _ in range(1_500)] + [(3, *(made[c]() for c in order)) for _ in range(15)]
    df = spark.createDataFrame(table, f"k LONG, {kinds}")
    got = [tuple(r) for r in depth_cells(df, ["k"], order, 20, "c").collect()]
    assert sorted(r[:-1] for r in got) == sorted(table)
    for k in (1, 2, 3):
        mine = sorted((r for r in got if r[0] == k), key=lambda r: r[1:-1])
        cells = [r[-1] for r in mine]
        assert cells == sorted(cells) and len({r[1:] for r in mine}) == len({r[1:-1] for r in mine})
        ties = max(sum(x[1:-1] == r[1:-1] for x in mine) for r in mine)
        assert max(cells.count(c) for c in set(cells)) <= 20 + max(20, ties)
    assert {r[-1] for r in got if r[0] == 3} == {0}


def test_busy_day_is_split(spark):
    """All rows of one key within one day, and ten times as many: the largest cell stays."""
    def busy(n):
        return spark.range(n).select(F.lit(1).alias("k"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(80_000_000_000))).alias("ts"), "id")
    largest = [depth_cells(busy(n), ["k"], ["ts", "id"], 300).groupBy(CELL).count().agg(F.max("count")).first()[0] for n in (2_000, 20_000)]
    assert max(largest) <= 600


def test_value_cell_never_decreases(spark):
    values = [-1e300, -12.5, -1.0, -1e-300, 0.0, 1e-300, 0.1, 0.1000001, 1.0, 2.0, 1e300]
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE").withColumn("c", value_cell("v"))
    cells = [r.c for r in df.orderBy("v").collect()]
    assert cells == sorted(cells)


def brute(probes, quotes, pick):
    out = {}
    for pid, k, t, _ in probes:
        best = pick([q for q in quotes if q[1] == k], t)
        out[pid] = None if best is None else best[0]
    return out


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, "2 hours"])
@pytest.mark.parametrize("cell_rows", [1_000_000, 25])
def test_asof_equals_brute_force(spark, direction, exact, tolerance, cell_rows):
    p, q = rows(150, 2), rows(300, 3)
    limit = dt.timedelta(hours=2) if tolerance else dt.timedelta.max

    def pick(cands, t):
        if direction == "backward":
            ok = [c for c in cands if (c[2] <= t if exact else c[2] < t)]
            best = max(ok, key=lambda c: (c[2], c[0]), default=None)
        else:
            ok = [c for c in cands if (c[2] >= t if exact else c[2] > t)]
            best = min(ok, key=lambda c: (c[2], c[0]), default=None)
        return best if best is not None and abs(best[2] - t) <= limit else None

    schema = "id LONG, k LONG, ts TIMESTAMP, v DOUBLE"
    got = asof_join(spark.createDataFrame(p, schema), spark.createDataFrame(q, schema), ["k"], "ts", "ts", {"qid": "id"},
                    seq=["id"], direction=direction, exact=exact, tolerance=tolerance, cell_rows=cell_rows)
    assert {r.id: r.qid for r in got.collect()} == brute(p, q, pick)


@pytest.mark.parametrize("cell_rows", [1_000_000, 20])
def test_asof_nearest_and_anchors(spark, cell_rows):
    p, q = rows(80, 4), rows(200, 5)
    schema = "id LONG, k LONG, ts TIMESTAMP, v DOUBLE"
    pd_, qd = spark.createDataFrame(p, schema), spark.createDataFrame(q, schema)
    got = asof_nearest(pd_, qd, ["k"], "ts", "ts", {"qt": "ts"}, seq=["id"], cell_rows=cell_rows)
    for r in got.collect():
        gaps = [abs(x[2] - r.ts) for x in q if x[1] == r.k]
        assert (r.qt is None and not gaps) or abs(r.qt - r.ts) == min(gaps)
    wide = asof_anchors(pd_, qd, ["k"], "id", "ts", "ts", "id", {"now": 0, "later": 7200}, seq=["id"], cell_rows=cell_rows)
    for r in wide.collect():
        _, k, t, _ = p[r.id]
        for name, s in (("now", 0), ("later", 7200)):
            ok = [x for x in q if x[1] == k and x[2] <= t + dt.timedelta(seconds=s)]
            assert getattr(r, name) == (max(ok, key=lambda x: (x[2], x[0]))[0] if ok else None)


@pytest.mark.parametrize("cell_rows, block_rows, before, after", [(1_000_000, 1_024, 3600, 5400), (30, 4, 3600, 5400), (30, 4, 200_000, 150_000), (50, 1, 400_000, -60)])
def test_window_lookup_equals_brute_force(spark, cell_rows, block_rows, before, after):
    p, q = rows(120, 6), rows(400, 7)
    schema = "id LONG, k LONG, ts TIMESTAMP, v DOUBLE"
    got = window_lookup(spark.createDataFrame(p, schema), spark.createDataFrame(q, schema), ["k"], "id", "ts", "ts", -before, after, cell_rows, block_rows,
                        n=("count", F.col("v")), s=("sum", F.col("v")), hi=("max", F.col("v")), lo=("min", F.col("v")))
    result = {r.id: r for r in got.collect()}
    assert len(result) == len(p)
    for pid, k, t, _ in p:
        vs = [x[3] for x in q if x[1] == k and x[3] is not None and t - dt.timedelta(seconds=before) <= x[2] <= t + dt.timedelta(seconds=after)]
        r = result[pid]
        assert r.n == len(vs) and r.hi == max(vs, default=None) and r.lo == min(vs, default=None)
        assert (r.s is None and not vs) or abs(r.s - sum(vs)) < 1e-9


def test_window_ends_are_inclusive(spark):
    schema = "id LONG, k LONG, ts TIMESTAMP, v DOUBLE"
    p = spark.createDataFrame([(1, 1, T0, None)], schema)
    q = spark.createDataFrame([(i, 1, T0 + dt.timedelta(seconds=s), 1.0) for i, s in enumerate((-11, -10, 0, 10, 11))], schema)
    assert window_lookup(p, q, ["k"], "id", "ts", "ts", -10, 10, n=("count", F.col("v"))).first().n == 3


def test_exact_quantiles(spark, data):
    got = {r.k: r for r in exact_quantiles(data, ["k"], "v", {"a": 0.01, "m": 0.5, "z": 0.99}).collect()}
    upper = {r.k: r.m for r in exact_quantiles(data, ["k"], "v", {"m": 0.5}, method="higher").collect()}
    for k in got:
        v = np.array([r[3] for r in rows() if r[1] == k and r[3] is not None])
        assert np.allclose([got[k].a, got[k].m, got[k].z], np.quantile(v, [0.01, 0.5, 0.99]))
        assert upper[k] == sorted(v)[len(v) // 2]
    single = spark.createDataFrame([(5.0,)], "v DOUBLE")
    assert exact_quantiles(single, [], "v", {"m": 0.5}).first().m == 5.0


def test_bursts_do_not_work_out_their_rows_for_each_count(spark):
    """Openings and members are stored once: the input is read a few times, not once more for each level of cells."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", i, at(i)) for i in range(8)] + [("a", 8, at(500)), ("b", 9, at(3)), (None, 10, at(1)), (None, 11, at(1)), (None, 12, at(1))]
    df = spark.createDataFrame(rows, "k STRING, id LONG, ts TIMESTAMP").mapInPandas(counted, "k STRING, id LONG, ts TIMESTAMP")
    got = bursts(df, ["k"], "id", "ts", 10, 3).select("k", "n", "start_ts", "end_ts").collect()
    assert [tuple(r) for r in got] == [("a", 8, at(0), at(7))]
    assert made.value <= 13 * len(rows)
