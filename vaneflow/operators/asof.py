"""As-of joins and window lookups built on ordered scans instead of inequality joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .ordered import CELL, CELL_ROWS, depth_cells, interval_micros, running


def _side(df: DataFrame, keys, time: str, seq: Sequence[str], rank: int, payload: Column | None, name: str):
    cols = [F.col(k) for k in keys]
    cols += [F.col(time).alias("_t"), F.lit(rank).alias("_s")]
    cols += [F.col(c).alias(f"_o{i}") for i, c in enumerate(seq)]
    return df.select(*cols, payload.alias(name))


def _stack(probes: DataFrame, data: DataFrame, on, probe_time: str, data_time: str, row: Column, seq, probe_rank: int, data_rank: int, cell_rows: int):
    """Both sides in one table, with the columns that order it and cells of bounded rows."""
    left = _side(probes, on, probe_time, (), probe_rank, F.struct("*"), "_p")
    right = _side(data, on, data_time, seq, data_rank, row, "_q").filter(F.col("_t").isNotNull())
    stacked = left.unionByName(right, allowMissingColumns=True)
    for i in range(len(seq)):
        kind = dict(stacked.dtypes)[f"_o{i}"]
        stacked = stacked.withColumn(f"_o{i}", F.coalesce(F.col(f"_o{i}"), F.lit(0 if kind != "string" else "").cast(kind)))
    order = ["_t", "_s", *[f"_o{i}" for i in range(len(seq))]]
    return depth_cells(stacked, on, order, cell_rows), order


def _gap(kind: str, tolerance: str, at: str) -> tuple[Column, Column]:
    """Distance between the probe and the matched row, and its limit."""
    if kind.startswith("timestamp"):
        return F.abs(F.unix_micros("_t") - F.unix_micros(at)), F.lit(interval_micros(tolerance))
    return F.abs(F.col("_t") - F.col(at)), F.lit(float(tolerance))


def asof_join(
    probes: DataFrame,
    data: DataFrame,
    on: Sequence[str],
    probe_time: str,
    data_time: str,
    values: dict[str, str],
    *,
    seq: Sequence[str] = (),
    direction: str = "backward",
    exact: bool = True,
    tolerance: str | None = None,
    how: str = "left",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Attach to each probe the newest data row at or before it (or the first at or after it).

    `values` maps output names to data columns; use it to bring the data time along.  `seq` orders
    data rows of equal time: the last one wins backward, the first one forward.  Both sides are
    stacked and scanned once in equi-depth cells of about `cell_rows` rows, so nothing is paired up and a
    hot key is split, however many of its rows fall into a day."""
    backward = direction == "backward"
    data_rank, probe_rank = (0, 1) if backward == exact else (1, 0)
    row = F.struct(*[F.col(c).alias(n) for n, c in values.items()], F.col(data_time).alias("_at"))
    stacked, order = _stack(probes, data, on, probe_time, data_time, row, seq, probe_rank, data_rank, cell_rows)
    out = running(stacked, on, order, F.col(CELL), reverse=not backward, _m=("last", F.col("_q")))
    out = out.filter(F.col("_p").isNotNull())
    match = F.col("_m")
    if tolerance is not None:
        gap, limit = _gap(dict(stacked.dtypes)["_t"], tolerance, "_m._at")
        match = F.when(gap <= limit, match)
    out = out.select("_p.*", match.alias("_m"))
    if how == "inner":
        out = out.filter(F.col("_m").isNotNull())
    keep = [c for c in probes.columns if c not in values]
    return out.select(*keep, *[F.col(f"_m.{n}").alias(n) for n in values])


def asof_many(
    probes: DataFrame, sources: dict[str, tuple[DataFrame, str, str, str]], on: Sequence[str], probe_time: str, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Newest row at or before each probe from several tables with the same key, in one scan.

    `sources` maps an output name to (table, time column, value column, look-back)."""
    stacked = _side(probes, on, probe_time, (), 1, F.struct("*"), "_p")
    for name, (data, time, value, _) in sources.items():
        row = F.struct(F.col(value).alias("v"), F.col(time).alias("at"))
        stacked = stacked.unionByName(_side(data, on, time, (), 0, row, f"_q_{name}"), allowMissingColumns=True)
    specs = {f"_m_{name}": ("last", F.col(f"_q_{name}")) for name in sources}
    cells = depth_cells(stacked, on, ["_t", "_s"], cell_rows)
    out = running(cells, on, ["_t", "_s"], F.col(CELL), **specs).filter(F.col("_p").isNotNull())
    picks = []
    for name, (_, _, _, look_back) in sources.items():
        age = F.unix_micros("_t") - F.unix_micros(f"_m_{name}.at")
        picks.append(F.when(age <= interval_micros(look_back), F.col(f"_m_{name}.v")).alias(name))
    return out.select("_p.*", *picks)


def asof_nearest(probes, data, on, probe_time, data_time, values, *, seq=(), tolerance=None, cell_rows: int = CELL_ROWS):
    """Row with the least absolute time distance; the earlier one on a tie.  Both directions come from one scan."""
    row = F.struct(*[F.col(c).alias(n) for n, c in values.items()], F.col(data_time).alias("_at"))
    # Data before the probe at equal times: such a row is found looking back, at no distance.
    stacked, order = _stack(probes, data, on, probe_time, data_time, row, seq, 1, 0, cell_rows)
    out = running(stacked, on, order, F.col(CELL), _b=("last", F.col("_q")), _f=("next", F.col("_q"))).filter(F.col("_p").isNotNull())
    kind = dict(stacked.dtypes)["_t"]
    limited = {}
    for side in ("_b", "_f"):
        gap, limit = _gap(kind, tolerance or "0 second", f"{side}._at")
        limited[f"{side}_gap"] = gap if tolerance is None else F.when(gap <= limit, gap)
    out = out.withColumns(limited)
    use_back = F.col("_b_gap").isNotNull() & (F.col("_f_gap").isNull() | (F.col("_b_gap") <= F.col("_f_gap")))
    match = F.when(use_back, F.col("_b")).when(F.col("_f_gap").isNotNull(), F.col("_f"))
    keep = [c for c in probes.columns if c not in values]
    return out.select("_p.*", match.alias("_m")).select(*keep, *[F.col(f"_m.{n}").alias(n) for n in values])


def asof_anchors(
    probes: DataFrame, data: DataFrame, on, probe_id: str, probe_time: str, data_time: str, value: str,
    anchors: dict[str, int], *, seq=(), direction: str = "backward", cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Value at several second offsets from each probe: one scan, one column per anchor."""
    offsets = F.array(*[F.struct(F.lit(n).alias("anchor"), F.lit(s).alias("s")) for n, s in anchors.items()])
    exploded = (
        probes.select(probe_id, *[k for k in on if k != probe_id], probe_time)
        .withColumn("_a", F.explode(offsets))
        .withColumn("_at_anchor", F.timestamp_micros(F.unix_micros(probe_time) + F.col("_a.s").cast("long") * 1_000_000))
        .withColumn("_anchor", F.col("_a.anchor")).drop("_a")
    )
    hit = asof_join(exploded, data, on, "_at_anchor", data_time, {"_val": value}, seq=seq, direction=direction, cell_rows=cell_rows)
    wide = hit.groupBy(probe_id).agg(
        *[F.max(F.when(F.col("_anchor") == n, F.col("_val"))).alias(n) for n in anchors]
    )
    return wide


#: Data rows in the arrays that an interval's two ends fall into.
BLOCK_ROWS = 1_024


def _fold(kind: str, values: Column) -> Column:
    """Aggregate an array, nulls left out; null where nothing is left."""
    if kind == "max":
        return F.array_max(values)
    if kind == "min":
        return F.array_min(values)
    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x, x.cast("double")))


def window_lookup(
    probes: DataFrame,
    data: DataFrame,
    on: Sequence[str],
    probe_id: str,
    probe_time: str,
    data_time: str,
    lo_seconds: float,
    hi_seconds: float,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    **aggs: tuple[str, Column],
) -> DataFrame:
    """Aggregate the data rows in [t+lo, t+hi], both ends included, for every probe.

    Nothing is as wide as the interval.  The ends of all intervals are stacked with the data and numbered in one
    running scan, so an interval becomes a stretch of numbers and a count the difference of two running counts.
    For other aggregates the numbered rows of a key are laid into blocks of `block_rows`, and the blocks
    into a tree of powers of two: a stretch is a part of a block at each end and, in between, at most two
    nodes of each level.  `aggs` maps names to (sum|count|max|min, data column), sums are doubles; a probe
    without data gets null, or 0 for counts."""
    on = list(on)
    keys = [F.col(k) for k in on]
    ends = F.array(
        F.struct(F.lit(0).alias("_s"), F.lit(int(lo_seconds * 1_000_000)).cast("long").alias("d")),
        F.struct(F.lit(2).alias("_s"), F.lit(int(hi_seconds * 1_000_000)).cast("long").alias("d")),
    )
    marks = (
        probes.select(*keys, F.col(probe_id).alias("_id"), F.unix_micros(probe_time).alias("_pt"), F.explode(ends).alias("_e"))
        .select(*keys, "_id", F.timestamp_micros(F.col("_pt") + F.col("_e.d")).alias("_u"), F.col("_e._s").alias("_s"))
    )
    rows = data.select(
        *keys, F.col(data_time).alias("_u"), F.lit(1).alias("_s"),
        *[c.alias(f"_v_{n}") for n, (_, c) in aggs.items()],
    )
    # Data rows of one time are told apart by their values, so their numbers do not change between evaluations.
    stacked = marks.unionByName(rows, allowMissingColumns=True).withColumn("_h", F.when(F.col("_s") == 1, F.xxhash64(*[f"_v_{n}" for n in aggs])).otherwise(0))
    order = ["_u", "_s", "_h"]
    counts = {f"_n_{n}": ("count", F.col(f"_v_{n}")) for n, (kind, _) in aggs.items() if kind == "count"}
    others = {n: kind for n, (kind, _) in aggs.items() if kind != "count"}
    place = {"_pos": ("count", F.when(F.col("_s") == 1, 1))} if others else {}
    numbered = running(depth_cells(stacked, on, order, cell_rows), on, order, F.col(CELL), **counts, **place)
    if others:
        numbered = stage(numbered.select(*on, "_id", "_s", *counts, *place, *[f"_v_{n}" for n in others]), "numbered")
    at = lambda end, c: F.max(F.when(F.col("_s") == end, F.col(c)))
    spans = numbered.filter(F.col("_s") != 1).groupBy("_id", *on).agg(
        *[(at(2, f"_n_{n}") - at(0, f"_n_{n}")).alias(n) for n, (kind, _) in aggs.items() if kind == "count"],
        *([(at(0, "_pos")).alias("_from"), at(2, "_pos").alias("_to")] if others else []),
    )
    if not others:
        return spans.drop(*on).withColumnRenamed("_id", probe_id).select(probe_id, *aggs)
    parts = _stretches(spans.filter("_from < _to"), numbered.filter(F.col("_s") == 1), on, others, block_rows)
    merge = {"sum": F.sum, "max": F.max, "min": F.min}
    folded = parts.groupBy("_id").agg(*[merge[k](n).alias(n) for n, k in others.items()])
    return spans.drop(*on, "_from", "_to").join(folded, "_id", "left").withColumnRenamed("_id", probe_id).select(probe_id, *aggs)


def _stretches(spans: DataFrame, data: DataFrame, on: list[str], kinds: dict[str, str], size: int) -> DataFrame:
    """Aggregates of parts that make up the rows numbered _from + 1 to _to of each key, for every _id."""
    in_block = F.sort_array(F.collect_list(F.struct(F.col("_pos"), *[F.col(f"_v_{n}") for n in kinds])))
    blocks = data.groupBy(*on, F.floor((F.col("_pos") - 1) / size).cast("long").alias("_b")).agg(in_block.alias("_rows"))
    blocks = blocks.select(*on, "_b", *[F.col("_rows")[f"_v_{n}"].alias(n) for n in kinds])
    blocks = stage(blocks, "blocks")
    ends = spans.select("_id", *on, F.floor(F.col("_from") / size).cast("long").alias("_b0"), F.floor((F.col("_to") - 1) / size).cast("long").alias("_b1"), "_from", "_to")
    first = F.struct(F.col("_b0").alias("_b"), F.col("_from").alias("_lo"), F.least(F.col("_to"), (F.col("_b0") + 1) * size).alias("_hi"))
    last = F.struct(F.col("_b1").alias("_b"), (F.col("_b1") * size).alias("_lo"), F.col("_to").alias("_hi"))
    edges = ends.select("_id", *on, F.inline(F.when(F.col("_b0") == F.col("_b1"), F.array(first)).otherwise(F.array(first, last))))
    start, length = (F.col("_lo") - F.col("_b") * size + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int")
    met = edges.join(blocks, [*on, "_b"])
    parts = met.select("_id", *[_fold(k, F.slice(n, start, length)).alias(n) for n, k in kinds.items()])
    top = blocks.agg(F.max("_b")).first()[0] or 0
    if top < 2:
        return parts
    # Node i of level j holds the blocks from i * 2^j on; the stretch l to r takes an odd l and the one before an odd r.
    merge = {"sum": F.sum, "max": F.max, "min": F.min}
    levels = F.sequence(F.lit(0), F.lit(int(top).bit_length() - 1))
    single = blocks.select(*on, "_b", *[_fold(k, F.col(n)).alias(n) for n, k in kinds.items()])
    tree = single.withColumn("_j", F.explode(levels)).groupBy(*on, "_j", F.expr("shiftright(_b, _j)").alias("_i")).agg(*[merge[k](n).alias(n) for n, k in kinds.items()])
    inner = ends.filter("_b0 + 1 < _b1").select("_id", *on, (F.col("_b0") + 1).alias("_l"), F.col("_b1").alias("_r"), F.explode(levels).alias("_j"))
    inner = inner.withColumns({"_l": F.expr("shiftright(_l + shiftleft(1L, _j) - 1, _j)"), "_r": F.expr("shiftright(_r, _j)")}).filter("_l < _r")
    odd = lambda c: F.col(c) % 2 == 1
    taken = F.filter(F.array(F.when(odd("_l"), F.col("_l")), F.when(odd("_r"), F.col("_r") - 1)), lambda x: x.isNotNull())
    nodes = inner.select("_id", *on, "_j", F.explode(taken).alias("_i"))
    return parts.unionByName(nodes.join(tree, [*on, "_j", "_i"]).select("_id", *kinds))
