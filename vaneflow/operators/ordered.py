"""Ordered computations that survive a hot key.

A plain `Window.partitionBy(key).orderBy(ts)` sends a whole key to one task.  Here every key is cut
into *cells* that never decrease along the order and hold about `CELL_ROWS` rows each, so their number
follows the data; a caller may give a function of the row instead where it bounds the rows by itself
(the days of a month).  The work then has two levels:

1. windows inside (key, cell), so a task holds one cell;
2. one summary row per (key, cell), combined on the map side, prefix-scanned per key and joined back
   on (key, cell), which the first level is already partitioned by.

Results equal the plain window exactly.  Keys and order columns must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

CELL = "_cell"
RANGE = "_range"
#: Rows that a cell is to hold; it may hold up to twice as many.
CELL_ROWS = 1_000_000


def _levels(column: str, kind: str) -> list[Column]:
    """Ever finer micro-cells of one order column, each non-decreasing along it; the last is the value itself."""
    c = F.col(column)
    if kind.startswith("timestamp"):
        micros = F.unix_micros(c.cast("timestamp"))
        return [F.floor(micros / (3600 * 1_000_000)), F.floor(micros / 1_000_000), micros]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return [F.shiftright(c, 16), F.shiftright(c, 8), c]
    if kind in ("float", "double"):
        return [value_cell(c, 4), value_cell(c, 1024), c]
    return [F.substring(c, 1, 2), c] if kind == "string" else [c]


def depth_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = CELL_ROWS, name: str = CELL) -> DataFrame:
    """Add `name`, equi-depth cells of at most about `rows` rows along (keys, order), from counts alone.

    Keys with no more rows than that are one cell; the rows of others are divided evenly.  They are counted by
    micro-cell (the hour of a time, the band of a number), and a micro-cell lies in the cell that the rows before
    it give; those that hold more than an eighth of a cell are counted by the next finer one, down to the values of
    all order columns.  Nothing is sorted or written but the counts of the large keys, whose size decides how they
    join; exact, so the same wherever evaluated.  Only rows that agree in the whole order stay together
    whatever their number."""
    keys, kinds = list(keys), dict(df.dtypes)
    finer = [level for c in order for level in _levels(c, kinds[c])]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.ceil(F.col("_n") / F.ceil(F.col("_n") / rows)).cast("long")
    heavy = counted.filter(F.col("_n") > rows).select(*keys, step.alias("_step"), F.lit(0).cast("long").alias("_rows_before"))
    tags: list[str] = []
    marked, tables = df, []
    for level in finer:
        if heavy.isEmpty():
            break
        known, tag = [*keys, *tags], f"_m{len(tags)}"
        # Of this expression only the keys and order columns are read.
        marked = marked.withColumn(tag, level)
        facts = ["_step", "_rows_before"]
        heavy = stage(heavy.select(*known, *facts), "heavy")
        inside = marked.select(*known, tag)
        inside = inside.join(heavy, known) if known else inside.crossJoin(F.broadcast(heavy))  # without keys this is one row
        along = Window.partitionBy(*known).orderBy(tag).rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("_rows_before") + F.coalesce(F.sum("_n").over(along), F.lit(0))
        counts = inside.groupBy(*known, tag, *facts).agg(F.count(F.lit(1)).alias("_n"))
        counts = stage(counts.select(*known, tag, "_n", "_step", before.alias("_rows_before")), "micro-cells")
        tags.append(tag)
        tables.append(counts.select(*known, tag, F.floor(F.col("_rows_before") / F.col("_step")).cast("long").alias(f"_cell{tag}")))
        heavy = counts.filter(F.col("_n") * 8 > F.col("_step"))
    for table in tables:
        marked = marked.join(table, table.columns[:-1], "left")
    found = [F.col(table.columns[-1]) for table in reversed(tables)]
    return marked.select(*df.columns, F.coalesce(*found, F.lit(0).cast("long")).alias(name))


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = CELL_ROWS) -> DataFrame:
    """Add `_range`, the number of the row's cell within its key, and write the rows once to the shared folder.

    The write ends the lineage: nested ordered steps do not repeat the scans below them."""
    return stage(depth_cells(df, keys, order, rows, RANGE), "ranges")


def time_cell(ts: Column | str, width: str = "1 day") -> Column:
    """Number of the fixed-width time slice that holds `ts`."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(interval_micros(width))).cast("long")


def interval_micros(width: str) -> int:
    amount, unit = width.split()
    scale = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(float(amount) * scale * 1_000_000)


def value_cell(value: Column | str, steps: int = 4096) -> Column:
    """Band number of a double, `steps` bands per doubling, non-decreasing over all finite values."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    magnitude = F.floor((F.log2(F.abs(v) + F.lit(1e-300)) + F.lit(1000.0)) * steps).cast("long")
    return F.signum(v).cast("long") * magnitude


Spec = tuple[str, Column]


def _local(kind: str, value: Column) -> Column:
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](value)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "count":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "sum":
        return F.coalesce(local + carry, local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column | None = None,
    *,
    exclusive: bool = False,
    reverse: bool = False,
    **specs: Spec,
) -> DataFrame:
    """Running aggregates along `order` (all ascending, or all descending with `reverse`).

    A spec is (kind, value) with kind sum, count, max, min, last (newest non-null), next (first non-null from
    here on), or total_sum, total_count, total_max, total_min over the whole key.  `exclusive` leaves the
    current row out.  Without `cell` the rows are cut into ranges first; pass `F.col(RANGE)` to use those of an
    earlier `cut`, or the column that `depth_cells` adds."""
    keys, order = list(keys), list(order)
    value_names = {name: f"_v_{name}" for name in specs}
    work = cut(df, keys, order).withColumnRenamed(RANGE, CELL) if cell is None else df.withColumn(CELL, cell)
    work = work.withColumns({value_names[n]: v for n, (_, v) in specs.items()})

    end = -1 if exclusive else Window.currentRow
    directed = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    inside = Window.partitionBy(*keys, CELL).orderBy(*directed).rowsBetween(Window.unboundedPreceding, end)
    cell_order = F.col(CELL).desc() if reverse else F.col(CELL).asc()
    before = Window.partitionBy(*keys).orderBy(cell_order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(cell_order).rowsBetween(1, Window.unboundedFollowing)
    opposite = [F.col(c).asc() if reverse else F.col(c).desc() for c in order]
    onward = Window.partitionBy(*keys, CELL).orderBy(*opposite).rowsBetween(Window.unboundedPreceding, end)
    whole = Window.partitionBy(*keys)

    local, summary, carry = {}, [], []
    for name, (kind, _) in specs.items():
        value = F.col(value_names[name])
        if kind == "last":
            local[f"_l_{name}"] = F.last(value, ignorenulls=True).over(inside)
            position = F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order]))
            newest = F.min_by(value, position) if reverse else F.max_by(value, position)
            summary.append(newest.alias(name))
            carry.append(F.last(F.col(name), ignorenulls=True).over(before).alias(f"_c_{name}"))
        elif kind == "next":
            local[f"_l_{name}"] = F.last(value, ignorenulls=True).over(onward)
            position = F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order]))
            summary.append((F.max_by(value, position) if reverse else F.min_by(value, position)).alias(name))
            carry.append(F.first(F.col(name), ignorenulls=True).over(after).alias(f"_c_{name}"))
        elif kind.startswith("total_"):
            plain = kind.removeprefix("total_")
            summary.append(_local(plain, value).alias(name))
            merge = "sum" if plain == "count" else plain
            carry.append(_local(merge, F.col(name)).over(whole).alias(f"_c_{name}"))
        else:
            local[f"_l_{name}"] = _local(kind, value).over(inside)
            summary.append(_local(kind, value).alias(name))
            merge = "sum" if kind == "count" else kind
            carry.append(_local(merge, F.col(name)).over(before).alias(f"_c_{name}"))

    carried = work.groupBy(*keys, CELL).agg(*summary).select(*keys, CELL, *carry)
    joined = work.withColumns(local).join(carried, [*keys, CELL], "left")
    results = {}
    for name, (kind, _) in specs.items():
        if kind.startswith("total_"):
            results[name] = F.col(f"_c_{name}")
        else:
            results[name] = _combine(kind, F.col(f"_l_{name}"), F.col(f"_c_{name}"))
    helper = [CELL, *value_names.values(), *local, *[f"_c_{n}" for n in specs]]
    return joined.withColumns(results).drop(*helper)


def previous(df, keys, order, cell=None, *, reverse: bool = False, **cols: Column) -> DataFrame:
    """Values of the row before (after, with `reverse`) along the order; null on the first row."""
    packed = F.struct(*[c.alias(n) for n, c in cols.items()])
    out = running(df, keys, order, cell, exclusive=True, reverse=reverse, _prev=("last", packed))
    return out.withColumns({n: F.col(f"_prev.{n}") for n in cols}).drop("_prev")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column | None,
    exprs: dict[str, Callable[[Callable[[int, int], Column]], Column]] | dict,
    *,
    before: int = 0,
    after: int = 0,
    block: int = 50_000,
    index: str | None = None,
) -> DataFrame:
    """Row-framed windows (lag/lead k, rolling k rows, last k rows) with bounded tasks.

    Rows are numbered with `running`, cut into blocks of `block` rows, and the rows near a block edge
    are copied into the neighbouring block.  Each expression takes `win(lo, hi)` giving the frame."""
    if before + after >= block:
        raise ValueError("block must exceed the frame")
    keys = list(keys)
    numbered = running(df, keys, order, cell, _rn=("count", F.lit(1)))
    own = F.floor((F.col("_rn") - 1) / block).cast("long")
    offset = (F.col("_rn") - 1) % block
    copies = F.array(
        own,
        F.when(offset >= block - before, own + 1) if before else F.lit(None).cast("long"),
        F.when((offset < after) & (own > 0), own - 1) if after else F.lit(None).cast("long"),
    )
    spread = (
        numbered.withColumn("_own", own)
        .withColumn("_block", F.explode(F.filter(copies, lambda b: b.isNotNull())))
    )

    def win(lo: int, hi: int):
        return Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(lo, hi)

    out = spread.withColumns({n: fn(win) for n, fn in exprs.items()}).filter(F.col("_own") == F.col("_block"))
    if index:
        out = out.withColumn(index, F.col("_rn"))
    return out.drop("_rn", "_own", "_block")


def shift(col: str, k: int):
    """Expression for `neighbours`: the value k rows before (k>0) or after (k<0)."""
    return lambda win: F.first(F.col(col)).over(win(-k, -k))
