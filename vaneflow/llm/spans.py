"""Places of regular-expression matches as native columns.

Spark has no function that gives the places of all matches.  The matches and the gaps between them
alternate, though, so their lengths add up to the places: `regexp_extract_all` gives the ones, `split` the
others.  Lengths are code points.  Patterns here are possessive, so no text makes them backtrack far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,stop:bigint,kind:int,text:string>>"


def matches(text: Column, pattern: str, order: int) -> Column:
    """All matches, left to right, as (start, stop, kind, text); kind is `order`, the place of the kind in its list."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["g"])
        stop = start + F.length(pair["m"])
        span = F.struct(start.alias("start"), stop.alias("stop"), F.lit(order).alias("kind"), pair["m"].alias("text"))
        return F.struct(stop.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
    named = F.transform(pairs, lambda p: F.struct(p["m"].alias("m"), p["g"].alias("g")))
    return F.aggregate(named, zero, step)["spans"]


def spans_where(text: Column, likely: Column, pattern: str, order: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """`matches` of the texts that pass the cheap test `likely`, without those whose matched text is not `valid`."""
    found = matches(text, pattern, order)
    if valid is not None:
        found = F.filter(found, lambda s: valid(s["text"]))
    return F.when(likely, found).otherwise(F.array().cast(SPAN))


def span_list(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind, then end, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    # Structs order by their fields: start, kind, stop.
    sortable = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(sortable, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")
