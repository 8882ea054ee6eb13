"""Connected components by alternating stars; nothing but edges is ever held, and no vertex's edges meet in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of each vertex on the least of them: the larger ones, or the smaller ones and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): every vertex of `edges` (u, v) but the roots, with the least vertex that it reaches.

    Self-loops and repeated edges do no harm; no edges give no rows."""
    work, seen = stage(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "edges"), None
    while True:
        state = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return work.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = state
        work = stage(_star(_star(work, large=True), large=False), "edges")
