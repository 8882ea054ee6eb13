"""Join patterns that keep their work proportional to the inputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .asof import asof_join


def bucket_membership(
    rows: DataFrame, buckets: DataFrame, on: Sequence[str], value: str, lo: str, hi: str, carry: Sequence[str] = (),
) -> DataFrame:
    """Attach the bucket [lo, hi] that holds the value; buckets of one group do not overlap.

    The bucket is the one with the greatest lower bound at or below the value, so this is an as-of
    lookup along the value axis rather than a range join."""
    names = {lo: lo, hi: hi} | {c: c for c in carry}
    found = asof_join(rows, buckets, on, value, lo, names)
    return found.filter(F.col(hi).isNotNull() & (F.col(value) <= F.col(hi)))


def diff_tables(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-6
) -> DataFrame:
    """Null-safe value comparison of two tables on their key: one row per column with counts."""
    a = left.select(*keys, F.struct(*columns).alias("_a"))
    b = right.select(*keys, F.struct(*columns).alias("_b"))
    joined = a.join(b, list(keys), "full")
    types = dict(left.select(*columns).dtypes)

    def differs(c: str):
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        unequal = ~x.eqNullSafe(y)
        if types[c] in ("double", "float"):
            unequal = F.coalesce(F.abs(x - y) > tolerance, unequal)
        return F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & unequal)

    sums = joined.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("n_left_only"),
        F.count_if(F.col("_a").isNull()).alias("n_right_only"),
        *[differs(c).alias(f"_d_{c}") for c in columns],
    )
    per_column = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_d_{c}").alias("n_diff")) for c in columns])
    return sums.select("n_both", "n_left_only", "n_right_only", F.inline(per_column))


def offset_partner(ladder: DataFrame, picks: DataFrame, group: str, index: str, offset: int, cols: Sequence[str]) -> DataFrame:
    """Bucket `offset` places from each pick, by an equi join on the computed index."""
    target = picks.withColumn("_want", F.col(index) + F.lit(offset))
    partner = ladder.select(
        F.col(group), F.col(index).alias("_want"), *[F.col(c).alias(f"partner_{c}") for c in cols]
    )
    return target.join(partner, [group, "_want"]).withColumnRenamed("_want", f"partner_{index}")


#: Rows of one slot that meet in one task, on either side.
SLOT_ROWS = 2_000


def near_runs(a: DataFrame, b: DataFrame, on: Sequence[str], a_time: str, b_time: str, seconds: int, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Rows of both sides with equal keys and times at most `seconds` apart.

    The time slice joins as a key, so only neighbouring rows meet.  A slot with more than `slot_rows` rows on a
    side is cut into blocks there, and the other side's rows go to all of them: every pair meets once."""
    slot = F.floor(F.unix_seconds(a_time) / seconds)
    left = a.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    right = b.withColumn("_slot", F.floor(F.unix_seconds(b_time) / seconds))
    places = [*on, "_slot"]
    blocks = F.ceil(F.col("_n") / slot_rows).cast("int")
    counts = [df.groupBy(*places).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > slot_rows).select(*places, blocks.alias(c)) for df, c in ((left, "_ba"), (right, "_bb"))]
    hot = stage(counts[0].join(counts[1], places, "full"), "hot-slots")
    dealt = []
    for df, own, other, i, j in ((left, "_ba", "_bb", "_i", "_j"), (right, "_bb", "_ba", "_j", "_i")):
        number = lambda c: F.coalesce(F.col(c), F.lit(1))
        mine = F.pmod(F.xxhash64(*df.columns), number(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), number(other) - 1))
        dealt.append(df.join(hot, places, "left").withColumn(i, mine).withColumn(j, every).drop("_ba", "_bb"))
    close = F.abs(F.unix_micros(a_time) - F.unix_micros(b_time)) <= seconds * 1_000_000
    return dealt[0].join(dealt[1], [*places, "_i", "_j"]).filter(close).drop("_slot", "_i", "_j")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
