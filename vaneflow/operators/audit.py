"""Data-quality audits: lists of rules evaluated in one pass, spines, parity and schema checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stage
from .joins import diff_tables
from .ordered import interval_micros, running


@dataclass(frozen=True)
class Rule:
    """`bad` marks offending rows; up to `allowed` of all rows may be bad; `severity` names the failing status."""

    check: str
    level: int
    bad: Column
    allowed: float = 0.0
    severity: str = "fail"


def audit(df: DataFrame, rules: Sequence[Rule], by: Sequence[str] = ()) -> DataFrame:
    """All rules in one aggregation: rows (check, level, status, n_bad, n_total) per group."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), *[F.count_if(r.bad).alias(f"_b{i}") for i, r in enumerate(rules)])
    rows = F.array(*[
        F.struct(
            F.lit(r.check).alias("check"), F.lit(r.level).alias("level"),
            F.when(F.col(f"_b{i}") <= F.col("n_total") * r.allowed, "ok").otherwise(r.severity).alias("status"),
            F.col(f"_b{i}").alias("n_bad"),
        )
        for i, r in enumerate(rules)
    ])
    return counts.select(*by, "n_total", F.inline(rows))


def bounds_rules(bounds: dict[str, tuple[float, float]], level: int = 3) -> list[Rule]:
    """Per column: outside its physical range, NaN, and null."""
    rules = []
    for name, (lo, hi) in bounds.items():
        c = F.col(name)
        rules += [
            Rule(f"{name} in range", level, ~c.between(lo, hi) & ~F.isnan(c)), Rule(f"{name} not nan", level, F.isnan(c)),
            Rule(f"{name} not null", level, c.isNull()),
        ]
    return rules


def missing(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")


def time_spine(df: DataFrame, keys: Sequence[str], ts: str, step: str, until: Column | None = None, out: str = "slot") -> DataFrame:
    """Every slot a key should have, from its first to its last (or up to `until`); `step` like "1 hour".

    Grown in two steps, stretches of a thousand slots and then slots, so no array spans a whole history."""
    micros = interval_micros(step.lower())
    ends = df.groupBy(*keys).agg(F.unix_micros(F.min(ts)).alias("_lo"), F.max(ts).alias("_hi"))
    last = F.unix_micros("_hi") if until is None else F.least(F.unix_micros("_hi"), F.unix_micros(until))
    stretches = ends.withColumn("_hi", last).filter("_lo <= _hi").withColumn("_at", F.explode(F.expr(f"sequence(_lo, _hi, {micros * 1000}L)")))
    stretches = stretches.withColumn("_hi", F.least(F.col("_hi"), F.col("_at") + micros * 999))
    return stretches.select(*keys, F.explode(F.expr(f"sequence(_at, _hi, {micros}L)")).alias("_u")).select(*keys, F.timestamp_micros("_u").alias(out))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def null_parity(raw: DataFrame, processed: DataFrame, raw_null: dict[str, Column], columns: Sequence[str]) -> DataFrame:
    """Null counts of each column before and after processing."""
    def tall(df, name, tests):
        sums = df.agg(*[F.count_if(tests[c]).alias(c) for c in columns])
        return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias(name)) for c in columns])))

    before = tall(raw, "raw_nulls", raw_null)
    after = tall(processed, "processed_nulls", {c: F.col(c).isNull() for c in columns})
    return before.join(after, "column_name").withColumn("ok", F.col("raw_nulls") == F.col("processed_nulls"))


def count_reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two tables with `n` per key, compared; keys present on one side only count as zero on the other."""
    joined = left.withColumnRenamed("n", "recorded").join(right.withColumnRenamed("n", "actual"), list(keys), "full")
    return joined.select(*keys, F.coalesce("recorded", F.lit(0)).alias("recorded"), F.coalesce("actual", F.lit(0)).alias("actual")).withColumn(
        "ok", F.col("recorded") == F.col("actual"))


def evenly_spaced(files: DataFrame, name: str, n: int) -> DataFrame:
    """About n file names spread over the sorted list, always with the first and the last; all of them for n of 0 or less."""
    ordered = files.select(name).distinct()
    if n <= 0:
        return ordered
    total = ordered.agg(F.count(F.lit(1))).scalar()
    step = F.greatest(F.lit(1), F.floor(total / n))
    # File lists are small next to the data; the position comes from a count along the sorted names.
    ranked = running(ordered, [], [name], _i=("count", F.lit(1)))
    i = F.col("_i") - 1
    keep = ((i % step == 0) & (F.floor(i / step) < n)) | (i == total - 1)
    return ranked.filter(keep).select(name)


def compare_schema(actual: StructType, expected: StructType) -> list[str]:
    """Missing columns and differing types, by name."""
    have = {f.name: f.dataType for f in actual}
    problems = [f"missing {f.name}" for f in expected if f.name not in have]
    problems += [
        f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}"
        for f in expected if f.name in have and have[f.name] != f.dataType
    ]
    return problems


def value_fidelity(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], file: str, tolerance: float = 1e-6) -> DataFrame:
    """`diff_tables` over all rows, at the cost of the files that differ.

    Both sides are reduced to a digest per file: the number of rows and an order-free sum of their hashes.  Only
    files whose digests differ are compared row by row; the rows of the others are equal and counted as such."""
    def digest(df: DataFrame, side: str) -> DataFrame:
        row = F.xxhash64(*keys, *columns).cast("decimal(38,0)")
        return df.groupBy(F.col(file).alias("_file")).agg(F.count(F.lit(1)).alias(f"n_{side}"), F.sum(row).alias(f"h_{side}"))

    a, b = digest(left, "left"), digest(right, "right")
    both = a.join(b.withColumnRenamed("_file", "_other"), a["_file"].eqNullSafe(F.col("_other")), "full")
    equal = F.col("n_left").eqNullSafe(F.col("n_right")) & F.col("h_left").eqNullSafe(F.col("h_right"))
    digests = stage(both.select(F.coalesce("_file", "_other").alias("_file"), "n_left", equal.alias("_equal")), "digests")
    differing = digests.filter("not _equal").select("_file")
    suspect = [df.join(differing, df[file].eqNullSafe(differing["_file"]), "left_semi") for df in (left, right)]
    same = digests.filter("_equal").agg(F.coalesce(F.sum("n_left"), F.lit(0))).scalar()
    return diff_tables(*suspect, keys, columns, tolerance).withColumn("n_both", F.col("n_both") + same)


def schema_audit(tables: dict[str, DataFrame], expected: StructType) -> DataFrame:
    """(source, column_name, expected, actual, n, ok) for every expected or found column of every table.

    Types are compared by name; `missing` stands for a column that a table lacks, `extra` for one that none
    should have; n is the number of rows that stand behind the finding."""
    parts = []
    for source, df in tables.items():
        have = {f.name: f.dataType.simpleString() for f in df.schema}
        want = {f.name: f.dataType.simpleString() for f in expected}
        faults = {problem.removeprefix("missing ").split(":")[0] for problem in compare_schema(df.schema, expected)}
        rows = [(c, want.get(c, "extra"), have.get(c, "missing"), c in want and c not in faults) for c in sorted({*have, *want})]
        found = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(w).alias("expected"), F.lit(h).alias("actual"), F.lit(ok).alias("ok")) for c, w, h, ok in rows])
        parts.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(source).alias("source"), "n", F.inline(found)))
    return reduce(DataFrame.unionByName, parts)


def ratio_fidelity(base: DataFrame, finer: DataFrame, key: str, lead: str, ratio: int, leads: Sequence[int]) -> DataFrame:
    """Per key: rows of both tables, whether the finer one has `ratio` for each of the base, and exactly the given leads."""
    n = lambda df, name, *more: df.groupBy(key).agg(F.count(F.lit(1)).alias(name), *more)
    found = F.array_sort(F.collect_set(F.col(lead)))  # bounded by the distinct leads of the feed
    both = n(base, "n_base").join(n(finer, "n_finer", found.alias("_leads")), key, "full")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    wanted = F.array(*[F.lit(x).cast(dict(finer.dtypes)[lead]) for x in sorted(leads)])
    return both.select(key, count("n_base").alias("n_base"), count("n_finer").alias("n_finer"), F.coalesce(F.array_join(F.col("_leads").cast("array<string>"), ","), F.lit("")).alias("leads"),
                       (count("n_finer") == ratio * count("n_base")).alias("rows_ok"), F.coalesce(F.col("_leads") == wanted, F.lit(False)).alias("leads_ok"))
