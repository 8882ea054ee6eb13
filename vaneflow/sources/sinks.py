"""Partitioned sinks, idempotent merges and the run log."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import depth_cells
from ..session import stage


def year_month(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def write_documents(df: DataFrame, path: str, folder: str, name: str, value: str) -> int:
    """One file per row, `path`/folder/name.json, as feeds write their documents; returns how many.

    Spark's writers make a folder for each value that names a file, and several calls of the store for each folder;
    here tasks write with their own file system library, so `path` must be a place that it can open (local or mounted
    paths, HDFS, object stores).  A repeated task writes the same names; files appear under them when whole."""
    uri = re.sub(r"^file:/+", "file:///", path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(uri)
        attempt, made = TaskContext.get().taskAttemptId(), set()
        for batch in batches:
            for place, title, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place not in made:
                    store.create_dir(f"{root}/{place}", recursive=True)
                    made.add(place)
                with store.open_output_stream(f"{root}/{place}/.{title}-{attempt}") as out:
                    out.write(text.encode())
                store.move(f"{root}/{place}/.{title}-{attempt}", f"{root}/{place}/{title}.json")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    store, root = FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)  # also where there are no rows
    return df.select(folder, name, value).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Rows that one file of a sink is to hold.
FILE_ROWS = 1_000_000


def write_partitioned(
    df: DataFrame, path: str, partitions: Sequence[str], sort: Sequence[str] = (), mode: str = "overwrite", file_rows: int = FILE_ROWS,
) -> None:
    """Sorted Parquet in Hive folders; `overwrite` replaces only the partitions present in `df`.

    The write is planned from counts: the rows of each folder decide how many files it gets, cut evenly along
    `sort` (else along all other columns), so a file holds about `file_rows` rows and a range of the order.
    Each file is written by a task of its own, however hot its folder is."""
    partitions = list(partitions)
    order = list(sort) or [c for c, kind in df.dtypes if c not in partitions and "<" not in kind and kind != "boolean"]
    pieces = depth_cells(df, partitions, order, file_rows, "_piece")
    plan = pieces.groupBy(*partitions, "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    plan = plan.withColumn("_file", F.row_number().over(Window.orderBy(*partitions, "_piece")) - 1)
    plan = stage(plan.drop("_rows"), "write-plan")  # a row for each file
    same = [pieces[c].eqNullSafe(plan[c]) for c in (*partitions, "_piece")]
    placed = pieces.join(plan, reduce(lambda a, b: a & b, same)).select(*[pieces[c] for c in df.columns], plan["_file"])
    out = placed.repartitionById(max(1, plan.count()), F.col("_file").cast("int"))
    if order:
        out = out.sortWithinPartitions(*partitions, *order)
    (
        out.drop("_file").write.mode(mode).partitionBy(*partitions).option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def partition_filter(lo: str, hi: str, year: str = "year", month: str = "month") -> Column:
    """Year and month filter covering a date range, so that only those folders are listed."""
    (y0, m0), (y1, m1) = [tuple(int(x) for x in d.split("-")[:2]) for d in (lo, hi)]
    index = F.col(year) * 12 + F.col(month)
    return F.col(year).between(y0, y1) & index.between(y0 * 12 + m0, y1 * 12 + m1)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: Sequence[str] = ()) -> DataFrame:
    """Append with column drift and keep one row per key: the new batch wins, then the newest row."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(*keys).orderBy(F.desc("_p"), *[F.desc(c) for c in newest])
    return both.withColumn("_rn", F.row_number().over(latest)).filter("_rn <= 1").drop("_rn", "_p")


def merge_partitions(
    new: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str], schema: str, newest: Sequence[str] = (), file_rows: int = FILE_ROWS,
) -> DataFrame:
    """`upsert` the batch into the table at `path`, touching only the folders that the batch has rows of.

    The partition columns must be the same for all rows of a key.  The folders are read, merged and staged;
    if any of them would hold fewer rows than before nothing is written.  Other folders keep their files.
    Returns partitions, rows_before and rows_after of the touched folders; repeating a batch changes no rows."""
    spark, partitions = new.sparkSession, list(partitions)
    touched = stage(new.select(*partitions).distinct(), "touched")
    stored = spark.read.schema(schema).option("basePath", path).parquet(path)
    old = stored.join(F.broadcast(touched), partitions, "left_semi") if touched.count() <= SMALL_BATCH else stored.join(touched, partitions, "left_semi")
    merged = stage(upsert(old, new, keys, newest), "merged")
    counts = lambda df, name: df.groupBy(*partitions).agg(F.count(F.lit(1)).alias(name))
    report = counts(merged, "rows_after").join(counts(old, "rows_before"), partitions, "left").select(*partitions, F.coalesce("rows_before", F.lit(0)).alias("rows_before"), "rows_after")
    report = stage(report, "merge-report")
    shrunk = report.filter("rows_after < rows_before")
    if not shrunk.isEmpty():
        raise ValueError(f"refusing to shrink {shrunk.first()}")
    write_partitioned(merged, path, partitions, file_rows=file_rows)
    return report


#: Touched folders that may be sent to every task, so that only they are listed and read.
SMALL_BATCH = 10_000


def replace_table(df: DataFrame, target: str, current: DataFrame | None, partitions: Sequence[str] = ()) -> int:
    """Write to `target` after checking that the table does not shrink.  Returns the row count."""
    counted = df.agg(F.count(F.lit(1))).first()[0]
    if current is not None and counted < current.count():
        raise ValueError("refusing to shrink the table")
    df.write.mode("overwrite").partitionBy(*partitions).parquet(target)
    return counted


def newer_than(df: DataFrame, stored: DataFrame, ts: str) -> DataFrame:
    """Rows later than anything stored; everything when nothing is stored."""
    return df.filter(F.col(ts) > F.coalesce(stored.agg(F.max(ts)).scalar(), F.lit("0001-01-01").cast("timestamp")))


RUNS_SCHEMA = "run STRING, source STRING, status STRING, rows_written LONG, rows_null_key LONG, started_at TIMESTAMP, finished_at TIMESTAMP"


def write_with_manifest(df: DataFrame, path: str, runs_path: str, run: str, source: str, key: str) -> None:
    """Write a table and append a row to the runs table.

    The counts are those of the written table, read from its key column alone."""
    spark: SparkSession = df.sparkSession
    started = datetime.now(timezone.utc)
    status, written, null_keys = "failed", 0, 0
    try:
        df.write.mode("overwrite").parquet(path)
        stored = spark.read.schema(df.schema).parquet(path)
        written, null_keys = stored.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
        status = "ok"
    finally:
        row = [(run, source, status, written, null_keys, started, datetime.now(timezone.utc))]
        spark.createDataFrame(row, RUNS_SCHEMA).coalesce(1).write.mode("append").parquet(runs_path)


def write_sources_with_manifest(df: DataFrame, path: str, runs_path: str, run: str, source: str, key: str, sort: Sequence[str] = ()) -> None:
    """Write a table in a folder per source and append a row for each source to the runs table.

    All sources are written by one job and counted by one aggregation over what was written.  If the write
    fails, the sources of `df` are logged as failed, with no rows, and the error is passed on."""
    spark: SparkSession = df.sparkSession
    started = datetime.now(timezone.utc)
    text = lambda c: c.cast("string")
    try:
        write_partitioned(df, path, [source], sort)
        stored = spark.read.schema(df.schema).parquet(path)
        counts = stored.groupBy(text(F.col(source)).alias("source")).agg(F.count(F.lit(1)).alias("rows_written"), F.count_if(F.col(key).isNull()).alias("rows_null_key"))
        status = "ok"
    except Exception:
        counts = df.select(text(F.col(source)).alias("source")).distinct().withColumns({"rows_written": F.lit(0).cast("long"), "rows_null_key": F.lit(0).cast("long")})
        status = "failed"
        raise
    finally:
        ended = datetime.now(timezone.utc)
        logged = counts.select(F.concat_ws("-", F.lit(run), "source").alias("run"), "source", F.lit(status).alias("status"), "rows_written", "rows_null_key",
                               F.lit(started).alias("started_at"), F.lit(ended).alias("finished_at"))
        logged.write.mode("append").parquet(runs_path)
