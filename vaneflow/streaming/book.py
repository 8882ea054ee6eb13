"""Order-book streams: routing, top of book, and complete-ladder alerts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.pricing import best_ask, best_bid, level_count, mid, spread
from ..operators.ordered import CELL, RANGE, cut, depth_cells, previous, running
from ..session import release, stage


def route_messages(messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Add receive time, hour folder and the slug of each message's token; `tokens` is a static table."""
    received = F.try_to_timestamp("_received_at")
    timed = messages.withColumns({"received_at": received, "hour": F.date_format(received, "yyyy-MM-dd-HH")})
    return timed.join(tokens, "asset_id", "left")


def top_of_book(messages: DataFrame) -> DataFrame:
    """Snapshot and price-change messages to top-of-book rows; works on batches and streams alike."""
    change = F.transform("price_changes", lambda c: F.struct(
        c["asset_id"].alias("asset_id"), c["best_bid"].try_cast("double").alias("best_bid"), c["best_ask"].try_cast("double").alias("best_ask"),
        F.lit(None).cast("int").alias("n_bid_levels"), F.lit(None).cast("int").alias("n_ask_levels")))
    book = F.array(F.struct(
        F.col("asset_id"), best_bid("bids").alias("best_bid"), best_ask("asks").alias("best_ask"),
        level_count("bids").alias("n_bid_levels"), level_count("asks").alias("n_ask_levels")))
    rows = F.when(F.col("event_type") == "book", book).when(F.col("event_type") == "price_change", change)
    return messages.select(
        F.try_to_timestamp("_received_at").alias("received_at"), F.timestamp_millis(F.col("timestamp").try_cast("long")).alias("server_ts"), "event_type",
        F.explode(rows).alias("r"),
    ).select("received_at", "server_ts", "event_type", "r.*").withColumns({"mid": mid("best_bid", "best_ask"), "spread": spread("best_bid", "best_ask")})


def alert_candidates(
    quotes: DataFrame, ladder: str, bucket: str, ts: str, bid: str, seq: str, n_buckets: int, max_age_seconds: float, threshold: float,
) -> DataFrame:
    """Quote changes after which a complete and fresh ladder's bids add up to the threshold.

    No ladder is replayed quote by quote.  Each quote contributes its change of the sum, the first one
    of a bucket completes the ladder by one, and a quote left alone for too long marks its bucket stale
    until the next one: three running sums over (ladder, time) decide."""
    cells, names = cut(quotes, [ladder, bucket], [ts, seq]), [ladder, bucket]
    chain = previous(cells, names, [ts, seq], F.col(RANGE), _prev_bid=F.col(bid), _prev_ts=F.col(ts))
    chain = previous(chain, names, [ts, seq], F.col(RANGE), reverse=True, _next_ts=F.col(ts))
    old = F.unix_micros(ts) + F.lit(int(max_age_seconds * 1e6) + 1)
    goes_stale = F.col("_next_ts").isNull() | (F.unix_micros("_next_ts") >= old)
    quote = F.struct(
        F.unix_micros(ts).alias("u"), F.lit(1).alias("rank"), F.col(seq).alias("s"), (F.col(bid) - F.coalesce("_prev_bid", F.lit(0.0))).alias("d"),
        F.when(F.col("_prev_ts").isNull(), 1).otherwise(0).alias("first"), F.lit(0).alias("stale"))

    def mark(at, delta):
        return F.struct(at.alias("u"), F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("s"), F.lit(0.0).alias("d"), F.lit(0).alias("first"), F.lit(delta).alias("stale"))

    marks = F.filter(F.array(
        quote, F.when(goes_stale, mark(old, 1)), F.when(goes_stale & F.col("_next_ts").isNotNull(), mark(F.unix_micros("_next_ts"), -1))), lambda m: m.isNotNull())
    steps = stage(chain.select(ladder, F.inline(marks)).withColumn("_at", F.timestamp_micros("u")), "steps")
    along = ["_at", "rank", "s"]  # a time, so that cells are counted by the hour first
    summed = running(depth_cells(steps, [ladder], along), [ladder], along, F.col(CELL), sum_bid=("sum", F.col("d")), seen=("sum", F.col("first")), stale_now=("sum", F.col("stale")))
    ready = (F.col("rank") == 1) & (F.col("seen") >= n_buckets) & (F.col("stale_now") == 0) & (F.col("sum_bid") >= threshold - 1e-9)
    return summed.filter(ready).select(ladder, F.col("_at").alias(ts), F.col("s").alias(seq), "sum_bid")


#: Children of a node of the thinning tree; a cell has the square of that in times.
FAN = 128
#: A time before all others.
NEVER = -(1 << 62)


def _entries(times: np.ndarray, gap: int) -> np.ndarray:
    """Those of the sorted times that may be the first one kept, whatever was kept before the first of them.

    That lies before the first time, so the first one due is within the gap from there, or the next one."""
    return times[: np.searchsorted(times, times[0] + gap) + 1]


def _exits(times: np.ndarray, gap: int) -> np.ndarray:
    """The last time kept on the path from each of the sorted distinct times; paths double in length each round."""
    after = np.searchsorted(times, times + gap)
    leads = np.where(after < len(times), after, np.arange(len(times)))
    while (leads[leads] != leads).any():
        leads = leads[leads]
    return times[leads]


def _after(last: np.ndarray, entries: np.ndarray, exits: np.ndarray, gap: int) -> np.ndarray:
    """The last kept time behind a cell or node, given the one before it: the first entry that is due leads to its exit."""
    due = np.searchsorted(entries, last + gap)
    return np.where(due < len(entries), exits[np.minimum(due, len(entries) - 1)], last)


def _table(key: tuple, *columns: Sequence) -> pd.DataFrame:
    """Columns by position beside the ladder of a group, which keeps its type whatever it is."""
    held = [pd.Series([key[0]] * len(columns[0]), dtype=object), *map(pd.Series, columns)]
    return pd.DataFrame(dict(enumerate(held)))


def _contract_cells(gap: int):
    def contract(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_u"].to_numpy())
        entries = _entries(times, gap)
        return _table(key, [key[1]], [entries], [_exits(times, gap)[: len(entries)]])

    return contract


def _contract_nodes(gap: int):
    """Steps of the children, in their order, as steps from entry to exit of the whole."""

    def contract(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        children = pdf.sort_values("_id")
        entries = _entries(np.unique(np.concatenate(children["_e"].to_list())), gap)
        last = entries - gap
        for e, x in zip(children["_e"], children["_x"]):
            last = _after(last, e, x, gap)
        return _table(key, [key[1]], [entries], [last])

    return contract


def _before_each(gap: int):
    """The last kept time before each child, from the one before the first."""

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        children = pdf.sort_values("_id")
        last, before = children["_in"].to_numpy()[:1], []
        for e, x in zip(children["_e"], children["_x"]):
            before.append(last[0])
            last = _after(last, e, x, gap)
        return _table(key, children["_id"].to_numpy(), before)

    return walk


def _kept_times(gap: int):
    def follow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_u"].to_numpy())
        at, after, kept = int(np.searchsorted(times, pdf["_in"].iloc[0] + gap)), np.searchsorted(times, times + gap).tolist(), []
        while at < len(times):
            kept.append(at)
            at = after[at]
        return _table(key, times[np.array(kept, dtype=int)])

    return follow


def thin(candidates: DataFrame, ladder: str, ts: str, seq: str, min_gap_seconds: float, fan: int = FAN) -> DataFrame:
    """Keep a row only if the last kept one of its ladder is at least the gap older; of one time, the least row.

    Each time leads to its first successor that is the gap or more later, so what is kept is one path.  Distinct times
    lie in cells of about `fan` squared; in a cell the path from every time that may be entered is followed to its
    exit by binary searches, and only these entries and exits go on, to nodes of `fan` cells, and so on to one
    node of each ladder.  Then the last kept time goes down again to every cell.  A cell costs as much whether its
    rows are dense or sparse, and a node holds the entries of its children, which lie within one gap of their first."""
    gap = int(min_gap_seconds * 1e6)
    rows = stage(candidates.filter(F.col(ladder).isNotNull() & F.col(ts).isNotNull()), "candidates")
    if gap <= 0:
        return rows
    key, long = StructField(ladder, rows.schema[ladder].dataType), LongType()
    steps = StructType([key, StructField("_id", long), StructField("_e", ArrayType(long)), StructField("_x", ArrayType(long))])
    times = depth_cells(rows.select(ladder, ts).distinct(), [ladder], [ts], fan * fan, "_id")
    times = stage(times.select(ladder, "_id", F.unix_micros(ts).alias("_u")), "times")
    nodes = stage(times.groupBy(ladder, "_id").applyInPandas(_contract_cells(gap), steps), "nodes")
    levels = []
    while (nodes.agg(F.max("_id")).first()[0] or 0) > 0:
        levels.append(nodes.withColumn("_parent", F.floor(F.col("_id") / fan).cast("long")))
        nodes = stage(levels[-1].groupBy(ladder, "_parent").applyInPandas(_contract_nodes(gap), steps), "nodes")
    entering = nodes.select(ladder, "_id", F.lit(NEVER).cast("long").alias("_in"))
    for level in reversed(levels):
        met = level.join(entering.withColumnRenamed("_id", "_parent"), [ladder, "_parent"])
        entering = met.groupBy(ladder, "_parent").applyInPandas(_before_each(gap), StructType([key, StructField("_id", long), StructField("_in", long)]))
        entering = stage(entering, "entering")
    met = times.join(entering, [ladder, "_id"])
    kept = met.groupBy(ladder, "_id").applyInPandas(_kept_times(gap), StructType([key, StructField("_u", long)]))
    at_kept = rows.withColumn("_u", F.unix_micros(ts)).join(kept, [ladder, "_u"])
    least = F.min(F.struct(F.col(seq).alias("_seq"), F.struct(*candidates.columns).alias("_row")))
    return at_kept.groupBy(ladder, "_u").agg(least.alias("_least")).select("_least._row.*")


class LadderAlerts:
    """Micro-batch form: the newest quote per bucket and the last alert per ladder are carried in small
    tables, one version per batch, so a replayed batch reads the same state and overwrites its output.

    Within a batch quotes count in the order of their time.  Late ones, older than what an earlier batch brought
    of their ladder, cannot change the past: a quote not newer than the newest known of its bucket is left out,
    any other counts from the newest time known of the ladder, and alerts that it raises bear that time."""

    def __init__(self, spark: SparkSession, root: str, ladder: str, bucket: str, ts: str, bid: str, seq: str, *, n_buckets: int,
                 max_age_seconds: float, threshold: float, min_gap_seconds: float = 1.0):
        self.spark, self.root = spark, root.rstrip("/")
        self.cols = {"ladder": ladder, "bucket": bucket, "ts": ts, "bid": bid, "seq": seq}
        self.rule = {"n_buckets": n_buckets, "max_age_seconds": max_age_seconds, "threshold": threshold}
        self.min_gap = min_gap_seconds

    def _state(self, name: str, batch: int, schema) -> DataFrame | None:
        return None if batch == 0 else self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{batch - 1}")

    def _on_time(self, batch: DataFrame, quotes: DataFrame) -> DataFrame:
        """Late quotes left out or moved to the ladder's newest time."""
        ladder, bucket, ts, _, seq = self.cols.values()
        newest = quotes.select(ladder, bucket, F.struct(ts, seq).alias("_newest"))
        clock = quotes.groupBy(ladder).agg(F.max(ts).alias("_clock"))
        met = batch.join(newest, [ladder, bucket], "left").join(clock, ladder, "left")
        fresh = met.filter(F.col("_newest").isNull() | (F.struct(ts, seq) > F.col("_newest")))
        return stage(fresh.withColumn(ts, F.greatest(ts, "_clock")).select(*self.cols.values()), "on-time")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        c = self.cols
        spark = batch.sparkSession
        self.spark = spark
        batch = batch.select(*c.values())
        quotes = self._state("quotes", batch_id, batch.schema)
        if quotes is not None:
            batch = self._on_time(batch, quotes)
        known = batch if quotes is None else quotes.unionByName(batch)
        found = alert_candidates(known, c["ladder"], c["bucket"], c["ts"], c["bid"], c["seq"], **self.rule)
        if quotes is not None:
            found = found.join(quotes.select(c["ladder"], c["seq"]), [c["ladder"], c["seq"]], "left_anti")
        last = self._state("last", batch_id, found.schema)
        kept = thin(found if last is None else last.unionByName(found), c["ladder"], c["ts"], c["seq"], self.min_gap)
        if last is not None:
            kept = kept.join(last.select(c["ladder"], c["seq"]), [c["ladder"], c["seq"]], "left_anti")
        kept.write.mode("overwrite").parquet(f"{self.root}/alerts/batch={batch_id}")
        newest = F.max_by(F.struct(*c.values()), F.struct(c["ts"], c["seq"]))
        known.groupBy(c["ladder"], c["bucket"]).agg(newest.alias("_n")).select("_n.*").write.mode("overwrite").parquet(f"{self.root}/quotes/{batch_id}")
        done = spark.read.schema(found.schema).parquet(f"{self.root}/alerts/batch={batch_id}")
        both = done if last is None else last.unionByName(done)
        both.groupBy(c["ladder"]).agg(F.max_by(F.struct(*found.columns), F.struct(c["ts"], c["seq"])).alias("_n")).select("_n.*").write.mode(
            "overwrite").parquet(f"{self.root}/last/{batch_id}")


#: How measures of one key are put together, and those of two stored rows.
_MEASURES = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "max": (F.max, F.max), "min": (F.min, F.min)}


class MergeableState:
    """Measures per key that batches add to: a batch stores one row for each key it has, and reads nothing.

    `measures` maps names to (sum|count|max|min, column).  A batch's rows lie in a folder of its id, so a batch that is
    repeated replaces them.  Every `compact_every` batches the rows stored so far become one base; what it is made of
    is deleted when the next base stands, so that the batch that makes a base can be repeated as well."""

    def __init__(self, root: str, keys: Sequence[str], measures: dict[str, tuple[str, Column]], compact_every: int = 16):
        self.root, self.keys, self.measures, self.every = root.rstrip("/"), list(keys), measures, compact_every

    def _stored(self, spark: SparkSession, name: str) -> list[int]:
        """Numbers of the folders that were written to the end."""
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(place):
            return []
        folders = [x.getPath() for x in store.listStatus(place)]
        done = [p for p in folders if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def _merged(self, frames: list[DataFrame]) -> DataFrame:
        both = reduce(DataFrame.unionByName, frames)
        return both.groupBy(*self.keys).agg(*[_MEASURES[kind][1](name).alias(name) for name, (kind, _) in self.measures.items()])

    def _frames(self, spark: SparkSession, upto: int | None = None) -> list[DataFrame]:
        """The newest base before batch `upto`, and the rows of the batches after it."""
        bases = [b for b in self._stored(spark, "base") if upto is None or b < upto]
        newest = bases[-1] if bases else -1
        batches = [b for b in self._stored(spark, "batches") if b > newest and (upto is None or b <= upto)]
        paths = [f"{self.root}/base/{newest}"] * bool(bases) + [f"{self.root}/batches/{b}" for b in batches]
        return [spark.read.parquet(p) for p in paths]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy(*self.keys).agg(*[_MEASURES[kind][0](column).alias(name) for name, (kind, column) in self.measures.items()])
        rows.write.mode("overwrite").parquet(f"{self.root}/batches/{batch_id}")
        if (batch_id + 1) % self.every == 0:
            bases = [b for b in self._stored(spark, "base") if b < batch_id]
            self._merged(self._frames(spark, batch_id)).write.mode("overwrite").parquet(f"{self.root}/base/{batch_id}")
            if bases:
                old = [f"{self.root}/base/{b}" for b in bases[:-1]]
                release(spark, old + [f"{self.root}/batches/{b}" for b in self._stored(spark, "batches") if b <= bases[-1]])

    def read(self, spark: SparkSession) -> DataFrame:
        """The measures of every key over all batches."""
        return self._merged(self._frames(spark))
