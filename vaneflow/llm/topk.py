"""Exact top-k by inner product: columnar branch and bound.

Rows are dealt by their number into groups of bounded size, and every group goes to one task, once; the
queries, a small part of the table, are sent to the groups in blocks.  A group keeps its components in vertical
layout, dimension by dimension, longest rows first, and meets one block of queries after the other.  Products are
accumulated over one slice of dimensions after the other; what the remaining dimensions can still add is bounded by
the product of the remaining lengths (Cauchy-Schwarz), and rows that cannot reach the k-th best score that the
query has found in its group so far are dropped in between, whole stretches of rows by their longest one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Rows that a task holds, and the fewest worth a task; rows that a query meets at once; queries sent together.
GROUP_ROWS, LEAST_ROWS, STRETCH_ROWS, QUERY_ROWS = 65_536, 2_048, 2_048, 128
SLICE = 16
#: Products of components within this range are summed exactly in double precision (up to 2^53).
EXACT = float(1 << 53)


def whole_components(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are null or hold a null or non-finite component."""
    usable = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _narrowest(largest: int) -> np.dtype:
    """The smallest whole type that holds components up to this size."""
    return next(np.dtype(t) for t in ("<i2", "<i4", "<i8") if largest <= np.iinfo(t).max)


def _packed(rows: DataFrame, kind: np.dtype, *names: str) -> DataFrame:
    """`names` and each vector as bytes of the narrowest type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind), np.append(0, np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False)))
            packed = [flat[s:e].tobytes() for s, e in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=[*names, "vector"])

    schema = ", ".join(f"{n} {dict(rows.dtypes)[n]}" for n in names) + ", vector binary"
    return rows.select(*names, "vector").mapInArrow(run, schema)


def _matrix(vectors: list[bytes], kind: np.dtype, dims: int, exact: bool) -> np.ndarray:
    """Dimensions by rows; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dims), dtype=np.float64 if exact else np.int64)
    for i, v in enumerate(vectors):
        row = np.frombuffer(v, dtype=kind)
        out[i, : len(row)] = row
    return np.ascontiguousarray(out.T)


def _rest(m: np.ndarray) -> np.ndarray:
    """Length of what each column holds from each dimension on."""
    return np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1]) if len(m) else np.zeros((1, m.shape[1]))


class Group:
    """The rows of one group, longest first; `search` gives the k best for each query of a block."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, matrix: np.ndarray, slice_dims: int = SLICE, stretch: int = STRETCH_ROWS):
        rest = _rest(matrix)
        order = np.argsort(-rest[0], kind="stable")
        self.numbers, self.ids, self.rows, self.rest = numbers[order], ids[order], matrix[:, order], rest[:, order]
        self.slice_dims, self.stretch = slice_dims, stretch

    def search(self, q: np.ndarray, q_numbers: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the query, ids, scores): its k best rows but itself; ties go to the smaller id."""
        q_rest, n = _rest(q), q.shape[1]
        found = [(np.zeros(0, dtype=self.ids.dtype), np.zeros(0, dtype=self.rows.dtype))] * n
        least = np.full(n, -np.inf)  # a row below it is not among the k best
        for s in range(0, len(self.ids), self.stretch):
            rows, rest = self.rows[:, s : s + self.stretch], self.rest[:, s : s + self.stretch]
            ids, numbers = self.ids[s : s + self.stretch], self.numbers[s : s + self.stretch]
            most = q_rest[0] * rest[0, 0] * (1 + 1e-9) + 1e-6  # the longest row comes first
            first = q[: self.slice_dims].T @ rows[: self.slice_dims]
            for i in np.flatnonzero(most >= least).tolist():
                alive = np.flatnonzero(numbers != q_numbers[i])
                best = self._best(q[:, i], q_rest[:, i], first[i], rows, rest, alive, k, least[i])
                all_ids, scores = np.append(found[i][0], ids[best[0]]), np.append(found[i][1], best[1])
                top = np.lexsort((all_ids, -scores))[:k]
                found[i] = all_ids[top], scores[top]
                if len(top) == k:
                    kth = scores[top[-1]]
                    # Whole numbers beyond 2^53 are compared as doubles: a little less is certain not to be too much.
                    least[i] = kth if self.rows.dtype == np.float64 else float(kth) - abs(float(kth)) * 1e-15 - 1
        for i, (ids, scores) in enumerate(found):
            yield i, ids, scores

    def _best(self, q, q_rest, first, rows, rest, alive, k, least) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the rows that reach `least`, or of more than the k best."""
        dims, partial = len(q), first[alive]
        done = min(self.slice_dims, dims)
        while done < dims and len(alive):
            slack = q_rest[done] * rest[done, alive] * (1 + 1e-9) + 1e-6
            if len(alive) > k:  # k rows reach at least this
                least = max(least, np.partition(partial - slack, len(alive) - k)[len(alive) - k])
            keep = partial + slack >= least
            alive, partial = alive[keep], partial[keep]
            upto = min(done + self.slice_dims, dims)
            partial, done = partial + q[done:upto] @ rows[done:upto][:, alive], upto
        keep = partial >= least
        return alive[keep], partial[keep]


def exact_top_k(
    table: DataFrame, is_query: Column, *, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for each row that `is_query`.

    Components count as floor(scale * x).  Vectors that are null or hold null or non-finite components take
    no part, nor do rows with a null key; empty vectors score 0, and of vectors of different lengths the
    missing components count as 0.  Each row counts by itself: rows that repeat a key are candidates each, also
    for one another, and a query that repeats its key has its own k rows.  Ties go to the smaller key; fewer than
    k other rows give all of them."""
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("id"), whole_components(F.col(vector), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stage(rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).withColumn("number", F.monotonically_increasing_id()), "vectors")
    n, asked, largest, dims = rows.agg(
        F.count(F.lit(1)), F.count_if("asks"), F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))), F.max(F.size("vector"))
    ).first()
    largest, dims = int(largest or 0), int(dims or 0)
    kind, exact = _narrowest(largest), float(largest) ** 2 * dims < EXACT
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-n // group_rows), min(parallel, -(-n // LEAST_ROWS)), 1)
    lots = max(1, -(-asked // query_rows))
    lot = F.pmod(F.xxhash64("number", F.lit(2)), F.lit(lots)).cast("int")
    packed = _packed(rows, kind, "number", "id", "asks")
    own = packed.select(F.pmod(F.xxhash64("number", F.lit(1)), F.lit(groups)).cast("int").alias("group"), F.lit(-1).alias("lot"), "number", "id", "vector")
    # Queries go to every group, behind its rows and in lots that fit together.
    sent = packed.filter("asks").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("group", lot.alias("lot"), "number", "id", "vector")
    dealt = own.unionByName(sent).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "lot", "number")
    columns = ["asked", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, at = None, [], None

        def ended() -> list[pa.RecordBatch]:
            nonlocal group
            numbers, ids = np.array([x[0] for x in held], dtype=np.int64), np.array([x[1] for x in held], dtype=np.int64)
            matrix = _matrix([x[2] for x in held], kind, dims, exact)
            if at == -1:
                group = Group(numbers, ids, matrix)
                return []
            if group is None:  # no row was dealt to this group
                return []
            out = []
            for i, near, scores in group.search(matrix, numbers, k):
                out.append(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(near), numbers[i]), np.full(len(near), ids[i]), near, scores.astype(np.int64))], names=columns))
            return [pa.Table.from_batches(out).combine_chunks().to_batches()[0]] if sum(map(len, out)) else []

        for batch in batches:
            lots_here = batch.column("lot").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(lots_here)) + 1).tolist(), len(lots_here)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if at is not None and lots_here[s] != at:
                    yield from ended()
                    held = []
                at = int(lots_here[s])
                part = batch.slice(s, e - s)
                held += zip(part.column("number").to_pylist(), part.column("id").to_pylist(), part.column("vector").to_pylist())
        if held:
            yield from ended()

    best = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in columns))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast(table.schema[key].dataType).alias("query_id"), "rank", F.col("vec_id").cast(table.schema[key].dataType).alias("vec_id"), "score")
