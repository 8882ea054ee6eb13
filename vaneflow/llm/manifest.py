"""Merkle manifest of a table: a tree of hashes per source, and one over the sources.

Nodes are numbered along their order, and runs of `ARITY` of them become one node, level by level, until one
is left.  A task holds one chunk of a tree, `ARITY ** CHUNK_LEVELS` neighbouring nodes at most, however many
rows a source has: chunks are reduced to their tops, the tops are the nodes of the next round.

Each parent keeps a copy of its hash state from before each child slot.  A changed child is folded in by
resuming the copy of its slot with the new digest and the siblings to the right; those to the left are in the
state already.  States cannot leave their process, so a chunk that is folded through builds them anew from
the digests of its nodes; what stands above the chunk reaches it as one path of siblings, and the state before
its slots is built once for all its nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

ARITY = 16
#: Levels that one task works through at a time: chunks of at most ARITY ** CHUNK_LEVELS nodes.
CHUNK_LEVELS = 2
#: Rows that a range is to hold while nodes are numbered.
RANGE_ROWS = 1_000_000

_NODE = "g string, pos long, total long, digest string"
_PATH = "path array<struct<before: string, after: string>>"


class Subtree:
    """The levels over some nodes; `states[level][i]` is the hash state of i's parent before its slot."""

    def __init__(self, digests: list[str], height: int):
        self.levels, self.states = [digests], []
        for _ in range(height):
            above, states, parent = [], [], None
            for i, digest in enumerate(self.levels[-1]):
                if i % ARITY == 0:
                    if parent is not None:
                        above.append(parent.hexdigest())
                    parent = hashlib.sha256()
                states.append(parent.copy())
                parent.update(digest.encode())
            above.append(parent.hexdigest())
            self.levels.append(above)
            self.states.append(states)

    def siblings(self, i: int) -> Iterator[tuple[str, str]]:
        """What stands before and after node i in its run, then its parent in the run of that, and so on."""
        for level in self.levels[: len(self.states)]:
            start = i - i % ARITY
            yield "".join(level[start:i]), "".join(level[i + 1 : start + ARITY])
            i //= ARITY

    def fold(self, i: int, digest: str) -> str:
        """The top with node i replaced: each parent resumes from the state before the changed slot."""
        for level, states in zip(self.levels, self.states):
            state = states[i].copy()
            state.update((digest + "".join(level[i + 1 : i - i % ARITY + ARITY])).encode())
            digest, i = state.hexdigest(), i // ARITY
        return digest


def height(total: int, most: int) -> int:
    """Levels of a chunk (`most` at the most) in a tree of `total` nodes: runs are hashed only while there are several."""
    levels = 0
    while total > 1 and levels < most:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def encoded(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.when(shown.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def numbered(nodes: DataFrame, order: list[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add pos, the place within g along `order` (nulls first), and total, the nodes of g; written once.

    Rows are sorted in ranges of (g, order).  A range holds a stretch of each g that it meets, so a node's
    place is its place in the stretch and the nodes of g in the ranges before."""
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // range_rows))
    by = [F.col("g"), *[F.col(c) for c in order]]
    ranged = nodes.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = stage(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    stretches = placed.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = stretches.select(F.col("g").alias("_g"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    shifts = stage(shifts, f"{name}-places")
    met = placed.join(shifts, placed["g"].eqNullSafe(shifts["_g"]) & (placed["_part"] == shifts["_p"]))
    return met.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_first", "_g", "_p", "_shift")


def _chunk(levels: int) -> Column:
    return F.floor(F.col("pos") / ARITY**levels).cast("long")


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The top of every chunk, a node of the next round."""

    def reduce(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("pos", kind="stable")
        total = int(chunk["total"].iloc[0])
        top = Subtree(list(chunk["digest"]), height(total, levels)).levels[-1][0]
        size = ARITY**levels
        return pd.DataFrame({"g": [chunk["g"].iloc[0]], "pos": [chunk["pos"].iloc[0] // size], "total": [-(-total // size)], "digest": [top]})

    return nodes.select("g", "pos", "total", "digest").groupBy("g", _chunk(levels).alias("chunk")).applyInPandas(reduce, _NODE)


def rounds(nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """`nodes`, then the tops of their chunks, and so on to one node of each g."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(stage(_tops(out[-1], levels), name))
    return out


def _meet(nodes: DataFrame, above: DataFrame, levels: int, work, schema: str) -> DataFrame:
    """`work` on every chunk of `nodes` with the one row of `above` that stands for its top."""
    left = nodes.withColumn("chunk", _chunk(levels)).groupBy("g", "chunk")
    return left.cogroup(above.withColumnRenamed("pos", "chunk").groupBy("g", "chunk")).applyInPandas(work, schema)


def _descend(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """g, pos, path and tops of every node, from those of the tops of their chunks."""

    def work(chunk: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("pos", kind="stable")
        tree, higher = Subtree(list(chunk["digest"]), height(int(chunk["total"].iloc[0]), levels)), list(top["path"].iloc[0])
        paths = [[{"before": b, "after": a} for b, a in tree.siblings(i)] + higher for i in range(len(chunk))]
        return pd.DataFrame({"g": chunk["g"], "pos": chunk["pos"], "path": pd.Series(paths, index=chunk.index, dtype=object), "subroot": top["subroot"].iloc[0], "root": top["root"].iloc[0]})

    return _meet(nodes.select("g", "pos", "total", "digest"), above, levels, work, f"g string, pos long, {_PATH}, subroot string, root string")


def _folded(leaves: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Proof and fold of every leaf."""

    def work(chunk: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("pos", kind="stable")
        tree = Subtree(list(chunk["digest"]), height(int(chunk["total"].iloc[0]), levels))
        higher = [(x["before"].encode(), x["after"].encode()) for x in top["path"].iloc[0]]
        parents = [(hashlib.sha256(before), after) for before, after in higher]
        root, proofs, folds = top["root"].iloc[0], [], []
        for i, (digest, bent) in enumerate(zip(chunk["digest"], chunk["bent"])):
            proof = hashlib.sha256()
            for before, after in tree.siblings(i):
                proof.update((before + after).encode())
            for before, after in higher:
                proof.update(before + after)
            now = tree.fold(i, bent or digest)
            for parent, after in parents:
                state = parent.copy()
                state.update(now.encode() + after)
                now = state.hexdigest()
            proofs.append(proof.hexdigest())
            folds.append(now)
        return pd.DataFrame({"key": chunk["key"], "leaf": chunk["digest"], "subroot": top["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": folds, "verified": [x == root for x in folds]})

    return _meet(leaves, above, levels, work, "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def merkle_manifest(
    docs: DataFrame, *, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None,
    chunk_levels: int = CHUNK_LEVELS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """`key`, leaf, subroot, root, proof_sha256, folded_root, verified of every row of `docs`.

    A leaf is the hash of the encoded `fields`; leaves of a source ascend by `key`, then leaf.  `tampered`
    gives columns to be read in place of fields; folded_root is the root with the leaf of that row alone.
    A null field is encoded as `-`; rows without a source form a source that stands first; rows without a
    key stand first in theirs; rows that repeat a key, or are equal, are leaves of their own (equal ones
    side by side); texts may be empty and of any length.  Other columns are not read; no rows give no rows."""
    tampered = tampered or {}
    leaf = F.sha2(F.concat(*[encoded(F.col(c)) for c in fields]), 256)
    bent = F.sha2(F.concat(*[encoded(tampered.get(c, F.col(c))) for c in fields]), 256) if tampered else F.lit(None).cast("string")
    plain = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("g"), leaf.alias("digest"), bent.alias("bent"))
    hashed = stage(plain.withColumn("bent", F.when(F.col("bent") != F.col("digest"), F.col("bent"))), "hashed")
    leaves = numbered(hashed, ["key", "digest"], "leaves", range_rows)
    trees = rounds(leaves, "tops", chunk_levels)
    subroots = trees[-1].select(F.col("g").alias("name"), F.col("digest"))
    over = rounds(numbered(subroots.withColumn("g", F.lit(None).cast("string")), ["name"], "subroots", range_rows), "tops", chunk_levels)
    above = over[-1].select("g", "pos", F.array().cast(_PATH.removeprefix("path ")).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(over[:-1]):
        above = _descend(nodes, above, chunk_levels)
    named = over[0].select(F.col("pos").alias("_at"), "name", "digest")
    above = above.join(named, above["pos"] == named["_at"]).select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(trees[1:-1]):
        above = _descend(nodes, above, chunk_levels)
    # As text: pandas would turn whole numbers beside nulls into floats.
    out = _folded(leaves.select("g", "pos", "total", "digest", "bent", F.col("key").cast("string").alias("key")), above, chunk_levels)
    return out.select(F.col("key").cast(docs.schema[key].dataType).alias(key), *out.columns[1:])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", every: int = 5, **sizes: int) -> DataFrame:
    """The manifest with a drill: where `every` divides the CRC of the key, the text's A-Z are lower-cased."""
    drilled = F.crc32(F.col(key).cast("string")) % every == 0
    return merkle_manifest(docs, key=key, tampered={text: F.when(drilled, lower_ascii(F.col(text))).otherwise(F.col(text))}, **sizes)
