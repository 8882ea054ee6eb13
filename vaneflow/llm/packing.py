"""Best-fit packing of token sequences with certified bin counts.

Pieces are dealt by hash into groups of bounded size and each group is packed best-fit decreasing.
Dual-feasible functions give a lower bound on the bins of every group; a group that meets its bound is
finished.  In the others the bins without room left are kept, and the pieces of the rest are exchanged:
they are dealt anew among all groups with a gap and packed again, for a fixed number of rounds."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .tokens import PrefixTable, default_vocabulary

#: Pieces a group is to hold; a task packs one group at a time.
GROUP_PIECES = 3_000


@lru_cache(maxsize=2)
def encoder(json_path: str):
    """The vocabulary of `json_path`, run by the byte-pair library that works without a word memory.

    Ids equal those of the file's own library: the same ranks, splitting rule and special strings."""
    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        spec = json.load(f)
    table = PrefixTable(json_path)
    ranks = {token: table.ids[token] for token in table.rank}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    return tiktoken.Encoding(zlib.crc32(base64.b64encode(json_path.encode())).__str__(), pat_str=PrefixTable.SPLIT, mergeable_ranks=ranks, special_tokens=special)


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all of `capacity` but the first, which takes the rest."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))] if length else []


def token_pieces(docs: DataFrame, *, capacity: int, end_id: int, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every whole text: `key`, piece, start, length, ids_crc32, and _row, a number of the row."""
    kind = dict(docs.dtypes)[key]
    schema = f"_row long, `{key}` {kind}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            source, rows = [], []
            for i, x in enumerate(texts):
                ids = np.append(np.asarray(enc.encode_to_numpy(x or "", allowed_special="all"), dtype="<u4"), np.array([end_id], dtype="<u4"))
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    source.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            take = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["_row", key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key), F.col(text)).mapInArrow(run, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the fullest bin that it fits.

    Bins are kept by their room; a bit per room finds the least room that is enough."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = chosen, capacity - room
        left = room - size
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(sizes: np.ndarray, capacity: int, steps: int = 64) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions.

    For each cut e: items over capacity - e count as a whole bin, items under e as nothing.  For each k:
    x counts as floor((k + 1) x) / k, or as x where (k + 1) x is whole."""
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    number, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    cut = np.arange(0, capacity // 2 + 1)
    whole = (number[capacity + 1] - number[capacity - cut + 1]) * capacity + mass[capacity - cut + 1] - mass[cut]
    best = int(-(-whole.max() // capacity))
    x = np.flatnonzero(counts)
    for k in range(1, steps + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)  # in units of 1 / (k capacity)
        best = max(best, int(-(-int((value * counts[x]).sum()) // (k * capacity))))
    return best


def _pack_groups(items: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """Pack every group; adds _group, _bin, offset, _room of its bin, and the group's _bins and _bound."""
    dealt = items.withColumn("_group", F.pmod(F.xxhash64("_row", "piece", F.lit(salt)), F.lit(groups)).cast("long"))
    schema = dealt.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_row", "piece"], kind="stable")  # the same packing whatever order rows arrive in
        sizes = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        room = capacity - np.bincount(bins, weights=sizes).astype(np.int64)
        return group.assign(_bin=bins, offset=offsets, _room=room[bins], _bins=len(room), _bound=lower_bound(sizes, capacity))

    return dealt.groupBy("_group").applyInPandas(pack, f"{schema}, _bin long, offset long, _room long, _bins long, _bound long")


def pack_documents(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, rounds: int = 3, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """Pack the tokens of all `docs` into sequences of at most `capacity`: one row per piece.

    Returns `key`, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty text is the end
    token alone; repeated rows are packed once each; null keys are kept; a text of more than `capacity`
    tokens is cut, its first piece taking the rest.  Other columns are not read; no rows give no rows."""
    path = vocabulary or default_vocabulary()
    pieces = stage(token_pieces(docs, capacity=capacity, end_id=end_id, vocabulary=path, key=key, text=text), "pieces")
    done = [pieces.filter(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = pieces.filter(F.col("length") < capacity)
    plain = pieces.columns
    for turn in range(rounds):
        n = left.count()
        if not n:
            break
        packed = stage(_pack_groups(left, -(-n // group_pieces), turn, capacity), "packed")
        settled = F.lit(True) if turn == rounds - 1 else (F.col("_bins") <= F.col("_bound")) | (F.col("_room") == 0)
        number = (F.lit(turn).cast("long") * (1 << 56)) + F.col("_group") * (1 << 24) + F.col("_bin")
        done.append(packed.filter(settled).select(*plain, number.alias("sequence_id"), "offset"))
        left = packed.filter(~settled).select(*plain)
    return reduce(DataFrame.unionByName, done).drop("_row")
