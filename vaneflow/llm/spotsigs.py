"""Document fingerprints from spot signatures, and the near-duplicate join over them.

A spot is a chain of content words that follows an anchor: a common word, or one that its hash picks.
Running text is full of anchors and the navigation around it has fewer, so the set of spots tells texts
apart.  Sets are compared exactly; in the join, sets are partitioned by length, since sets of Jaccard similarity t differ in length
by a factor of at most t, and within a partition only sets that share a rare spot are compared."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import depth_cells
from ..session import stage
from .wordhash import chunks, hash_words, letter_words, mix

#: Common words of four languages, the anchors.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "al con de del el en es la las los no para por que se su un una y "
    "au ce des du elle est et il le les ne pas pour qui sur une dans "
    "als auf das den der des die ein eine für im ist mit nicht sich und von zu"
).split()
#: Content words in a chain, and every how many-th content word is taken.
CHAIN, DISTANCE = 2, 1
#: One of so many other words, by its hash, is an anchor too, in texts of every length: few common words stand in short ones.
ANCHOR_EVERY = 4
#: Bytes of text that one task is to hold, about.
RANGE_BYTES = 12 << 20
#: The least similarity of the join.
SIMILAR = 0.8

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def spots(words: np.ndarray, common: np.ndarray, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """Sorted distinct 32-bit spots of one text.

    Common words and those that their hash picks are the anchors, whatever the length of the text; only where
    they give no chain at all is every word one.  A text of fewer content words than a chain is one spot, and
    one without words has none."""
    content = np.flatnonzero(~common)
    for anchors in (np.flatnonzero(common | (mix(words) % np.uint64(ANCHOR_EVERY) == 0)), np.arange(len(words))):
        nth = np.searchsorted(content, anchors, side="right")
        fits = nth + (chain - 1) * distance < len(content)
        h, nth = words[anchors[fits]], nth[fits]
        if len(h):
            for t in range(chain):
                h = h * _FACTOR + words[content[nth + t * distance]]
            break
    else:
        h = np.array([0] if len(words) else [], dtype=np.uint64)
        for w in words:
            h = h * _FACTOR + w
    return np.unique((mix(h) >> np.uint64(32)).astype(np.uint32))


def text_spots(texts: list[str]) -> Iterator[np.ndarray]:
    """The spots of one text after the other."""
    table = letter_words()
    anchors = np.sort(hash_words([" ".join(dict.fromkeys(ANCHORS)).encode()], table)[0])
    encoded = [t.encode("utf-8", "replace") for t in texts]
    for a, b in chunks(encoded):
        words, at = hash_words(encoded[a:b], table)
        common = anchors[np.minimum(np.searchsorted(anchors, words), len(anchors) - 1)] == words
        for i in range(b - a):
            yield spots(words[at[i] : at[i + 1]], common[at[i] : at[i + 1]])


def fingerprint(found: np.ndarray) -> str:
    """Sorted spots, eight hexadecimal digits each."""
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """`text` with its last half, rounded down, replaced by as many first code points of `following` (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def length_partition(size: int, least: float = SIMILAR) -> int:
    """Sets of at least this similarity lie in the same or in neighbouring partitions; 0 for the empty set."""
    return 1 + int(math.log(size) / -math.log(least) + 1e-9) if size else 0


def _dealt(docs: DataFrame, key: str, text: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """key, part, guest, text: rows in ranges of descending key; each range ends in a guest, the first row of the next.

    Ranges are equi-depth cells of (key, hash of the text), cut by counts; what they are and where their heads
    go stays in small tables, a row for each range, that are joined on.  Rows of one key, or of none, are cut as well."""
    least = -(1 << 63)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("id"), F.xxhash64(body).alias("hash"), F.col(key).alias("key"), body.alias("text"))
    total, n = rows.agg(F.sum(F.octet_length("text") + 64), F.count(F.lit(1))).first()
    depth = max(1, (n or 1) * range_bytes // max(1, total or 1))
    own = depth_cells(rows, [], ["id", "hash"], depth, "part").withColumn("part", F.col("part").cast("int"))
    heads = stage(own.groupBy("part").agg(F.max(F.struct("id", "hash")).alias("head")), "heads")
    # Keys descend while the numbers of ranges ascend: the head of a range is due in the range above, that of the highest in the lowest.
    along = Window.orderBy("part")
    hosts = heads.select("head.*", F.coalesce(F.lead("part").over(along), F.min("part").over(Window.partitionBy())).alias("host"))
    hosts = stage(hosts.withColumnRenamed("id", "head_id").withColumnRenamed("hash", "head_hash"), "hosts")
    guests = own.join(hosts, (own["id"] == hosts["head_id"]) & (own["hash"] == hosts["head_hash"])).dropDuplicates(["head_id", "head_hash"])
    guests = guests.select("id", "hash", "key", "text", F.col("host").alias("part"), F.lit(True).alias("guest"))
    both = own.select("id", "hash", "key", "text", "part", F.lit(False).alias("guest")).unionByName(guests)
    parts = (heads.agg(F.max("part")).first()[0] or 0) + 1
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", F.desc("id"), F.desc("hash"))


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    Returns `key`, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the
    length partition of the text's set.  The next document is the one of the next smaller key, and after
    the smallest the largest; rows of one key follow by a hash of their text, rows without a key come last.  The one
    row of a table is its own next.  Null texts count as empty; an empty set of spots has the empty
    fingerprint and is like another empty one (1) and unlike others (0).  Rows stay one to one; other
    columns are not read; no rows give no rows."""
    kind = dict(docs.dtypes)[key]
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "length_partition"]
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_partition int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next one has not come yet
        for batch in batches:
            keys, parts, guests, texts = (batch.column(c) for c in ("key", "part", "guest", "text"))
            part, guest, body = parts.to_pylist(), guests.to_pylist(), texts.to_pylist()
            own = list(text_spots(body))
            rows = [(k, p, g, t, s) for k, p, g, t, s in zip(keys, part, guest, body, own, strict=True)]
            if held is not None:
                rows.insert(0, held)
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[2] and a[1] == b[1]]
            held = rows[-1] if rows else None
            if not pairs:
                continue
            new = [edited(a[3], b[3]) for a, b in pairs]
            new_spots = list(text_spots(new))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0].as_py() for a, _ in pairs], batch.schema.field("key").type),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in new], pa.string()),
                    pa.array([fingerprint(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([fingerprint(s) for s in new_spots], pa.string()),
                    pa.array([likeness(a[4], s) for (a, _), s in zip(pairs, new_spots, strict=True)], pa.float64()),
                    pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                    pa.array([length_partition(len(a[4])) for a, _ in pairs], pa.int32()),
                ],
                names=names,
            )

    return _dealt(docs, key, text, range_bytes).select("key", "part", "guest", "text").mapInArrow(run, schema)


def spot_sets(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """v and its spots as array<long>, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.astype(np.int64) for s in text_spots([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["v", "spots"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"v {dict(docs.dtypes)[key]}, spots array<long>")


def similar_pairs(sets: DataFrame, *, least: float = SIMILAR) -> DataFrame:
    """(u, v, similarity): all pairs u < v of different sets whose Jaccard similarity is `least` or more.

    Equal sets count as their least v (join `classes` back for the members); empty sets are left out.  Spots
    are ordered by frequency, rarest first; similar sets share one of the first ``n - ceil(least n) + 1``."""
    classes = sets.filter(F.size("spots") > 0).groupBy("spots").agg(F.min("v").alias("v"))
    counted = classes.select("v", "spots", F.size("spots").alias("n"))
    frequency = counted.select(F.explode("spots").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = counted.select("v", "n", F.explode("spots").alias("s")).join(frequency, "s").groupBy("v", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    prefix = ranked.select("v", "n", F.floor(F.log(F.col("n").cast("double")) / -math.log(least) + 1e-9).cast("int").alias("part"), F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1).alias("o"))
    index = prefix.select("v", "n", "part", F.explode("o.s").alias("s"))
    a = index.select(F.col("v").alias("u"), F.col("n").alias("n_u"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    met = a.join(index, ["part", "s"]).filter((F.col("u") != F.col("v")) & (F.least("n_u", "n") >= F.greatest("n_u", "n") * least - 1e-9))
    pairs = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    side = lambda c: classes.select(F.col("v").alias(c), F.col("spots").alias(f"s_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.select("u", "v", jaccard(F.col("s_u"), F.col("s_v")).alias("similarity")).filter(F.col("similarity") >= least - 1e-12)


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)
