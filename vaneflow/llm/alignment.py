"""Alignment of the tokens of two vocabularies, and how often their ids meet over the corpus.

A text is tokenised whole by both.  Where tokens of both end at one byte, verified by their lengths, and the next
token of both begins with a space, the text is cut: both sides of such an anchor align by themselves.  The
windows between anchors are mostly single words and recur, so the alignment of a window is remembered by the two
tuples of its ids; one that is not known is merged end by end.

How many documents hold a pair of ids is counted over the corpus.  The documents' pairs are kept as one sorted
array each.  The commonest pairs, a fixed number, are looked up in a table that every task has; of all others each
holds at most one part in that number of all pairs of documents, so they meet their counts in an even join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .packing import encoder
from .tokens import PrefixTable, default_vocabulary
from .wordhash import chunks, mix

#: Windows, and links of them, that a Python worker remembers; beyond either the memory starts anew with the next text.
REMEMBERED, REMEMBERED_LINKS = 400_000, 4_000_000
#: Longer windows, in tokens of both, are kept for their text only.
REMEMBERED_TOKENS = 64
#: Bytes of text (one text at least) that are aligned at a time, and documents whose pairs are looked up at a time.
TEXT_BYTES, ROWS = 1 << 21, 2_000
#: Pairs in the table that every task has.
COMMON_PAIRS = 1 << 16


class Aligner:
    """Two vocabularies, a byte-level one (A) and one of pieces with marked spaces (B), and the windows met so far."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.encode_a = encoder(path_a).encode_to_numpy
        self.pieces = SentencePieceProcessor(model_file=path_b)
        ids = PrefixTable(path_a).ids
        self.bytes_a = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.size_b = len(self.bytes_b)
        self.code = np.dtype("<u4" if len(self.bytes_a) * self.size_b <= 1 << 32 else "<u8")
        self.length_a, self.length_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.space_a, self.space_b = (np.array([t.startswith(b" ") for t in x]) for x in (self.bytes_a, self.bytes_b))
        #: Ids as text with what follows them: a comma, a bar behind the last of A in a group, a semicolon behind the last of B.
        self._shown = [f"{i}{mark}" for n, marks in ((len(self.bytes_a), ",|"), (self.size_b, ",;")) for mark in marks for i in range(n)]
        self._forget()

    def _forget(self) -> None:
        """An empty memory: windows by their ids; the groups of each as text; the links of all, one after the other."""
        self._windows: dict[tuple[bytes, bytes], int] = {}
        self._groups: list[str] = []
        self._links, self._held = np.zeros(1 << 16, dtype=self.code), 0
        self._begins: list[int] = [0]

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def tokenise(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text (as many bytes on both sides); none where the bytes of the tokens are not those of a space and the text."""
        empty = np.zeros(0, dtype="<u4"), np.zeros(0, dtype="<i4")
        for text, b in zip(texts, self.pieces.encode(texts, out_type=int, num_threads=1)):
            if not text:
                yield empty
                continue
            a, spaced = self.encode_a(" " + text, allowed_special=set(), disallowed_special=()), (" " + text).encode("utf-8", "replace")
            same = b"".join(map(self.bytes_b.__getitem__, b)) == spaced and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == spaced
            yield (a.astype("<u4"), np.array(b, dtype="<i4")) if same else empty

    def align(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
        """For the ids of each text: number of groups, their text, the codes of the linked pairs and how often each is linked.

        Texts are laid end to end; both sides of each have the same bytes, so they end together."""
        if len(self._groups) >= REMEMBERED or self._held >= REMEMBERED_LINKS:
            self._forget()
        sizes_a = np.array([len(a) for a, _ in texts], dtype=np.int64)
        until_a = np.cumsum(sizes_a)
        a, b = (np.concatenate([np.zeros(0, dtype=k), *(x[i] for x in texts)]) for i, k in ((0, "<u4"), (1, "<i4")))
        if not len(a):
            yield from [(0, "", np.zeros(0, dtype=self.code), np.zeros(0, dtype=np.int64))] * len(texts)
            return
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        place = np.searchsorted(ends_b, ends_a)
        after_a = np.flatnonzero(ends_b[np.minimum(place, len(b) - 1)] == ends_a) + 1
        after_b = place[after_a - 1] + 1
        # A window ends where the next tokens of both begin with a space, and with its text.
        last = np.zeros(len(a) + 1, dtype=bool)
        last[until_a] = True
        cut = last[after_a] | (np.append(self.space_a[a], False)[after_a] & np.append(self.space_b[b], False)[np.minimum(after_b, len(b))])
        number = self._numbers(a, b, after_a[cut], after_b[cut])
        of_text = np.searchsorted(until_a, after_a[cut] - 1, side="right")
        groups_until, windows_until = np.searchsorted(after_a, until_a, side="right"), np.searchsorted(after_a[cut], until_a, side="right")
        begins = np.asarray(self._begins, dtype=np.int64)
        sizes = begins[number + 1] - begins[number]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes, owner = self._links[np.repeat(begins[number], sizes) + inside], np.repeat(of_text, sizes)
        order = np.lexsort((codes, owner)) if self.code.itemsize == 8 else np.argsort(owner.astype(np.uint64) << np.uint64(32) | codes, kind="stable")
        codes, owner = codes[order], owner[order]
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])))
        linked = np.diff(np.append(first, len(codes)))
        pairs_until = np.searchsorted(owner[first], np.arange(len(texts)), side="right")
        numbers, shown, pairs = number.tolist(), self._groups, codes[first]
        g = w = p = 0
        for groups, windows, until in zip(groups_until.tolist(), windows_until.tolist(), pairs_until.tolist()):
            yield groups - g, ";".join([shown[i] for i in numbers[w:windows]]), pairs[p:until], linked[p:until]
            g, w, p = groups, windows, until

    def _numbers(self, a: np.ndarray, b: np.ndarray, until_a: np.ndarray, until_b: np.ndarray) -> np.ndarray:
        """The number of every window: equal ones are brought together first, so each is looked up once.

        They are brought together by a hash, and each is compared with the first of its hash; if any two that
        differ share one, all are looked up by themselves."""
        sides = []
        for ids, until in ((a, until_a), (b, until_b)):
            start = np.append(0, until[:-1])
            size = until - start
            inside = np.arange(len(ids)) - np.repeat(start, size)
            hashed = np.add.reduceat(mix(ids.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[inside], start)
            sides.append((ids, start, size, inside, hashed))
        _, first, which = np.unique(mix(sides[0][4]) + sides[1][4] * np.uint64(3), return_index=True, return_inverse=True)
        for ids, start, size, inside, _ in sides:
            like = first[which]
            if (size != size[like]).any() or (ids != ids[np.repeat(start[like], size) + inside]).any():
                first = which = np.arange(len(until_a))
                break
        raw_a, raw_b, find = a.tobytes(), b.tobytes(), self._windows.get
        start_a, size_a, start_b, size_b = (x[first] for side in sides for x in side[1:3])
        edges = (4 * np.stack([start_a, start_a + size_a, start_b, start_b + size_b])).tolist()
        keys = [(raw_a[s:e], raw_b[t:f]) for s, e, t, f in zip(*edges)]
        numbers = np.array([find(key, -1) for key in keys], dtype=np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            begin = len(self._groups)
            spread = lambda ids, start, size: (ids[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)], np.cumsum(size))
            self._merge(*spread(a, start_a[new], size_a[new]), *spread(b, start_b[new], size_b[new]))
            numbers[new] = np.arange(begin, len(self._groups))
            short = (size_a[new] + size_b[new] <= REMEMBERED_TOKENS).tolist()
            for i, number, kept in zip(new.tolist(), range(begin, len(self._groups)), short):
                if kept:
                    self._windows[keys[i]] = number
        return numbers[which]

    def _merge(self, a: np.ndarray, until_a: np.ndarray, b: np.ndarray, until_b: np.ndarray) -> None:
        """Align windows that are not known yet, laid end to end, and append them to the memory.

        Each place where a token of either side ends closes one link; a place where both end closes a group."""
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        places = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, places), np.searchsorted(ends_b, places)
        codes = a[at_a].astype(self.code) * self.code.type(self.size_b) + b[at_b].astype(self.code)
        shared = places[(ends_a[at_a] == places) & (ends_b[at_b] == places)]
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        closes_a, closes_b = shared[group_a] == ends_a, shared[group_b] == ends_b
        # The ids in the order of the text of groups, each with the mark that follows it.
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        vocabulary = len(self.bytes_a)
        marked = np.concatenate([a.astype(np.int64) + vocabulary * closes_a, b.astype(np.int64) + self.size_b * closes_b + 2 * vocabulary])
        shown = [self._shown[i] for i in marked[order].tolist()]
        until = (until_a + until_b).tolist()
        self._groups.extend("".join(shown[s:e])[:-1] for s, e in zip([0, *until], until))
        end = self._held + len(codes)
        if end > len(self._links):
            self._links = np.concatenate([self._links, np.zeros(max(len(self._links), len(codes)), dtype=self.code)])
        self._links[self._held : end] = codes
        self._begins.extend((self._held + np.searchsorted(places, ends_a[until_a - 1], side="right")).tolist())
        self._held = end


@lru_cache(maxsize=64)
def _powers(n: int) -> np.ndarray:
    return np.append(np.uint64(1), np.cumprod(np.full(max(0, n - 1), 0x9E3779B97F4A7C15, dtype=np.uint64)))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per pair of files and Python worker."""
    return Aligner(path_a, path_b)


def align_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary_a: str | None = None, vocabulary_b: str | None = None, store: bool = False) -> DataFrame:
    """_row, `key`, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of every row; with `store` also `groups`.

    `groups` is the text of the groups; pairs holds the codes (A id times the size of B, plus B id) of the distinct
    linked id pairs in ascending order, times how often each is linked.  Null and empty texts, and those whose tokens
    do not give back a space and the text, have no tokens: zeros, an empty hash and no pairs.  Repeated rows, null
    keys and ties give a row each; texts may be of any length; other columns are not read; no rows give no rows."""
    path_a, path_b = vocabulary_a or default_vocabulary("byte_bpe_50k.json"), vocabulary_b or default_vocabulary("piece_bpe_32k.model")
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for whole in batches:
            every = whole.column(2).to_pylist()
            for start, end in chunks([(x or "").encode("utf-8", "replace") for x in every], TEXT_BYTES):
                batch = whole.slice(start, end - start)
                rows: dict[str, list] = {c: [] for c in [*numbers, "groups_sha256", "pairs", "times", "groups"]}
                ids = list(both.tokenise([x or "" for x in every[start:end]]))
                for (a, b), (n, groups, pairs, times) in zip(ids, both.align(ids)):
                    hashed = hashlib.sha256(groups.encode()).hexdigest() if n else ""
                    values = len(a), len(b), n, int(times.sum()), hashed, pairs.tobytes(), times.astype("<u4").tobytes(), groups
                    for c, value in zip(rows, values):
                        rows[c].append(value)
                kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.string()]
                arrays = [pa.array(rows[c], k) for c, k in zip(rows, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(arrays if store else arrays[:-1])], names=["_row", key, *(rows if store else [*rows][:-1])])

    schema = f"_row long, `{key}` {dict(docs.dtypes)[key]}, {', '.join(f'{c} long' for c in numbers)}, groups_sha256 string, pairs binary, times binary" + (", groups string" if store else "")
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key), F.col(text)).mapInArrow(run, schema)


def _joined(column, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a binary column, and where each row's begin (one more than rows)."""
    parts = [np.frombuffer(x, dtype=dtype) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, dtype=dtype), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def pair_counts(aligned: DataFrame, size_b: int, code: np.dtype) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of its A id has a larger n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                pairs, n = np.unique(_joined(batch.column(0).slice(start, ROWS), code)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counts = stage(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    of_a = F.floor(F.col("pair") / size_b).cast("long")
    # One row for each id of A at most: bounded by its vocabulary.
    most = F.broadcast(counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most")))
    return counts.join(most, of_a == most["a"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary_a: str | None = None, vocabulary_b: str | None = None, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """`key`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs`.

    The count of an id pair is the number of rows that hold it linked; n_best counts links whose pair has the
    highest count of its A id (ties included), count_sum adds the counts of all links.  Rows as in `align_documents`."""
    path_a, path_b = vocabulary_a or default_vocabulary("byte_bpe_50k.json"), vocabulary_b or default_vocabulary("piece_bpe_32k.model")
    both = aligner(path_a, path_b)
    code, size_b = both.code, both.size_b
    aligned = stage(align_documents(docs, key=key, text=text, vocabulary_a=path_a, vocabulary_b=path_b), "aligned")
    counts = stage(pair_counts(aligned, size_b, code), "pair-bests")
    # A fixed number of rows, whatever the corpus.
    rows = counts.orderBy(F.col("n").desc(), "pair").limit(common_pairs).toArrow()
    order = np.argsort(rows.column("pair").to_numpy())
    common = docs.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = common.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                (pairs, at), times = _joined(batch.column("pairs"), code), _joined(batch.column("times"), np.dtype("<u4"))[0].astype(np.int64)
                place = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
                known = pair[place] == pairs if len(pair) else np.zeros(len(pairs), dtype=bool)
                place = place[known]
                sums = []
                for value in (np.where(best[place], 1, 0), n[place]):
                    every = np.zeros(len(pairs), dtype=np.int64)
                    every[known] = value * times[known]
                    total = np.concatenate([[0], np.cumsum(every)])
                    sums.append(pa.array(total[at[1:]] - total[at[:-1]]))
                left = np.concatenate([[0], np.cumsum(~known)])[at].astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(pairs[~known].astype(np.int64)), pa.array(times[~known])], names=["pair", "times"])
                yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *sums, pa.ListArray.from_arrays(pa.array(left), rare)], names=[*kept, "_best", "_sum", "_rare"])

    kept = ["_row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join(f"`{c}` {t}" for c, t in aligned.select(kept).dtypes) + ", _best long, _sum long, _rare array<struct<pair: long, times: long>>"
    met = stage(aligned.mapInArrow(run, schema), "met")
    rare = met.select("_row", F.inline("_rare")).join(counts, "pair").groupBy("_row")
    rare = rare.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_b"), F.sum(F.col("times") * F.col("n")).alias("_s"))
    total = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).cast("long")
    out = met.drop("_rare").join(rare, "_row", "left")
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", total("_best", "_b").alias("n_best"), total("_sum", "_s").alias("count_sum"), "groups_sha256")
