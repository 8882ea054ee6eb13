"""WARC archives: a writer that records repeated payloads as revisits, and a reader that splits the files.

An archive is a row of gzip members, one record in each.  Nothing says where they begin, so a reader of a byte
range looks for the three bytes that begin a member and tries each place: a record begins there if what follows
inflates to a WARC header, and if the members after it follow one another to the end of the range.  A task owns
the records that begin inside its range and reads the last of them beyond its end; a record is read by one task
whatever the ranges are.  Files are read in pieces and inflated record by record, so a task holds one record at a time.

Archives are written by the tasks to the shared folder, each attempt to files of its own names; only the names
that a task that ended has returned are read, so a lost or repeated task leaves nothing but a file nobody asks for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stage

#: What a gzip member of deflated data begins with, and the header line of a record.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a task begins another archive, and bytes of an archive that a task reads.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
#: Bytes read at a time.
READ_BYTES = 1 << 18
#: Rows that are taken out of an Arrow batch at a time.
ROWS = 256
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1_000
#: A payload in more than one of so many records counts as hot; there are at most as many of those.
HOT_SHARE = 1_000

_FILES = "path string, bytes long, records long"
_RECORDS = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def open_store(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def record(identity: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit of the record `refers_to`: its block ends with the HTTP header."""
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{identity}>"), ("WARC-Date", date)]
    if uri is not None:
        headers.append(("WARC-Target-URI", quote(uri, safe=";/?:@&=+$,#%[]!'()*~")))
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{refers_to}>")]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(headers, http if refers_to else http + payload)


def fields(lines: list[bytes]) -> dict[str, str]:
    return {name.strip().lower(): value.strip() for name, _, value in (x.decode("utf-8", "replace").partition(":") for x in lines)}


class Archive:
    """Records of one archive by the byte range in which they begin."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def _read(self, at: int) -> bytes:
        return self.file.read_at(max(0, min(READ_BYTES, self.size - at)), at)

    def inflate(self, at: int, only_header: bool = False) -> tuple[bytes, int] | None:
        """The content of the member that begins at `at`, and where it ends; nothing if no record begins there."""
        unpacker, parts, held, seen = zlib.decompressobj(31), [], 0, b""
        try:
            while not unpacker.eof:
                data = self._read(at)
                if not data:
                    return None
                at += len(data)
                parts.append(unpacker.decompress(data))
                held += len(parts[-1])
                if len(seen) < len(VERSION) <= held:
                    seen = b"".join(parts)[: len(VERSION)]
                    if seen != VERSION:
                        return None
                if only_header and b"\r\n\r\n" in (whole := b"".join(parts)):
                    return whole, at
        except zlib.error:
            return None
        return (b"".join(parts), at - len(unpacker.unused_data)) if seen == VERSION else None

    def candidates(self, start: int, end: int) -> Iterator[int]:
        """Places in [start, end) where the bytes of a member's beginning stand."""
        at = start
        while at < end:
            data = self._read(at)
            found = data.find(MAGIC)
            while 0 <= found and at + found < end:
                yield at + found
                found = data.find(MAGIC, found + 1)
            if at + len(data) >= self.size:
                return
            at += len(data) - len(MAGIC) + 1

    def chained(self, at: int, end: int) -> bool:
        """Do records follow one another from `at` to the end of the range, or of the file?"""
        while at < min(end, self.size):
            found = self.inflate(at)
            if found is None:
                return False
            at = found[1]
        return at >= self.size or self.inflate(at, only_header=True) is not None

    def _first(self, start: int, end: int) -> int:
        """Where the first record at or after `start` begins; `end` if none begins before."""
        if start == 0:  # a record begins there for certain
            return 0
        for at in self.candidates(start, end):
            if self.inflate(at, only_header=True):
                if self.chained(at, end):
                    return at
                # A member within a payload, or a damaged one further on: only the records before can tell.
                at = 0
                while at < start:
                    at = self._next(at)[1]
                return at
        return end

    def _next(self, at: int) -> tuple[bytes, int]:
        found = self.inflate(at)
        if found is None:
            raise ValueError(f"no record at byte {at}")
        return found

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """Offset and content of the records that begin in [start, end)."""
        at = self._first(start, end)
        while at < min(end, self.size):
            content, after = self._next(at)
            yield at, content
            if end <= after < self.size and not self.inflate(after, only_header=True):
                raise ValueError(f"no record at byte {after}")
            at = after


def parsed(content: bytes) -> dict:
    """The fields of one record; the payload of a response is held against its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    names = fields(head.split(b"\r\n")[1:])
    block = rest[: int(names["content-length"])]
    out = {"record_id": names["warc-record-id"].strip("<>"), "record_type": names["warc-type"], "target_uri": names.get("warc-target-uri")}
    out["refers_to"] = names["warc-refers-to"].strip("<>") if "warc-refers-to" in names else None
    if not names.get("content-type", "").startswith("application/http"):
        return out
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(names["warc-payload-digest"].removeprefix("sha1:")).hex()
    if out["record_type"] == "revisit":
        return out | {"payload_digest": digest, "payload_bytes": int(fields(http.split(b"\r\n")[1:])["content-length"])}
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {out['record_id']}: the payload does not have the digest {digest}")
    return out | {"payload_digest": digest, "payload_bytes": len(payload), "payload": payload}


def _revisits(rows: DataFrame) -> DataFrame:
    """Add newest, the largest key among equal payloads of LEAST_REVISIT bytes or more, else null.

    Payloads are equal when digest and length are.  Hot ones are looked up without moving their rows: those
    with more than a thousandth of the rows are at most a thousand.  The others meet by their digest."""
    long = F.col("payload_bytes") >= LEAST_REVISIT
    groups = rows.filter(long).groupBy("payload_digest", "payload_bytes").agg(F.max("key").alias("newest"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups.filter("n > 1"), "equal-payloads")
    total = rows.select("payload_bytes").count()
    hot = groups.filter(F.col("n") * HOT_SHARE > total).select(F.col("payload_digest").alias("hot_digest"), F.col("payload_bytes").alias("hot_bytes"), F.col("newest").alias("hot_newest"))
    rest = groups.filter(F.col("n") * HOT_SHARE <= total).select(F.col("payload_digest").alias("on"), F.col("payload_bytes").alias("on_bytes"), F.col("newest").alias("met_newest"))
    looked = rows.join(F.broadcast(hot), (F.col("payload_digest") == F.col("hot_digest")) & (F.col("payload_bytes") == F.col("hot_bytes")), "left")
    # Rows that need no partner get a value of their own, so that they spread.
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    keyed = looked.withColumn("_on", F.when(long & F.col("hot_digest").isNull(), F.col("payload_digest")).otherwise(alone))
    met = keyed.join(rest, (F.col("_on") == F.col("on")) & (F.col("payload_bytes") == F.col("on_bytes")), "left")
    return met.withColumn("newest", F.coalesce("hot_newest", "met_newest")).drop("hot_digest", "hot_bytes", "hot_newest", "_on", "on", "on_bytes", "met_newest")


def write_warc(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of `pages` to archives in the shared folder; returns path, bytes, records of each.

    A null html is an empty payload.  Of rows with equal payloads of at least LEAST_REVISIT bytes those with the
    largest key are responses and the others revisits of it; where none of them has a key, and below that size,
    all are responses.  A record is named by its key; rows that repeat a key repeat the name, rows without one
    get a name from their content.  A null url gives no target.  `pages` has no date, so all records carry
    `date`.  Other columns are not read; no rows give no archives."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    rows = _revisits(rows)
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    unnamed = F.concat(F.lit("urn:sha1:"), F.sha1(F.concat_ws(" ", "payload_digest", "uri")))
    refers = F.when(F.col("newest").isNotNull() & ~F.col("newest").eqNullSafe(F.col("key")), name(F.col("newest")))
    ready = rows.select(F.coalesce(name(F.col("key")), unnamed).alias("name"), "uri", "payload", "payload_digest", refers.alias("refers"))
    root = scratch_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        out, path, size, records = None, "", 0, 0

        def ended() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]})

        for row in (x for batch in batches for a in range(0, batch.num_rows, ROWS) for x in batch.slice(a, ROWS).to_pylist()):
            if out is None:
                path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(open_store(path)[1], compression=None)
                info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                out.write(info)
                size, records = len(info), 0
            data = record(row["name"], row["uri"], row["payload"], row["payload_digest"], row["refers"], date)
            out.write(data)
            size, records = size + len(data), records + 1
            if size >= archive_bytes:
                yield ended()
                out = None
        if out is not None:
            yield ended()

    return stage(ready.mapInArrow(write, _FILES), "archives")


def read_warc(files: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives `files` (path, bytes), each with its offset; warcinfo records too.

    A revisit has no payload; its length and digest are those that its headers give.  Archives may be written by
    others.  A damaged member, or a payload unlike its digest, fails the task with its place.  Only records that a
    payload holds uncompressed over more than a whole range could be taken for records of the archive."""
    spark: SparkSession = files.sparkSession
    starts = F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {int(range_bytes)}L)"))
    ranges = files.filter("bytes > 0").select("path", "bytes", starts.alias("start"))
    n = ranges.count()
    dealt = ranges.repartition(max(1, min(n, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (x.split() for x in _RECORDS.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, inner = open_store(row["path"])
                held, weight = [], 0
                with store.open_input_file(inner) as file:
                    for at, content in Archive(file, row["bytes"]).records(row["start"], row["start"] + range_bytes):
                        held.append({"path": row["path"], "offset": at} | parsed(content))
                        weight += len(content)
                        if weight >= 16 << 20:
                            yield pa.RecordBatch.from_pydict({c: [x.get(c) for x in held] for c in names}, schema=kinds)
                            held, weight = [], 0
                yield pa.RecordBatch.from_pydict({c: [x.get(c) for x in held] for c in names}, schema=kinds)

    return dealt.mapInArrow(read, _RECORDS)


def archived_pages(pages: DataFrame, *, key: str = "page_id", range_bytes: int = RANGE_BYTES, **names: str) -> DataFrame:
    """`key`, payload_bytes, payload_digest, record_type, refers_to of each page, read back from archives of `pages`."""
    read = read_warc(write_warc(pages, key=key, **names), range_bytes=range_bytes)
    number = lambda c: F.when(F.col(c).startswith("urn:page:"), F.substring_index(c, ":", -1)).cast(pages.schema[key].dataType)
    pages_only = read.filter(F.col("record_type").isin("response", "revisit"))
    return pages_only.select(number("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
