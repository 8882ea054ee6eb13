"""WARC archives: every split gives the same records, false members are not taken, and the digests are those of the pages."""

import gzip
import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from vaneflow.llm import warc
from vaneflow.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string"


def stored(data: bytes) -> bytes:
    """A gzip member whose bytes stand in it as they are."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def archive_of(members):
    data = b"".join(members)
    return warc.Archive(pa.BufferReader(data), len(data)), data


def payload_record(name: str, payload: bytes, pack=None) -> bytes:
    made = warc.record(name, "http://x/", payload, hashlib.sha1(payload).hexdigest(), None, "2000-01-01T00:00:00Z")
    return pack(gzip.decompress(made)) if pack else made


def owned(archive, size, step):
    return [(at, warc.parsed(c)["record_id"]) for a in range(0, size, step) for at, c in archive.records(a, a + step)]


def test_each_record_is_owned_once_whatever_the_ranges():
    rnd = random.Random(3)
    inner = payload_record("inner", b"a record within a payload")
    noise = bytes(rnd.randrange(256) for _ in range(3_000))
    payloads = [b"", b"x", noise, warc.MAGIC * 40, b"gzip " + gzip.compress(b"not a record") + b"!", inner, b"z" + inner + b"WARC/1.1" + inner, b"text " * 9_000]
    names, members = [], []
    for i, payload in enumerate(payloads * 2):
        names.append(f"urn:{i}")
        members.append(payload_record(names[-1], payload, stored if i % 2 == 0 or b"inner" in payload or warc.MAGIC in payload else None))
    archive, data = archive_of(members)
    starts = [sum(map(len, members[:i])) for i in range(len(members))]
    for step in (1, 7, 64, 333, 1_000, 20_000, len(data)):
        assert owned(archive, len(data), step) == list(zip(starts, names)), step


def test_damage_is_not_passed_over():
    members = [payload_record(f"urn:{i}", b"some text " * 50) for i in range(6)]
    broken = members[3][:20] + bytes([members[3][20] ^ 255]) + members[3][21:]
    archive, data = archive_of([*members[:3], broken, *members[4:]])
    with pytest.raises(ValueError, match="no record at byte"):
        owned(archive, len(data), len(members[0]) + 10)
    with pytest.raises(ValueError, match="does not have the digest"):
        warc.parsed(gzip.decompress(warc.record("urn:a", None, b"payload", hashlib.sha1(b"other").hexdigest(), None, "x")))


def pages_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "payload", "path", "bytes", "n", "newest", "uri", "on")})


def by_hand(rows):
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        equal = [k for k, _, h in rows if (h or "").encode() == payload and k is not None]
        newest = max(equal) if equal and len(payload) >= 1000 else None
        again = newest is not None and newest != key
        out.append((key, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", newest if again else None))
    return sorted(out, key=str)


def hostile():
    long, other = "é" * 500, "b" * 999
    rows = [(1, "http://a/1", long), (5, "http://a/ä b\r\nX: y", long), (5, None, long), (2, "http://a", other), (3, "http://a", other), (None, "u", long), (None, None, "k" * 2_000), (None, None, "k" * 2_000)]
    rows += [(7, "v", None), (8, "v", ""), (9, "v", "WARC/1.1\r\n\r\n"), (10, "w", "x y" * 400_000), (2**62 + 1, "h", "h" * 1_000), (2**62, "h", "h" * 1_000)]
    return rows + [(100 + i, f"http://hot/{i}", "hot page " * 200) for i in range(60)]


@pytest.mark.parametrize("range_bytes", [97, 4_096, warc.RANGE_BYTES])
def test_pages_come_back(spark, range_bytes):
    rows = hostile()
    docs = pages_of(spark, rows).repartition(3)
    got = warc.archived_pages(docs, range_bytes=range_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)


def test_archives_hold_whole_records(spark):
    rows = hostile()
    files = warc.write_warc(pages_of(spark, rows).coalesce(1), archive_bytes=2_000)
    assert files.count() > 3 and files.agg(F.sum("records")).first()[0] == len(rows)
    read = warc.read_warc(files, range_bytes=500).collect()
    assert sum(r["record_type"] == "warcinfo" for r in read) == files.count()
    kept = {r["record_id"]: r for r in read if r["record_type"] == "response"}
    assert kept["urn:page:10"]["payload"].decode() == "x y" * 400_000
    assert kept["urn:page:5"]["target_uri"] is None or "\n" not in kept["urn:page:5"]["target_uri"]
    # Any gzip reader can read them.
    path = warc.open_store(files.first()["path"])[1]
    with gzip.open(path) as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_hot_and_other_copies_agree(spark, monkeypatch):
    rows = [(i, "u", "hot " * 300) for i in range(50)] + [(100 + i, "u", f"pair {i // 2} " * 200) for i in range(20)]
    for share in (1, 10**9):  # all looked up by key, all as hot
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        got = warc.archived_pages(pages_of(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)


def test_no_pages(spark):
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES["op12_warc_archives"](spark, sf), duck(sf), ORACLES["op12_warc_archives"]) == []
