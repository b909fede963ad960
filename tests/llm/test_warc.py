import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lorelink.llm import warc
from lorelink.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, digest string, record_type string"


def round_trip(spark, rows, **how):
    path = warc.write_archives(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA), shared_path(spark, "test"), **how)
    records = warc.read_archives(spark, path, payloads=True)
    return {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(records).collect()}, records, path


def expected(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = set()
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and i is not None and i < last[h or ""]
        out.add((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    return out


def test_round_trip(spark):
    rng = random.Random(3)
    big = ["".join(rng.choice("abc é<\r\n") for _ in range(1200)) for _ in range(5)]
    rows = [(i, f"http://h/{i}", rng.choice(big)) for i in range(200)]
    rows += [(500 + i, "u", "same\r\n\r\nsmall") for i in range(5)]
    rows += [(600, None, None), (601, "", ""), (602, "bad\r\nurl x", "WARC/1.1\r\n\r\n"), (603, "u", "x" * 3_000_000), (604, "u", "x" * 3_000_000), (605, "u", "y" * 999), (606, "u", "y" * 999), (607, "u", "y" * 1000), (608, "u", "y" * 1000), (None, "u", big[0]), (7, "again", big[1])]
    rows += [rows[0], rows[199]]
    got, records, path = round_trip(spark, rows, archive_bytes=100_000)
    assert got == expected(rows)
    assert records.count() == len(rows)
    payloads = {r.page_id: r.payload for r in records.where("record_type = 'response'").collect()}
    for i, _, h in rows:
        if payloads.get(i) is not None and i not in (7,):
            assert payloads[i] == (h or "")
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    assert len(files) > 3 and all(gzip.decompress(f.content).startswith(b"WARC/1.1\r\n") for f in files if len(f.content) > 30)


def test_empty_table(spark):
    got, records, _ = round_trip(spark, [])
    assert got == set() and records.count() == 0


def test_broken_archives():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nWARC-Payload-Digest: sha1:0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse_archive(good))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.parse_archive(good[:-8]))
    with pytest.raises(ValueError, match="begins with"):
        list(warc.parse_archive(b"HTTP/1.1\r\n\r\n"))
    assert list(warc.parse_archive(gzip.compress(good.replace(b"response", b"revisit")) * 2))[1]["page_id"] == 1


def test_missing_response(spark):
    one = spark.createDataFrame([(1, "revisit", "d", None, 2)], "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long")
    with pytest.raises(Exception, match="no response"):
        warc.resolved(one).collect()
    assert warc.resolved(one.where(F.lit(False))).count() == 0
