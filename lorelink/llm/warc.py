"""WARC archives in which equal payloads are stored once.

Headers alone (id, digest, length) are shuffled by payload digest to find each payload's original; revisit records are
joined to it, and archives are written anew: originals as `response` records with their payload, the others as `revisit`
records with fresh headers that point at the original. Spark's text writer writes them, with a record's closing blank
lines as line separator, so they are committed as any table is and an executor's loss leaves no half archive.

Reading goes the other way: each file is unpacked and parsed by Content-Length, payload digests are checked, and
revisits are joined to the responses they refer to, which have the payload.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, settled, shuffle_partitions

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
END = "\r\n\r\n"


def resolve_revisits(headers: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, digest, refers_to of each record whose payload another record has, that one having the largest id.

    headers: page_id, digest, bytes. Only payloads of at least least_bytes count. Rows that repeat a page_id with the
    same payload are one record; null ids are never resolved. Counting is combined before the shuffle. The originals are a
    table of their own and the result is dealt anew, so both sides of the join are plain shuffles, which Spark can split
    where very many records share a digest.
    """
    large = headers.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull())
    originals = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).where("_least < refers_to").drop("_least")
    joined = large.join(settled(originals, "warc-originals"), "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to")
    return joined.repartition("page_id", "digest").distinct()


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def record_text(date: str) -> Column:
    """A whole record but for its closing blank lines, of page_id, url, payload, digest, refers_to."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.octet_length("payload")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "")
    header = [
        F.lit(f"{VERSION}\r\n"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n")),
        F.concat(F.lit(f"WARC-Record-ID: <{RECORD_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">\r\n")),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(_line("WARC-Target-URI", uri), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(F.concat(F.lit(f"WARC-Refers-To: <{RECORD_ID}"), F.col("refers_to").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n")), F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    ]
    return F.concat(*header)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, archive_bytes: int = 512 << 20, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write a record for each row of page_id, url, html as gzipped archives of about archive_bytes (before gzip) below path.

    Few pages make smaller archives, up to one for each shuffle partition, of 32 MB at least, so that all tasks have some.

    A null html is an empty payload, a null url leaves out its header. Control characters and blanks in a url, which
    would break the header, are left out of it. Returns path.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumns({"digest": F.sha1(F.encode("payload", "utf-8")), "bytes": F.octet_length("payload").cast("long")})
    total = base.agg(F.sum("bytes")).first()[0] or 0
    revisits = settled(resolve_revisits(base.select("page_id", "digest", "bytes"), least_bytes), "warc-revisits")
    files = max(1, math.ceil(total / archive_bytes), min(shuffle_partitions(pages.sparkSession), math.ceil(total / (32 << 20))))
    dealt = base.repartition(files, "page_id", "digest").join(revisits, ["page_id", "digest"], "left")  # payloads move once: the join keeps this partitioning
    dealt.select(record_text(date).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an unpacked archive that comes in chunks."""
    held, more = bytearray(), True

    def fill(n: int) -> bool:
        nonlocal more
        while more and len(held) < n:
            got = next(chunks, None)
            if got is None:
                more = False
            else:
                held.extend(got)
        return len(held) >= n

    while fill(1):
        at, looked = -1, 0
        while (at := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not fill(looked + 1):
                raise ValueError("an archive ends within a header")
        first, *lines = bytes(held[:at]).decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"a record begins with {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        if not fill(at + 4 + n):
            raise ValueError("an archive ends within a block")
        block = bytes(held[at + 4 : at + 4 + n])
        fill(at + 8 + n)
        if held[at + 4 + n : at + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record doesn't end with two blank lines")
        del held[: at + 8 + n]
        yield fields, block


def _unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Chunks of gzip data of one or several members, or of data that isn't packed."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    while data:
        unzip = zlib.decompressobj(31)
        for i in range(0, len(data), step):
            if part := unzip.decompress(data[i : i + step]):
                yield part
            if unzip.eof:
                break
        data = unzip.unused_data + data[i + step :]


def _id(value: str) -> int | None:
    text = value.strip("<>").removeprefix(RECORD_ID)
    return None if text == "null" else int(text)


def parse_archive(data: bytes) -> Iterator[dict]:
    """Rows of page_id, record_type, digest (as stated), payload, refers_to. A response whose payload doesn't have its digest raises ValueError."""
    for fields, block in _records(_unpacked(data)):
        kind = fields["warc-type"]
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{fields['warc-record-id']}: its payload doesn't have its digest")
        yield {"page_id": _id(fields["warc-record-id"]), "record_type": kind, "payload_digest": digest, "url": fields.get("warc-target-uri"), "payload": payload, "refers_to": _id(fields["warc-refers-to"]) if "warc-refers-to" in fields else None}


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, record_type, payload_digest, url, payload_bytes, refers_to of each record; with `payloads` its payload too, null in revisits.

    An archive is read by one task, which holds its packed bytes and one record at a time.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "payload_digest", "url", "payload_bytes", "refers_to"] + ["payload"] * payloads
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * payloads
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for x in parse_archive(data.as_py()):
                    n = len(x["payload"]) if x["payload"] is not None else None
                    size += 200 + (n or 0) * payloads
                    rows.append((x["page_id"], x["record_type"], x["payload_digest"], x["url"], n, x["refers_to"]) + (None if x["payload"] is None else x["payload"].decode("utf-8", "replace"),) * payloads)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    shape = "page_id long, record_type string, payload_digest string, url string, payload_bytes long, refers_to long" + ", payload string" * payloads
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return map_arrow(files, parse, shape)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits get the length of the payload they refer to.

    The join is on the response's id and digest; a revisit that refers to no such response raises an error. Responses are
    a table of their own, so that Spark can split the join where very many revisits refer to one.
    """
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("_bytes")).where("refers_to IS NOT NULL").dropDuplicates(["refers_to", "payload_digest"])
    joined = records.join(settled(responses, "warc-responses"), ["refers_to", "payload_digest"], "left")
    size = F.coalesce("payload_bytes", "_bytes")
    checked = F.when(size.isNull(), F.raise_error(F.concat(F.lit("no response for the revisit of "), F.col("page_id").cast("string"))).cast("long")).otherwise(size)
    return joined.select("page_id", checked.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
