"""Operator 5: WARC archives with revisit resolution.

Archives are gzip-compressed WARC files (a member per record), written through
Spark's own writer, so that failed tasks leave nothing behind and any store that
Spark reaches will do. A file holds ``FILE_BYTES`` of records, or one longer record.

- ``write_archives`` writes a response per page.
- ``read_archives`` reads the headers of archives' records, payload digests checked.
- ``resolve`` writes deduplicated archives with fresh headers: only the records' headers
  are shuffled, by payload digest. Of equal payloads the response with the smallest page id
  stays (among equal ids the first read), the others become revisits that refer to
  it. Revisits that the archives hold already refer to the response of their digest
  that stays; where there is none they, like records of other types, are written as they are.
- ``write_deduplicated`` is both for pages; ``originals`` joins revisits to the
  responses that they refer to.

Null payloads are empty and null urls are written without a target. Null page ids
come after all others. Payloads below ``min_bytes`` stay responses. Records without a payload
digest or page id are kept.

Foreign archives: names of headers in any case, repeated and unknown ones and dates of capture are kept. Payloads of
responses are always digested by SHA-1; a digest of another kind in their header isn't checked and stays there.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, load, new_path

FILE_BYTES = 256 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

#: A record ends with two line ends; they are a gzip member of their own, which Spark's writer puts after each record.
_MEMBER_END = gzip.compress(END, 1, mtime=0).decode("latin-1")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Head(list):
    """Header lines (name, value) of a record, in order; names may come again and their case doesn't matter."""

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for n, v in self if n.lower() == name.lower()), default)

    def without(self, *names: str) -> Head:
        gone = {n.lower() for n in names}
        return Head((n, v) for n, v in self if n.lower() not in gone)


def record(kind: str, fields: Head, block: bytes) -> bytes:
    """A record of WARC 1.1 without its ending: ``fields`` as they are, with the date of now if they have none, and a fresh type, block digest and length. Fields that are None are left out."""
    rest = fields.without("WARC-Type", "WARC-Block-Digest", "Content-Length")
    dated = Head([] if rest.get("WARC-Date") else [("WARC-Date", datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))])
    head = [("WARC-Type", kind), *dated, *rest, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n").encode() + block


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def response(page: int | None, url: str | None, payload: bytes, record_id: str) -> bytes:
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None
    fields = [("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Page-Id", page), ("Content-Type", "application/http; msgtype=response")]
    return record("response", Head(fields), _http(len(payload)) + payload)


def parse(content: bytes) -> Iterator[tuple[Head, bytes]]:
    """Headers and block of each record of an archive, in order. A line that begins with a blank goes on with the one before."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
        while line := stream.readline():
            if not line.strip():
                continue
            head = Head()
            while (line := stream.readline()).strip(b"\r\n"):
                text = line.decode("utf-8", "replace")
                if text[0] in " \t" and head:
                    head[-1] = (head[-1][0], f"{head[-1][1]} {text.strip()}")
                    continue
                name, _, value = text.partition(":")
                head.append((name.strip(), value.strip()))
            yield head, stream.read(int(head.get("Content-Length", "0")))


def _sha1(said: str | None) -> str | None:
    """The digest of a payload as this module writes it, if it is one of SHA-1 (bare or named); others as they are."""
    if not said:
        return None
    name, _, value = said.rpartition(":")
    return value.upper() if name.lower() in ("", "sha1") else said


#: Parts of a task that are written side by side, without a sort.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _write(records: DataFrame, path: str) -> str:
    """Records (record, part) as files, one for each part of a task."""
    spark = records.sparkSession
    before = spark.conf.get(_WRITERS, "0")
    spark.conf.set(_WRITERS, "1024")
    try:
        out = records.select(F.col("record").cast("string").alias("value"), "part").write.partitionBy("part")
        out.option("lineSep", _MEMBER_END).option("encoding", "ISO-8859-1").text(path)
    finally:
        spark.conf.set(_WRITERS, before)
    return path


RECORD = "record binary, part int"


def _parts(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Packed records in batches, with the number of the file of this task that they belong to."""
    out, waiting, total = [], 0, 0
    for data in records:
        packed = _member(data)
        out.append((packed, total // FILE_BYTES))
        total, waiting = total + len(data), waiting + len(packed)
        if waiting > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32()))], names=["record", "part"])
            out, waiting = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32()))], names=["record", "part"])


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    yield from _parts(response(page, url, (html or "").encode(), _new_id()) for page, url, html in rows)


def write_archives(pages: DataFrame, path: str) -> str:
    """A response record for each row of ``pages`` (page_id, url, html), in files below ``path``."""
    return _write(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_responses, RECORD), path)


def write_deduplicated(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """A record for each row of ``pages`` (page_id, url, html): responses, and revisits of payloads that a smaller id has."""
    spark = pages.sparkSession
    raw = write_archives(pages, f"{new_path(spark, 'warc')}/raw")
    resolve(spark, raw, path, min_bytes)
    at = spark._jvm.org.apache.hadoop.fs.Path(raw)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


HEADERS = "path string, seq int, record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to_id string, date string, target_uri string"


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for seq, (head, block) in enumerate(parse(content.as_buffer())):
                kind = head.get("WARC-Type", "")
                if kind == "warcinfo":
                    continue
                said, size, page = _sha1(head.get("WARC-Payload-Digest")), None, head.get("X-Page-Id", "")
                if kind == "response":
                    payload = block.partition(END)[2]
                    found, size = digest(payload), len(payload)
                    if said and ":" not in said and said != found:
                        raise ValueError(f"{path}: record {seq} says payload digest {said}, its payload has {found}")
                    said = found
                rows.append((path, seq, head.get("WARC-Record-ID"), int(page) if re.fullmatch("-?[0-9]{1,18}", page) else None, kind, size, said, head.get("WARC-Refers-To"), head.get("WARC-Date"), head.get("WARC-Target-URI")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=[c.split()[0] for c in HEADERS.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record below ``path`` but warcinfo, payload digests of responses checked."""
    return _files(spark, path).mapInArrow(_headers, HEADERS)


#: What a revisit says of the response that it refers to.
_REFERS = ("WARC-Refers-To", "WARC-Refers-To-Date", "WARC-Refers-To-Target-URI")


def _rewritten(content: pa.Buffer, changed: dict[int, tuple]) -> Iterator[bytes]:
    """The records of an archive with fresh block digests and lengths, and all their other headers, dates of capture too; those that ``changed`` names are revisits of the record it gives (id, date, target)."""
    yield record("warcinfo", Head([("WARC-Record-ID", _new_id()), ("Content-Type", "application/warc-fields")]), b"software: lodestar\r\nformat: WARC File Format 1.1\r\n")
    for seq, (head, block) in enumerate(parse(content)):
        kind = head.get("WARC-Type", "")
        if kind == "warcinfo":
            continue
        if seq in changed:
            said = head.get("WARC-Payload-Digest") or f"sha1:{digest(block.partition(END)[2])}"
            kept = head.without("WARC-Payload-Digest", "WARC-Profile", *_REFERS)
            head = Head([*kept, ("WARC-Payload-Digest", said), ("WARC-Profile", PROFILE), *zip(_REFERS, changed[seq])])
            kind, block = "revisit", block.partition(END)[0] + END
        yield record(kind, head, block)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archives = ((content.as_buffer(), changed) for batch in batches for content, changed in zip(batch.column(0), batch.column(1).to_pylist()))
    yield from _parts(data for content, changed in archives for data in _rewritten(content, {c["seq"]: (c["to"], c["date"], c["uri"]) for c in changed or []}))


def resolve(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> str:
    """Deduplicated archives of those below ``source``, written below ``target``."""
    heads = Scratch(spark, "heads").write(read_archives(spark, source))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "seq", "record_id", "date", "target_uri")
    firsts = heads.where("record_type = 'response'").groupBy("payload_digest").agg(F.min(order).alias("first"))
    repeated = heads.where(f"record_type = 'revisit' OR record_type = 'response' AND payload_bytes >= {int(min_bytes)}").join(firsts, "payload_digest")
    # Only records that change are gathered, those of an archive in one list.
    changed = repeated.where("NOT (path = first.path AND seq = first.seq)").groupBy("path").agg(F.collect_list(F.struct("seq", F.col("first.record_id").alias("to"), F.col("first.date").alias("date"), F.col("first.target_uri").alias("uri"))).alias("changed"))
    return _write(_files(spark, source).join(changed, "path", "left").select("content", "changed").mapInArrow(_rewrite, RECORD), target)


def originals(records: DataFrame) -> DataFrame:
    """Records of ``read_archives``, revisits with the page and payload size of the response they refer to."""
    first = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("__bytes"))
    return records.join(first, "refers_to_id", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes")).drop("__bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_deduplicated(load(spark, sf_dir, "pages"), f"{new_path(spark, 'warc')}/archives")
    records = Scratch(spark, "records").write(read_archives(spark, path))
    return originals(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX = "sha1(coalesce(html, ''))"
# Base32 of the 160-bit digest: eight groups of five hex digits (20 bits), four letters each.
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) // {32 ** (3 - j)}) % 32 AS INTEGER) + 1, 1)" for g in range(8) for j in range(4)
)

ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, {_HEX} AS h FROM pages),
q AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM q
"""
