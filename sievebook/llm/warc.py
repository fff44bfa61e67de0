"""WARC records as a chunked record table.

An archive is a table of (record_no, chunk_no, last, data, sha1) rows: the
data of a record's chunks, one after the other, are the bytes of its WARC
record, and sha1 is the digest of the payload up to the end of the chunk.
Writer and reader get an Arrow batch of chunks at a time and go on chunk by
chunk, whatever the size of the record; only Spark's own row of the input
holds a payload whole. ``stream`` gives the bytes of a WARC file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, lookup, remove, shared_dir

CHUNK = 1 << 18
#: Bytes of a row group that a task's Parquet writer holds.
BLOCK = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_TABLE = "record_no long, chunk_no int, last boolean, data binary, sha1 binary"
_SCHEMA = pa.schema([("record_no", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("sha1", pa.binary())])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header(page_id: int | None, record_no: int, url: str | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The header of a record, and for a response that of HTTP."""
    own = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:none-{record_no}>"
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return "\r\n".join(lines).encode() + _END + http


class Writer:
    """One record, fed chunk by chunk: gives each chunk's bytes and the digest of the payload up to its end."""

    def __init__(self) -> None:
        self.running = hashlib.sha1()

    def feed(self, head: bytes, part: bytes, last: bool) -> tuple[bytes, bytes]:
        self.running.update(part)
        return head + part + (_END if last else b""), self.running.digest()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload chunks in order of record and chunk, to rows of the archive."""
    writer = Writer()
    for batch in batches:
        numbers, chunk_no, last = (batch.column(i) for i in range(3))
        data, sha1 = [], []
        for n, end, part, page, no, url, size, digest, refers in zip(chunk_no.to_pylist(), last.to_pylist(), *(batch.column(i) for i in (3, 4, 0, 5, 6, 7, 8))):
            head = b""
            if n == 0:
                writer = Writer()
                refers_to = refers.as_py()
                head = header(page.as_py(), no.as_py(), url.as_py(), size.as_py(), base32(bytes.fromhex(digest.as_py())), refers_to, refers_to is not None)
            row, running = writer.feed(head, part.as_py(), end)
            data.append(row)
            sha1.append(running)
        yield pa.RecordBatch.from_arrays([numbers, chunk_no, last, pa.array(data, pa.binary()), pa.array(sha1, pa.binary())], schema=_SCHEMA)


class Reader:
    """One record, fed chunk by chunk: its header, then payload bytes into a digest. The payload is not kept."""

    def __init__(self) -> None:
        self.head, self.digest, self.size, self.left = b"", hashlib.sha1(), 0, None
        self.fields: dict[str, str] = {}

    def feed(self, data: bytes, running: bytes) -> None:
        if self.left is None:
            self.head += data
            at = self.head.find(_END)
            http = self.head.find(_END, at + 4) if at >= 0 else -1
            if http < 0:
                return
            self.fields = dict(line.split(": ", 1) for line in self.head[:at].decode().split("\r\n")[1:])
            self.http = dict(line.split(": ", 1) for line in self.head[at + 4 : http].decode().split("\r\n")[1:])
            self.left = int(self.fields["Content-Length"]) - (http - at)
            data, self.head = self.head[http + 4 :], b""
        part = data[: self.left]
        self.left -= len(part)
        self.size += len(part)
        self.digest.update(part)
        if self.digest.digest() != running:
            raise ValueError(f"a chunk of {self.fields['WARC-Record-ID']} does not match its digest")

    def result(self) -> tuple:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to)."""
        name, kind = self.fields["WARC-Record-ID"][len("<urn:page:") : -1], self.fields["WARC-Type"]
        told, size = self.fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(self.http["Content-Length"])
        refers = self.fields.get("WARC-Refers-To")
        if self.left or (kind == "response" and (size != self.size or base32(self.digest.digest()) != told)):
            raise ValueError(f"the payload of {name} is not whole")
        return None if name.startswith("none") else int(name), size, told, kind, int(refers[len("<urn:page:") : -1]) if refers else None


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of record and chunk, to one row for each record."""
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    reader, record, n = Reader(), None, 0
    for batch in batches:
        out = []
        for no, chunk_no, last, data, running in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4)):
            if chunk_no != n or (n and no != record):
                raise ValueError(f"record {no if record is None or not n else record} lacks a chunk")
            reader.feed(data.as_py(), running.as_py())
            record, n = no, n + 1
            if last:
                out.append(reader.result())
                reader, n = Reader(), 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[x.split()[0] for x in _READ.split(", ")])
    if n:
        raise ValueError(f"record {record} lacks its last chunk")


def write_archive(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK) -> None:
    """Write one record per page: of equal payloads of at least ``least`` bytes the smallest page_id responds, others revisit it.

    Rows with that page_id all respond. A page without id is referred to by
    none; it revisits if a page with id has its payload. Null html is the
    empty payload, a null url is written as urn:none. Payloads are shuffled
    once, to meet the table of revisits, and cut into chunks before they reach
    Python; a revisit's payload is dropped there.
    """
    bounded(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    slim = rows.select("page_id", "digest", "size")
    first = slim.where("page_id is not null").groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = cut(first.where(F.col("size") >= least))
    again = lookup(slim.distinct(), first, ["digest", "size"], "n", how="inner").where("page_id is null or page_id <> first")
    again = again.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "first")
    joined = rows.join(again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    body = F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b""))
    chunks = F.when(F.col("first").isNull(), F.greatest(F.ceil(F.col("size") / chunk), F.lit(1))).otherwise(F.lit(1)).cast("int")
    numbered = joined.select("page_id", "url", "size", "digest", "first", body.alias("body"), chunks.alias("chunks"), F.monotonically_increasing_id().alias("no"))
    cells = numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("at"))
    part = F.substring("body", F.col("at") * chunk + 1, F.lit(chunk))
    cells = cells.select(F.col("no").alias("record_no"), F.col("at").alias("chunk_no"), (F.col("at") == F.col("chunks") - 1).alias("last"), part.alias("data"), "page_id", "url", "size", "digest", "first")
    cells.mapInArrow(_write, _TABLE).write.option("compression", "zstd").option("parquet.block.size", BLOCK).parquet(path)


def read_archive(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; each chunk is checked against its digest.

    Records of one chunk are read where they lie; only the chunks of longer
    ones are brought together, and then pass one by one. A record that lacks a
    chunk, or has a changed one, raises ValueError.
    """
    bounded(archive.sparkSession)
    columns = ["record_no", "chunk_no", "last", "data", "sha1"]
    lone = F.col("last") & (F.col("chunk_no") == 0)
    single = archive.where(lone).select(*columns).mapInArrow(_read, _READ)
    several = archive.where(~lone).repartition("record_no").sortWithinPartitions("record_no", "chunk_no").select(*columns).mapInArrow(_read, _READ)
    return single.unionByName(several)


def stream(rows: Iterable) -> Iterator[bytes]:
    """The bytes of a WARC file from chunk rows in order of record and chunk."""
    for row in rows:
        yield bytes(row.data)


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to an archive in the shared folder, read it back, and remove it."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4()}"
    write_archive(pages, path, least)
    found = cut(read_archive(spark.read.parquet(path)))
    remove(spark, path)
    return found
