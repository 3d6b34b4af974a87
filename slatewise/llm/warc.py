"""WARC archives as a table of chunks.

A payload never travels as one piece between Spark and Python: it is cut into rows of (record, chunk number,
bytes) next to the scan, written chunk by chunk into a gzip member, and read back as chunk rows that carry
the length and the digest so far.  Memory is one batch of chunks, whatever the size of a record.

Archives go to a folder that all executors share, through the file system its URI names.  A task writes
files of its own under new names and reports them at its end; only files reported by finished tasks are
read, so a lost or repeated task leaves nothing behind that counts.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.llm.common import checkpointed, scratch, small_batches, table, whole

CHUNK = 256 << 10
BATCH = 100  # chunk rows in an Arrow batch
ARCHIVE = 1 << 30  # a file is closed after this many compressed bytes
DATE = "2000-01-01T00:00:00Z"
GAP = b"\r\n\r\n"
FILES = "path string, records long, bytes long"


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                      revisit_from: int = 0) -> DataFrame:
    """(id, url, payload, size, sha1, type, refers): which record of equal payloads is written in full.

    Of equal payloads of at least ``revisit_from`` bytes the one with the smallest id is a response (so are
    rows that repeat that id), the others revisit it.  A null payload is empty, a null id comes after all ids.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), whole(payload_col).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.unhex(F.sha1("payload")))
    many = (rows.filter(F.col("size") >= revisit_from).groupBy("size", "sha1")
            .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
            .withColumn("shared", F.lit(True)))
    joined = rows.join(many, ["size", "sha1"], "left")
    again = F.coalesce("shared", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select("id", "url", "payload", "size", "sha1", F.when(again, "revisit").otherwise("response").alias("type"),
                         F.when(again, F.col("first")).alias("refers"))


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``records`` with the payload cut into rows (chunk, last, data); an empty payload is one empty chunk."""
    last = F.floor(F.greatest(F.octet_length("payload") - 1, F.lit(0)) / chunk)
    cut = records.withColumn("last", last).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    data = F.substring("payload", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk))
    return cut.withColumn("data", data).withColumn("last", F.col("chunk") == F.col("last")).drop("payload")


def _record_id(page) -> str:
    return f"<urn:x-page:{quote(str(page), safe='')}>"


def _head(row: dict) -> tuple[bytes, bytes]:
    """The WARC header and, for a response, the HTTP header that precedes the payload."""
    http = b""
    lines = ["WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Record-ID: {_record_id(row['id']) if row['id'] is not None else f'<urn:uuid:{uuid.uuid4()}>'}")
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['url'], safe='%/:?#[]@!$&()*+,;=~')}")
    digest = base64.b32encode(row["sha1"]).decode()
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {row['size']}"]
    if row["id"] is not None:
        lines.append(f"X-Page-Id: {quote(str(row['id']), safe='')}")
    if row["type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if row["refers"] is not None:
            lines += [f"WARC-Refers-To: {_record_id(row['refers'])}", f"X-Refers-To-Page: {quote(str(row['refers']), safe='')}"]
        length = 0
    else:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
        length = len(http) + row["size"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + GAP, http


def _write(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(folder)
    out, packer, done = None, None, []
    path, records, size = "", 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] == 0:
                if out is None:
                    path, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)  # a gzip member for each record
                head, http = _head(row)
                size += out.write(packer.compress(head + http))
            if row["type"] != "revisit":
                size += out.write(packer.compress(row["data"]))
            if row["last"]:
                size += out.write(packer.compress(GAP) + packer.flush())
                records += 1
                if size >= limit:
                    out.close()
                    done.append((path, records, size))
                    out = None
    if out is not None:
        out.close()
        done.append((path, records, size))
    for row in done:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["path", "records", "bytes"])


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK, limit: int = ARCHIVE) -> DataFrame:
    """Write ``records`` (as ``with_record_types`` gives them) under ``folder``; the files of finished tasks.

    The folder must be one that every executor can write to.  The list is computed here, once.
    """
    spark = records.sparkSession
    small_batches(spark, BATCH)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    whole_record = records.withColumn("payload", F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    return checkpointed(chunked(whole_record, chunk).mapInArrow(lambda b: _write(b, folder, limit), FILES))


class _Members:
    """The bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, raw, piece: int) -> None:
        self.raw, self.piece, self.held, self.buffer = raw, piece, b"", bytearray()
        self.unpacker = zlib.decompressobj(31)

    def fill(self) -> bool:
        """At most ``piece`` more bytes into the buffer; False at the end of the file."""
        while True:
            if self.unpacker.eof:
                self.held, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            if not self.held:
                self.held = self.raw.read(self.piece)
                if not self.held:
                    return False
            got = self.unpacker.decompress(self.held, self.piece)
            self.held = self.unpacker.unconsumed_tail if not self.unpacker.eof else b""
            if got:
                self.buffer += got
                return True

    def head(self) -> bytes | None:
        """Up to the next empty line, which is taken too; None at the end."""
        start = 0
        while (at := self.buffer.find(GAP, start)) < 0:
            start = max(0, len(self.buffer) - 3)
            if not self.fill():
                return None
        found = bytes(self.buffer[:at])
        del self.buffer[:at + len(GAP)]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """``n`` bytes in pieces."""
        while n:
            if not self.buffer and not self.fill():
                raise ValueError("a record ends before its length")
            part = bytes(self.buffer[:min(n, self.piece)])
            del self.buffer[:len(part)]
            n -= len(part)
            yield part


CHUNKS = T.StructType([
    T.StructField("page", T.StringType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("last", T.BooleanType()),
    T.StructField("bytes_so_far", T.LongType()), T.StructField("digest_so_far", T.StringType()), T.StructField("data", T.BinaryType())])


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _records(path: str, folder: str, chunk: int, with_data: bool) -> Iterator[tuple]:
    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(path, compression=None) as raw:
        members = _Members(raw, chunk)
        while (head := members.head()) is not None:
            f = _fields(head)
            told = f["WARC-Payload-Digest"].removeprefix("sha1:")
            start = (f.get("X-Page-Id"), f.get("WARC-Target-URI"), f["WARC-Type"], f.get("X-Refers-To-Page"))
            left = int(f["Content-Length"])
            if f["WARC-Type"] == "revisit":
                yield *start, 0, True, int(f["X-Payload-Bytes"]), told, None
            else:
                left -= len(members.head() or b"") + len(GAP)
                digest, so_far, number = hashlib.sha1(), 0, 0
                parts = members.take(left) if left else iter([b""])
                for part in parts:
                    digest.update(part)
                    so_far += len(part)
                    now = base64.b32encode(digest.digest()).decode()
                    if so_far == left and now != told:
                        raise ValueError(f"a payload in {path} differs from its digest")
                    yield *start, number, so_far == left, so_far, now, part if with_data else None
                    number += 1
            if members.head() != b"":
                raise ValueError(f"a record in {path} is longer than it says")


def _read(batches: Iterator[pa.RecordBatch], folder: str, chunk: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    names, rows = CHUNKS.fieldNames(), []
    types = [pa.string()] * 4 + [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            for row in _records(path, folder, chunk, with_data):
                rows.append(row)
                if len(rows) >= BATCH:
                    yield packed()
                    rows = []
    if rows:
        yield packed()


def read_chunks(files: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of archives: page, url, record_type, refers_to, chunk, last, bytes_so_far,
    digest_so_far, data.

    A revisit is one row with the length and digest of the payload it stands for.  A payload that does not
    match its digest is an error.
    """
    small_batches(files.sparkSession, BATCH)
    # as many parts as files: without a number, adaptive execution joins parts, as each holds a few names only
    spread = files.select("path").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(lambda b: _read(b, folder, chunk, with_data), CHUNKS)


def archive_and_read(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                     revisit_from: int = 0) -> DataFrame:
    """One row per page, from the archives: id, payload_bytes, payload_digest, record_type, refers_to.

    Nulls: a null payload is empty, a null url leaves its header out, a null id stays null.  Repeated rows
    are records each.  An empty table writes no file and gives no rows.
    """
    files = write_archives(with_record_types(pages, id_col, url_col, payload_col, revisit_from), folder)
    kind = pages.schema[id_col].dataType
    ends = read_chunks(files, folder, with_data=False).filter("last")
    read = lambda c: F.url_decode(c).cast(kind)
    return ends.select(read("page").alias(id_col), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"),
                       "record_type", read("refers_to").alias("refers_to"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_and_read(table(spark, folder, "pages"), scratch(spark, "warc"))
