"""WARC archives as a chunked record table.

A record's payload travels as rows of record identifier and chunk number, at most
CHUNK bytes each. Writer and reader handle one chunk at a time and carry the digest along,
so neither holds a whole record. Archives are gzip members, one a record, in files that only a
finished task lists: a lost executor leaves files that no manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of payload in a row.
CHUNK = 256 * 1024
#: Compressed bytes of a stretch of a file that one reader takes, and of a file.
STRETCH, FILE = 4 << 20, 64 << 20
#: Header names and the profile of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "file string, start long, stop long, records long"
CHUNKS = T.StructType([T.StructField(n, t) for n, t in (("record_id", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("chunk_no", T.IntegerType()), ("is_last", T.BooleanType()), ("running_digest", T.StringType()), ("data", T.BinaryType()))])


def chunk_rows(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of pages (page_id, url, html): what write() takes.

    Among equal payloads of at least `least` bytes the row with the largest page_id is the response and others revisit
    it; rows that tie for the largest are all responses. A null html is an empty payload, a null page_id
    comes before all others, a group without any id is all responses. Extra columns are left out.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("n", F.octet_length("payload").cast("long"))
    narrow = pages.select("page_id", "url", F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).alias("n"))
    first = narrow.where(F.col("n") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("x")).select("digest", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url"))
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "sha1", "n", F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_to_url"), F.when(~revisit, F.col("payload")).otherwise(F.lit(b"")).alias("payload"))
    last = F.greatest(F.ceil(F.octet_length("payload") / chunk).cast("int"), F.lit(1)) - 1
    rows = rows.select("*", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return rows.select("page_id", "url", "sha1", "n", "refers_to", "refers_to_url", "chunk_no", (F.col("chunk_no") == F.col("last")).alias("is_last"), F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"))


def _digest(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _line(value: str | None) -> str:
    """A header's value: only line ends, which no header can hold, are percent-encoded."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def _record_id(page_id: int | None, sha1: str) -> str:
    """A record's name, by page and payload, so that revisits can name the response; rows that tie in both share it."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{sha1}')}>"


class _Archive:
    """Writes records to files of about FILE bytes and notes stretches of about STRETCH."""

    def __init__(self, folder: str, level: int):
        self.fs, path = pa.fs.FileSystem.from_uri(folder)
        self.folder, self.path = folder, path
        self.fs.create_dir(path, recursive=True)
        self.level, self.out, self.stretches = level, None, []

    def begin(self, head: str) -> None:
        if self.out is None:
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.name = f"{self.folder}/{name}"
            self.out, self.at, self.start, self.records = self.fs.open_output_stream(f"{self.path}/{name}", compression=None), 0, 0, 0
        self.gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.add(head.encode())

    def add(self, data: bytes) -> None:
        self.put(self.gz.compress(data))

    def put(self, packed: bytes) -> None:
        self.out.write(packed)
        self.at += len(packed)

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self.put(self.gz.flush())
        self.records += 1
        if self.at - self.start >= STRETCH:
            self.mark()
        if self.at >= FILE:
            self.close()

    def mark(self) -> None:
        if self.records:
            self.stretches.append((self.name, self.start, self.at, self.records))
        self.start, self.records = self.at, 0

    def close(self) -> None:
        if self.out is not None:
            self.mark()
            self.out.close()
            self.out = None


def write(chunks: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes the records of a chunk table, whose chunks of a record are adjacent and in order, to WARC files in folder.

    Returns the manifest (file, start, stop, records), stored: stretches of whole records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, sha = _Archive(folder, level), None
        for batch in batches:
            for page_id, url, sha1, n, refers, refers_url, no, last, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if no == 0:
                    http, sha, size = HTTP.format(n), hashlib.sha1(), n
                    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, sha1)), ("WARC-Date", DATE)]
                    if url is not None:
                        fields.append(("WARC-Target-URI", _line(url)))
                    if url is not None and _line(url) != url:
                        fields.append(("X-Page-URL", json.dumps(url)))
                    if refers is not None:
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers, sha1)), ("X-Refers-To-Page", str(refers))]
                    if refers_url is not None:
                        fields.append(("WARC-Refers-To-Target-URI", _line(refers_url)))
                    if page_id is not None:
                        fields.append(("X-Page-ID", str(page_id)))
                    body = len(http) + (n if refers is None else 0)
                    fields += [("WARC-Payload-Digest", f"sha1:{_digest(sha1)}"), ("X-Payload-Length", str(n)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(body))]
                    archive.begin(VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + http)
                sha.update(data)
                archive.add(data)
                size -= len(data)
                if last:
                    if refers is None and (size or sha.hexdigest() != sha1):
                        raise RuntimeError(f"page {page_id}: the chunks don't make up the payload")
                    archive.end()
        archive.close()
        if archive.stretches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*archive.stretches, strict=True)], names=["file", "start", "stop", "records"])

    return common.stored(common.in_arrow(chunks, run, MANIFEST), "warc-manifest")


def _records(stream, left: int, piece: int = 64 * 1024) -> Iterator[Iterator[bytes]]:
    """The gzip members of the next `left` bytes of a stream, each as an iterator over its plain bytes."""
    rest = b""
    while left or rest:

        def member() -> Iterator[bytes]:
            nonlocal left, rest
            gz = zlib.decompressobj(31)
            while not gz.eof:
                if not rest:
                    rest = stream.read(min(piece, left))
                    left -= len(rest)
                    if not rest:
                        raise EOFError("a record is cut off")
                data, rest = gz.decompress(rest, CHUNK), gz.unconsumed_tail
                if data:
                    yield data
            rest = gz.unused_data

        yield member()


def _parse(plain: Iterator[bytes], chunk: int) -> Iterator[tuple]:
    """The rows of one record; the digest runs along and is held against the header's at the end."""
    held = b""
    while (cut := held.find(b"\r\n\r\n")) < 0:
        held += next(plain)
    lines = held[:cut].decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    held = held[cut + 4 :]
    kind = head["WARC-Type"]
    while (cut := held.find(b"\r\n\r\n")) < 0:
        held += next(plain)
    left = int(head["Content-Length"]) - cut - 4
    held = held[cut + 4 :]
    number = lambda k: int(head[k]) if k in head else None
    url = json.loads(head["X-Page-URL"]) if "X-Page-URL" in head else head.get("WARC-Target-URI")
    row = (head["WARC-Record-ID"], number("X-Page-ID"), url, kind, number("X-Refers-To-Page"))
    stated, size, no, sha = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), 0, hashlib.sha1()
    while True:
        while len(held) < min(chunk, left):
            held += next(plain)
        data, held = held[: min(chunk, left)], held[min(chunk, left) :]
        left -= len(data)
        sha.update(data)
        running = base64.b32encode(sha.digest()).decode()
        if not left and kind == "response" and running != stated:
            raise ValueError(f"{row[0]}: the payload's digest is not the header's")
        yield (*row, size, stated, no, not left, running, data)
        no += 1
        if not left:
            break
    for more in plain:  # the end of the record
        held += more
    if held != b"\r\n\r\n":
        raise ValueError(f"{row[0]}: bytes follow the block")


def read(manifest: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in a manifest, a row for each chunk (one at least) of each record.

    running_digest is that of the payload as far as the chunk's end. Without data only each record's last row is given,
    after the same reading and checks. Rows leave in batches of about chunk bytes.
    """
    names = CHUNKS.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, held = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int32()), ("is_last", pa.bool_()), ("running_digest", pa.string()), ("data", pa.binary())]), [], 0
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for file, start, stop, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = pa.fs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as stream:
                    stream.seek(start)
                    seen = 0
                    for record in _records(stream, stop - start):
                        seen += 1
                        for row in _parse(record, chunk):
                            if with_data or row[names.index("is_last")]:
                                rows.append(row if with_data else (*row[:-1], None))
                                held += len(row[-1]) if with_data else 300
                            if held >= 4 * chunk:
                                yield flush(rows)
                                rows, held = [], 0
                    if seen != records:
                        raise ValueError(f"{file}: {seen} records where the manifest has {records}")
        if rows:
            yield flush(rows)

    return common.in_arrow(manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism)), run, CHUNKS)


def archived(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes pages as WARC and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Each row gives one record, repeated rows and null ids too (see chunk_rows); an empty table gives an empty one."""
    folder = folder or common.scratch(pages.sparkSession, "warc")
    back = read(write(chunk_rows(pages, least), folder), with_data=False)
    return back.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
