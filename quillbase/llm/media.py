"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG, 64 samples a row, in a tar shard. Rows carry its
digest, the shard, the offset of the PNG in it and its length. Reading 33 bytes at the offset fills
the metadata columns; whole payloads are read back only for features. Each packing task stores a
payload once, and of tasks that met the same content the first shard by name is the one that rows refer to, so that
texts are never shuffled. Only finished tasks list their shards.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, SHARD = 64, 64 << 20
INDEX = "digest binary, n_bytes long, shard string, offset long, length long"
METADATA = INDEX + ", width long, height long, bit_depth int, payload_bytes long"
FEATURES = METADATA + ", payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"
#: Fixed value: the first bytes of a PNG.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """payload, a positive multiple of WIDTH bytes, as a grey PNG of one sample a byte."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with filter 0
    plain[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(plain, level)) + chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes of a grey PNG."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or struct.unpack(">I", data[29:33])[0] != zlib.crc32(data[12:29]):
        raise ValueError("not a PNG header")
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", data[16:29])
    if colour or depth != 8:
        raise ValueError("not 8-bit grey")
    return width, height, depth


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that to_png made."""
    width, height, _ = png_header(data)
    at, packed = 33, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(data[at + 4 : at + 8 + size]):
            raise ValueError("a damaged chunk")
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


class _Shards:
    def __init__(self, folder: str):
        self.fs, self.path = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.folder, self.out, self.rows = folder, None, []

    def add(self, digest: bytes, n_bytes: int, media: bytes) -> None:
        if self.out is None:
            name = f"{uuid.uuid4().hex}.tar"
            self.name, self.at = f"{self.folder}/{name}", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{name}", compression=None)
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.rows.append((digest, n_bytes, self.name, self.at + len(head), len(media)))
        whole = head + media + bytes(-len(media) % tarfile.BLOCKSIZE)
        self.out.write(whole)
        self.at += len(whole)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["digest", "n_bytes", "shard", "offset", "length"])
            self.out, self.rows = None, []


def pack(docs: DataFrame, text: str = "text", folder: str | None = None) -> DataFrame:
    """Stores each distinct text of docs, in UTF-8 and padded, and returns the index (stored): one row for each digest.

    digest is the SHA-256 of the unpadded bytes. A null text is stored as the empty one; an empty table has an empty index.
    """
    folder = folder or common.scratch(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _Shards(folder), set()
        for batch in batches:
            for value in batch.column(0):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                digest = hashlib.sha256(data).digest()
                if digest not in seen:
                    seen.add(digest)
                    shards.add(digest, len(data), to_png(padded(data)))
                    if shards.at >= SHARD:
                        yield from shards.close()
        yield from shards.close()

    made = common.stored(common.in_arrow(docs.select(F.col(text).cast("binary").alias("data")), run, INDEX), "media-made")
    first = made.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "n_bytes")).alias("x"))
    return common.stored(first.select("digest", "x.n_bytes", "x.shard", "x.offset", "x.length"), "media-index")


class _Reader:
    """Reads ranges of shards; the last shard stays open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            fs, path = pa.fs.FileSystem.from_uri(shard)
            self.name, self.file = shard, fs.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name = self.file = None


def _extended(index: DataFrame, schema: str, row, step: int = 500) -> DataFrame:
    """index with what row(reader, record) adds to each record."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                more = [row(reader, x) for x in batch.to_pylist()]
                columns = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int32() if n == "bit_depth" else pa.int64()) for c, n in zip(zip(*more, strict=True), names[batch.num_columns :], strict=True)] if more else []
                if more:
                    yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)
        reader.close()

    return common.in_arrow(index, run, schema)


def _metadata(reader: _Reader, x: dict) -> tuple:
    width, height, depth = png_header(reader.read(x["shard"], x["offset"], 33))
    return width, height, depth, width * height


def _features(reader: _Reader, x: dict) -> tuple:
    media = reader.read(x["shard"], x["offset"], x["length"])
    payload = from_png(media)
    if hashlib.sha256(memoryview(payload)[: x["n_bytes"]]).digest() != x["digest"] or len(payload) != x["payload_bytes"]:
        raise ValueError(f"{x['shard']}, {x['offset']}: not the content of its address")
    counts = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest(), "hist16:" + ",".join(map(str, counts.tolist()))


def metadata(index: DataFrame) -> DataFrame:
    """index with width, height, bit_depth and payload_bytes, from header-only range reads."""
    dealt = index.repartition(index.sparkSession.sparkContext.defaultParallelism * 2).sortWithinPartitions("shard", "offset")
    return _extended(dealt, METADATA, _metadata)


def features(described: DataFrame) -> DataFrame:
    """metadata()'s rows with digests of payload and stored form, the tail's CRC and a histogram of the samples, from whole reads.

    The content is held against its address.
    """
    return _extended(described, FEATURES, _features)


def media_columns(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str | None = None) -> DataFrame:
    """The kept columns of docs with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    and where the media lie: digest, shard, offset, width, height. Equal texts share all of these.

    A null text counts as empty. Rows stay as they are; kept columns that clash with the new ones are an error.
    """
    new = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "width", "height"]
    if clash := set(new) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are taken")
    found = features(metadata(pack(docs, text, folder))).withColumnRenamed("length", "media_bytes")
    rows = docs.select(*keep, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"))
    return rows.join(found, "digest").select(*keep, *new)
