"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with spaces to rows of 192, are the samples of an 8-bit greyscale
PNG. Each task appends the distinct payloads of its rows to tar shards in the shared folder and
hands on digest, shard, offset and length. One place is kept for each digest. Header-only range
reads fill the metadata columns; payloads are read back by the same offsets.
"""

from __future__ import annotations

import hashlib
import math
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

from .common import materialise, shared_dir, text_bytes

WIDTH = 192
#: Bytes of PNG signature and IHDR chunk: all that a metadata read fetches.
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A task starts another shard beyond this size.
SHARD_BYTES = 256 << 20
#: Stored bytes that a task reads back, about.
READ_BYTES = 16 << 20

PLACES = "digest string, n_bytes long, shard string, offset long, length long"


def payload_of(text: bytes) -> bytes:
    """The text padded with spaces to a positive multiple of WIDTH."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    width, height, _ = png_header(media)
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation, mean step between neighbours, and the shares of eight brightness bands."""
    x = np.frombuffer(payload, dtype=np.uint8)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    bands = np.bincount(x >> 5, minlength=8) / len(x)
    return f"{x.mean():.4f}|{x.std():.4f}|{step:.4f}|" + ",".join(f"{b:.4f}" for b in bands)


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """One tar file. It is written under a passing name and renamed after its own content, so that
    a repeated or a second attempt of a task leaves the same file."""

    def __init__(self, folder: str):
        self.folder = folder
        self.fs, self.path = _filesystem(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.passing = f"{self.path}/.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.passing)
        self.at, self.name = 0, hashlib.sha256()
        self.places: dict[str, tuple[int, int]] = {}

    def add(self, digest: str, payload: bytes) -> tuple[int, int]:
        """Offset and length of the payload's media, which is written only once a shard."""
        if digest not in self.places:
            media = encode_png(payload)
            member = tarfile.TarInfo(f"{digest}.png")
            member.size = len(media)
            head = member.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + media + b"\0" * (-len(media) % 512))
            self.places[digest] = (self.at + len(head), len(media))
            self.at += len(head) + len(media) + -len(media) % 512
            self.name.update(digest.encode())
        return self.places[digest]

    def close(self) -> str:
        self.out.write(b"\0" * 1024)
        self.out.close()
        name = f"{self.name.hexdigest()[:40]}.tar"
        self.fs.move(self.passing, f"{self.path}/{name}")
        return f"{self.folder}/{name}"


def store_payloads(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text's media to tar shards under folder. One row a row of docs: id_col,
    digest (SHA-256 of the payload), n_bytes, shard, offset, length. Materialised at once, so that
    shards are written once and later failures only read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = None, ([], [], [], [], [])

        def shut() -> pa.RecordBatch:
            shard = writer.close()
            ids = pa.concat_arrays(rows[0]) if len(rows[0]) > 1 else rows[0][0]
            cols = [ids, pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array([shard] * len(rows[1]), pa.string()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())]
            for r in rows:
                r.clear()
            return pa.RecordBatch.from_arrays(cols, names=["id", "digest", "n_bytes", "shard", "offset", "length"])

        for batch in batches:
            writer = writer or ShardWriter(folder)
            for text in batch.column(1):
                text = text.as_py()
                payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                offset, length = writer.add(digest, payload)
                for r, v in zip(rows[1:], (digest, len(text), offset, length), strict=True):
                    r.append(v)
            rows[0].append(batch.column(0))
            if writer.at > SHARD_BYTES:
                yield shut()
                writer = None
        if writer:
            yield shut()

    placed = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("bytes")).mapInArrow(write, f"id {kind}, {PLACES}")
    return materialise(placed, "media-places")


class ShardReader:
    """Range reads; keeps the last shard open, for rows that come sorted by shard."""

    def __init__(self):
        self.shard, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            fs, path = _filesystem(shard)
            self.shard, self.file = shard, fs.open_input_file(path)
        return self.file.read_at(length, offset)


def header_columns(places: DataFrame) -> DataFrame:
    """Adds width int, height int and sample_bits int to rows with shard and offset; HEADER bytes
    are read for each."""
    schema = places.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader()
        for batch in batches:
            got = [png_header(reader.read(s, o, HEADER)) for s, o in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), strict=True)]
            cols = [pa.array([g[k] for g in got], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "width", "height", "sample_bits"])

    return places.mapInArrow(read, f"{schema}, width int, height int, sample_bits int")


def payload_features(places: DataFrame) -> DataFrame:
    """Adds, from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature."""
    schema = places.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    more = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def one(media: bytes) -> tuple:
        payload = decode_png(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader()
        for batch in batches:
            got = [one(reader.read(*at)) for at in zip(*(batch[c].to_pylist() for c in ("shard", "offset", "length")), strict=True)]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate(more.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *more])

    return places.mapInArrow(read, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """For every row of docs: id_col, n_bytes, digest, shard, offset, length, width, height,
    sample_bits, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Equal texts share one place. What is shuffled are places and digests, not texts; the join of
    rows to digests is one that Spark splits where a text has very many copies. A null text
    counts as empty (one row of spaces); null ids stay null; repeated rows each get a row; texts
    of any length are stored whole; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/logloom/media-{uuid.uuid4().hex}"
    placed = store_payloads(docs, folder, id_col, text_col)
    first = placed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    size = placed.agg(F.sum("length")).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / READ_BYTES))
    places = first.select("digest", "place.shard", "place.offset", "place.length").repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    found = payload_features(header_columns(places))
    return placed.select(F.col("id").alias(id_col), "n_bytes", "digest").join(found, "digest")
