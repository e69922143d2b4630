"""Media columns: payloads as images in tar shards, addressed by content.

A text becomes a payload (UTF-8, zero bytes up to a positive multiple of 64), the payload one row of 8-bit grey samples in a
PNG file. Writing tasks append the files to tar shards in shared storage and give each row its digest, shard, offset and length;
a task stores equal payloads once. Reading uses the first location of each digest: header range reads (33 bytes) fill the
metadata columns, whole ranges give the samples back. Payloads never go through a shuffle or the driver.

A shard is named anew by every attempt of a task and is only known through rows of attempts that ended well, so lost executors
leave at most files that no row names. Memory per task: one Arrow batch, the digests of the task's rows, one payload.
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
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmeter.llm.common import partitions, stored

UNIT = 64
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str) -> bytes:
    """UTF-8 bytes, then zero bytes up to a positive multiple of 64."""
    body = text.encode("utf-8", "surrogatepass")
    return body + b"\0" * (-len(body) % UNIT or (0 if body else UNIT))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, level: int = 6) -> bytes:
    """Grey 8-bit image of one row; the same samples always give the same file."""
    head = struct.pack(">IIBBBBB", len(samples), 1, 8, 0, 0, 0, 0)
    return SIGNATURE + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(b"\0" + samples, level)) + _part(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """width, height, bits, colour type from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != int.from_bytes(head[29:33], "big"):
        raise ValueError("no image header at this place")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of an image made by `to_png`; every part's checksum is verified."""
    width, height, bits, colour = png_header(data[:HEADER])
    at, packed = 8, []
    while at < len(data):
        size = int.from_bytes(data[at: at + 4], "big")
        kind, body = data[at + 4: at + 8], data[at + 8: at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size: at + 12 + size], "big"):
            raise ValueError("a part of an image is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = zlib.decompress(b"".join(packed))
    if (height, bits, colour) != (1, 8, 0) or len(rows) != width + 1 or rows[0]:
        raise ValueError("not one unfiltered row of grey samples")
    return rows[1:]


LOCATION = "key {kind}, n_bytes bigint, digest string, shard string, offset bigint, length bigint"


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", shard_bytes: int = 256 << 20) -> DataFrame:
    """key, n_bytes, digest (SHA-256 of the payload), shard, offset, length: where each row's image lies.

    Null text counts as empty; repeated rows and equal texts share a digest; an empty table writes nothing. `folder` is a URI on
    storage that all executors and later readers see. The frame is stored at once, since another run would write new shards.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, name, at, seen = None, "", 0, {}
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal out, at
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()
            out, at = None, 0
            cols = list(zip(*rows)) or [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "n_bytes", "digest", "shard", "offset", "length"])

        types: list[pa.DataType] = []
        for b in batches:
            types = types or [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                body = payload(t.as_py() or "")
                n = len((t.as_py() or "").encode("utf-8", "surrogatepass"))
                digest = hashlib.sha256(body).digest()
                if digest not in seen:
                    if out is None:
                        store.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.tar"
                        out = store.open_output_stream(f"{base}/{name}")
                    image = to_png(body)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(image)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT) + image + b"\0" * (-len(image) % 512))
                    seen[digest] = (name, at + 512, len(image))
                    at += 512 + len(image) + -len(image) % 512
                rows.append((k, n, digest.hex(), *seen[digest]))
            if at >= shard_bytes:
                yield close()
        if rows:
            yield close()

    made = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, LOCATION.format(kind=kind))
    return stored(made, "media-index").withColumnRenamed("key", key)


def objects(index: DataFrame) -> DataFrame:
    """One location per digest: digest, shard, offset, length. Partial minima are built before the shuffle."""
    first = F.min(F.struct("shard", "offset", "length")).alias("at")
    return index.groupBy("digest").agg(first).select("digest", "at.shard", "at.offset", "at.length")


def _ranges(frame: DataFrame, folder: str, columns: str, read) -> DataFrame:
    """Add columns computed from range reads; a task keeps one shard open at a time and reads it front to back. Rows stand for
    far more bytes than they hold, so they are dealt to a stated number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for b in batches:
            rows = []
            for shard, offset, length in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length"))):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, store.open_input_file(f"{base}/{shard}")
                rows.append(read(file, offset, length))
            new = [pa.array(c) for c in zip(*rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(c.split()[0] for c in columns.split(", "))])
        if file is not None:
            file.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{schema}, {columns}")


def spread(index: DataFrame) -> DataFrame:
    """Locations dealt by shard and position block, in order of position inside a task."""
    n = partitions(index.sparkSession)
    return index.repartition(n, "shard", (F.col("offset") / (8 << 20)).cast("long")).sortWithinPartitions("shard", "offset")


def fill_metadata(index: DataFrame, folder: str) -> DataFrame:
    """Add width, height, bits by reading the 33 header bytes of each image and nothing else."""

    def read(file, offset: int, length: int) -> tuple:
        file.seek(offset)
        return png_header(file.read(HEADER))[:3]

    return _ranges(index, folder, "width bigint, height bigint, bits bigint", read)


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """Add payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, from the stored bytes.

    The feature is the samples' mean, deviation and entropy in bits, then the shares of the 8 ranges of 32 sample values.
    """

    def read(file, offset: int, length: int) -> tuple:
        file.seek(offset)
        data = file.read(length)
        samples = from_png(data)
        counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
        share = counts / len(samples)
        level = np.arange(256)
        mean = float(share @ level)
        deviation = float(np.sqrt(max(0.0, share @ (level - mean) ** 2)))
        entropy = float(-(share[counts > 0] * np.log2(share[counts > 0])).sum())
        bands = counts.reshape(8, 32).sum(axis=1) / len(samples)
        feature = " ".join(f"{x:.6f}" for x in (mean, deviation, entropy, *bands))
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature

    return _ranges(index, folder, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", read)
