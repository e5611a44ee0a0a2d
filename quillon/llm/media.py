"""Media columns: content-addressed payloads in tar shards.

A payload (bytes, padded with zeros to a multiple of 64) is stored as a greyscale PNG of 64 samples a row, under its digest, in a tar shard in the
shared folder. Each task writes shards of its own and stores a payload once; where several tasks stored the same one, all rows point to the copy
with the smallest address. Rows carry digest, shard, offset and length. Metadata columns come from the first 33 bytes at the offset; contents are
read by range. Shards are named by a random number for each attempt of a task, so a task that is run again leaves the rows of others alone, and
rows are written before any shard is read.
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
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _text
from quillon.runtime import fresh_path, materialize, ship

WIDTH = 64
SHARD = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk: all that the metadata columns need.
HEADER = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(raw: bytes) -> bytes:
    """raw and zeros up to a positive multiple of 64."""
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def encode(payload: bytes) -> bytes:
    """Payload (a multiple of 64 bytes) as an 8-bit greyscale PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def metadata(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    return struct.unpack(">IIB", head[16:25])


def decode(stored: bytes) -> bytes:
    """The payload of encode()."""
    width, height, _ = metadata(stored)
    at, data = HEADER, []
    while at < len(stored):
        n = struct.unpack(">I", stored[at : at + 4])[0]
        kind, body, crc = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n], struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]
        if zlib.crc32(kind + body) != crc:
            raise ValueError("stored payload is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Samples' mean and entropy, and 64 bits: whether each of 64 equal stretches is lighter than all together."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    light = np.add.reduceat(x.astype(np.int64), np.arange(64) * (len(x) // 64)) / np.diff(np.append(np.arange(64) * (len(x) // 64), len(x))) > x.mean()
    return f"mean={x.mean():.4f};entropy={entropy:.4f};hash={np.packbits(light).tobytes().hex()}"


class Shards:
    """Tar files of one task; each is closed when it is full."""

    def __init__(self, folder: str, limit: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.limit, self.out, self.name, self.size = limit, None, "", 0

    def put(self, digest: str, data: bytes) -> tuple[str, int]:
        if self.out is None:
            self.name, self.size = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.PAX_FORMAT)
        at = self.size + len(head)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        self.size = at + len(data) + (-len(data) % 512)
        name = self.name
        if self.size >= self.limit:
            self.close()
        return name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


ROW = "doc_id long, n_bytes long, digest string, shard string, at long, length long"


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD) -> DataFrame:
    """docs (doc_id, text) -> a row each with n_bytes, digest, shard, at and length of its stored payload."""

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = Shards(folder, shard_bytes), {}
        try:
            for b in batches:
                data, at = _text.buffers(b.column(1))
                rows = []
                for i in range(b.num_rows):
                    raw = data[at[i] : at[i + 1]].tobytes()
                    payload = padded(raw)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        stored = encode(payload)
                        if len(known) > 1_000_000:  # what a task remembers is bounded; a payload may then be stored again
                            known.clear()
                        known[digest] = (*shards.put(digest, stored), len(stored))
                    rows.append((len(raw), digest, *known[digest]))
                n, digest, shard, offset, length = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "at", "length"])
        finally:
            shards.close()

    return docs.mapInArrow(run, ROW)


def _ranges(batches: Iterator[pa.RecordBatch], folder: str, size) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the bytes at its addresses; size(length) of them. A shard stays open while its rows last."""
    fs, root = pafs.FileSystem.from_uri(folder)
    name, source = None, None
    for b in batches:
        got = []
        for shard, at, length in zip(*(b.column(c).to_pylist() for c in ("shard", "at", "length"))):
            if shard != name:
                if source is not None:
                    source.close()
                name, source = shard, fs.open_input_file(f"{root}/{shard}")
            got.append(source.read_at(size(length), at))
        yield b, got
    if source is not None:
        source.close()


def with_metadata(stored: DataFrame, folder: str) -> DataFrame:
    """stored (digest, shard, at, length) with width, height and bits, read from headers only."""

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, heads in _ranges(batches, folder, lambda length: min(HEADER, length)):
            w, h, bits = zip(*map(metadata, heads)) if heads else [()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(bits, pa.int32())], [*b.schema.names, "width", "height", "bits"])

    return stored.mapInArrow(run, "digest string, shard string, at long, length long, width int, height int, bits int")


READ = "digest string, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def with_contents(stored: DataFrame, folder: str) -> DataFrame:
    """with_metadata() and what is computed from the stored bytes, read back by range."""

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _ranges(batches, folder, lambda length: length):
            rows = []
            for media in found:
                payload = decode(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            n, sha, crc, size, media_sha, text = zip(*rows) if rows else [()] * 6
            columns = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(media_sha, pa.string()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("digest", "width", "height")), *columns], ["digest", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return with_metadata(stored, folder).mapInArrow(run, READ)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shard_bytes: int = SHARD) -> DataFrame:
    """For every row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height.

    The payload is the text in UTF-8 (null and empty: 64 zeros), padded with zeros. Rows with equal texts have equal values. Null ids and repeated
    rows are rows like others; other columns are ignored. folder: where shards go, by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "media")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(store(docs, folder, shard_bytes), "stored")
    once = rows.groupBy("digest").agg(F.min(F.struct("shard", "at", "length")).alias("where")).select("digest", "where.*")
    once = materialize(once, "once")
    read = with_contents(once.repartition("shard").sortWithinPartitions("shard", "at"), folder)
    found = rows.select("doc_id", "n_bytes", "digest").join(materialize(read, "read"), "digest")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op6_media(spark: SparkSession, sf: str) -> DataFrame:
    return media(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
