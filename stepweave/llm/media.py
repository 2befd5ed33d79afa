"""Media columns: content-addressed payloads in tar shards, with digest, offset and length in the rows.

A text's bytes, padded with 255 to a positive multiple of 576, are stored as an 8-bit grey PNG (576 samples a line).
Every task appends its distinct payloads to tar shards of its own in the shared folder, a member named by the digest of
the payload; the committed index (a checkpoint) names the one place of each digest that all rows use, so a retried or
speculative task can only leave an unreferenced file behind. media_metadata() fills width, height and bits from range
reads of the PNG header alone, HEADER_BYTES of each payload; read_media() reads payloads whole, to check and describe them.

Defined results: null and empty texts both store one line of padding. Equal texts share digest, place and all values.
Repeated rows give repeated rows; other columns of the input are not read; an empty table gives an empty table.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import checkpoint, checkpoint_dir, documents, slices

LINE = 576
SHARD_BYTES = 256_000_000
HEADER_BYTES = 33
_MAGIC = b"\x89PNG\r\n\x1a\n"
PLACE = "digest string, shard string, offset long, length long"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(payload: bytes) -> bytes:
    """A grey 8-bit image, LINE samples wide, without line filters."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    body = np.zeros((len(lines), LINE + 1), np.uint8)
    body[:, 1:] = lines
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(raw: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER_BYTES bytes."""
    if raw[:8] != _MAGIC or raw[12:16] != b"IHDR" or struct.unpack(">I", raw[29:33])[0] != zlib.crc32(raw[12:29]):
        raise ValueError("not a PNG header")
    return (*struct.unpack(">II", raw[16:24]), raw[24])


def png_samples(raw: bytes) -> np.ndarray:
    """The samples of a whole image that png() wrote, checked chunk by chunk."""
    width, height, _ = png_header(raw)
    at, body = 33, b""
    while at < len(raw):
        n = struct.unpack(">I", raw[at : at + 4])[0]
        kind, part = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        if struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("damaged PNG chunk")
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read here")
    return np.ascontiguousarray(lines[:, 1:])


def feature(samples: np.ndarray) -> str:
    """Integer features of the stored samples: shape, sum, horizontal gradient and a histogram in eight bins."""
    wide = samples.astype(np.int64)
    bins = np.bincount(samples.ravel() >> 5, minlength=8)
    return f"{samples.shape[1]}x{samples.shape[0]};sum={wide.sum()};grad={np.abs(np.diff(wide, axis=1)).sum()};hist={','.join(map(str, bins))}"


class _Shards:
    """Tar shards that one task appends to; a new file after every SHARD_BYTES."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.out, self.name, self.at = None, "", 0

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        place = (self.name, self.at + len(head), len(data))
        self.at += len(head) + len(data) + -len(data) % 512
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def _writing(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, places = _Shards(folder), {}
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                payload = raw + b"\xff" * (-len(raw) % LINE if raw else LINE)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in places:
                    places[digest] = shards.add(digest, png(payload))
                rows.append((len(raw), digest, *places[digest]))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in columns]], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return run


def _heading(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset in zip(*[batch.column(c).to_pylist() for c in ("digest", "shard", "offset")], strict=True):
                if shard != name:
                    name, source = shard, store.open_input_file(f"{base}/{shard}")
                rows.append((digest, *png_header(source.read_at(HEADER_BYTES, offset))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["digest", "width", "height", "bits"])

    return run


def _reading(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*[batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")], strict=True):
                if shard != name:
                    name, source = shard, store.open_input_file(f"{base}/{shard}")
                raw = source.read_at(length, offset)
                samples = png_samples(raw)
                payload = samples.tobytes()
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return run


def _uri(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme; a path without one lies in the cluster's default file system, as it does for Spark."""
    if "://" in folder or folder.startswith("file:"):
        return folder
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"{default.rstrip('/')}{folder}" if not default.startswith("file:") else f"file://{folder}"


def store_media(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write the payloads; return doc_id, n_bytes, digest, shard, offset, length (one place for each digest), and the folder."""
    spark = docs.sparkSession
    folder = _uri(spark, folder or f"{checkpoint_dir(spark)}/media-{uuid.uuid4().hex}")
    index = checkpoint(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_writing(folder), "doc_id long, n_bytes long, " + PLACE))
    one = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")
    return index.select("doc_id", "n_bytes", "digest").join(one, "digest"), folder


def _once(places: DataFrame) -> DataFrame:
    """Each digest once, those of one stretch of a shard together and in its order."""
    stretch = F.floor(F.col("offset") / 8_000_000)
    return places.select("digest", "shard", "offset", "length").distinct().repartition("shard", stretch).sortWithinPartitions("shard", "offset")


def media_metadata(places: DataFrame, folder: str) -> DataFrame:
    """digest, width, height and bits by header-only range reads, once for each digest."""
    return _once(places).mapInArrow(_heading(folder), "digest string, width long, height long, bits long")


def read_media(places: DataFrame, folder: str) -> DataFrame:
    """Checks and features of the stored bytes, once for each digest."""
    return _once(places).mapInArrow(_reading(folder), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, folder = store_media(documents(spark, sf_dir))
    found = read_media(places, folder).join(media_metadata(places, folder), "digest")
    return places.join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bits")
