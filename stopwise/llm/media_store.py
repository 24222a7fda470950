"""Media columns: content-addressed payloads in tar shards, with metadata by header-only range reads.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of an 8-bit gray
image 64 samples wide, stored losslessly as PNG under the payload's SHA-256. Tasks append to tar shards
in the shared folder and return rows (digest, shard, offset, length); bytes never pass a shuffle.
A shard holds a payload once, and of equal payloads in several shards one entry is the payload's
address, so a text that a third of all rows share is stored at most once a shard and read once.
Reads are dealt to tasks by ranges of (shard, offset) with some READ_BYTES behind each task's addresses.
``probe`` fills metadata columns from the first 33 bytes of each entry; ``features`` reads entries whole.

Shards are written under fresh names, so a retried task leaves an unused file behind and never
changes one that rows point to. Any file system that pyarrow can open by URI may hold them.

Edge cases: a null or empty text is 64 zero bytes (``n_bytes`` 0); repeated rows are answered each;
a null doc_id is a row like any other; an empty table gives an empty result; other columns are not read.
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
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.deploy import shared_dir, tidied
from stopwise.llm.common import discard, stash, table

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and IHDR chunk
SHARD_BYTES = 256 << 20
READ_BYTES = 32 << 20


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image written by ``to_png``; chunk checksums are verified."""
    width, height, _ = png_header(data[:HEADER])
    at, packed = len(SIGNATURE), []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


class Shard:
    """A tar file that is appended to."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.tar"
        fs, path = FileSystem.from_uri(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size, self.held = fs.open_output_stream(path), 0, {}

    def put(self, digest: bytes, payload: bytes) -> tuple[int, int]:
        """Offset and length of the stored form."""
        if digest not in self.held:
            data = to_png(payload)
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.held[digest] = (self.size + len(head), len(data))
            block = head + data + bytes(-len(data) % 512)
            self.out.write(block)
            self.size += len(block)
        return self.held[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def store(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all texts; returns doc_id, n_bytes, digest, shard, offset, length of every row."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        try:
            for batch in batches:
                rows = []
                for text in batch.column("text").fill_null("").cast(pa.binary()):
                    raw = text.as_py()
                    payload = payload_of(raw)
                    digest = hashlib.sha256(payload).digest()
                    if shard is not None and shard.size > SHARD_BYTES:
                        shard.close()
                        shard = None
                    shard = shard or Shard(folder)
                    rows.append((len(raw), digest, shard.uri, *shard.put(digest, payload)))
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            if shard is not None:
                shard.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(tidied(write), f"doc_id {kind}, n_bytes long, digest binary, shard string, offset long, length long")
    return stash(out, "media-rows")


def entries(rows: DataFrame) -> DataFrame:
    """One address for each digest: digest, shard, offset, length."""
    at = F.min(F.struct("shard", "offset", "length")).alias("at")
    return stash(rows.groupBy("digest").agg(at).select("digest", "at.shard", "at.offset", "at.length"), "media-entries")


def _read(found: DataFrame, size, schema: str, work) -> DataFrame:
    """Range-read ``size(length)`` bytes of each entry, shard by shard in order of offset; ``work`` makes columns of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if shard != uri:
                    if file is not None:
                        file.close()
                    fs, path = FileSystem.from_uri(shard)
                    uri, file = shard, fs.open_input_file(path)
                rows.append(work(file.read_at(size(length), offset)))
            new = pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.columns], [*batch.schema.names, *names])
        if file is not None:
            file.close()

    arrow = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    names, kinds = zip(*((n, arrow[k]) for n, k in (f.split() for f in schema.split(", "))))
    old = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    stored = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = found.repartitionByRange(max(1, -(-stored // READ_BYTES)), "shard", "offset")
    return dealt.sortWithinPartitions("shard", "offset").mapInArrow(tidied(read), f"{old}, {schema}")


def probe(found: DataFrame) -> DataFrame:
    """Adds width, height and bit_depth, from headers alone."""

    def work(head: bytes) -> dict:
        width, height, depth = png_header(head)
        return {"width": width, "height": height, "bit_depth": depth}

    return _read(found, lambda length: HEADER, "width int, height int, bit_depth int", work)


def feature_of(samples: np.ndarray) -> str:
    """Mean, spread, shares of 8 brightness bands and an 8 x 8 average hash."""
    bands = np.bincount(samples >> 5, minlength=8) * 255 // len(samples)
    image = samples.reshape(-1, WIDTH)
    edges = np.linspace(0, len(image), 9).astype(int)
    cells = np.array([[image[a : max(b, a + 1), c : c + 8].mean() for c in range(0, WIDTH, 8)] for a, b in zip(np.minimum(edges[:-1], len(image) - 1), edges[1:])])
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"mean={samples.mean():.4f};std={samples.std():.4f};bands={bytes(bands.astype(np.uint8)).hex()};hash={bits}"


def features(found: DataFrame) -> DataFrame:
    """Adds what whole reads give: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def work(data: bytes) -> dict:
        payload = from_png(data)
        return {
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-64:]),
            "media_bytes": len(data),
            "media_sha256": hashlib.sha256(data).hexdigest(),
            "feature": feature_of(np.frombuffer(payload, np.uint8)),
        }

    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _read(found, lambda length: length, schema, work)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, the columns of ``features`` and ``probe``, shard, offset, length."""
    rows = store(docs, folder)
    addresses = entries(rows)
    probed = stash(probe(addresses), "media-probed")
    found = stash(features(probed), "media-features")
    discard(addresses, probed)
    return rows.select("doc_id", "n_bytes", "digest").join(found, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height", "bit_depth", "shard", "offset", "length",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
