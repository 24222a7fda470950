"""Token ids in binary files: bit or byte planes of fixed-size blocks, each plane compressed with Zstandard.

Every text is encoded and closed by an end id. Documents are dealt to shards by ranges of doc_id (nulls first; of equal doc_ids in the order of a hash of
their ids, so that equal ids alone are interchangeable), each task writes its shard in that order, and a document's place in the corpus is its
place in the shard behind the ids of all shards before it. Rows are dealt by (doc_id, hash, row number), so that one doc_id may
hold any share of the rows.

A file, all numbers little-endian: 8 bytes of MAGIC; the planes of block after block; an Arrow stream of the documents (doc_id, n_tokens);
the chunk index, a row of INDEX and one length a plane for each block; the trailer. A block is ``block`` ids of 32 bits, transposed into 4 byte
planes or 32 bit planes; planes of nothing but zeros take no bytes. Blocks cut documents anywhere; with the index a reader fetches
the blocks of a range of ids and nothing else.

Shards are written under fresh names, so a retried task leaves an unused file behind and never changes one that rows point to.
Any file system that pyarrow can open by URI may hold them.

Edge cases: a null or empty text is the end id alone; repeated rows are answered each; a null doc_id is a row like any other; an empty table
gives an empty result and no file; other columns are not read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.deploy import release, shared_dir, tidied
from stopwise.llm.common import discard, stash, table
from stopwise.llm.tokens import default_vocabulary, ids_of, tokens, with_end

END = 1
BLOCK = 1 << 17
MAGIC = b"IDPLANE1"
INDEX = np.dtype([("offset", "<u8"), ("first", "<u8"), ("count", "<u4")])
#: Documents' place, index's place, number of ids, blocks, ids a block, planes; then MAGIC.
TRAILER = struct.Struct("<QQQIII8s")
#: Of ids (4 bytes each) and documents in a shard, about.
SHARD_BYTES = 256 << 20
SHARD_DOCS = 1 << 20
SLICE = 3 << 20
LEVEL = 3


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """4 byte planes or 32 bit planes of 32-bit ids; a plane of zeros is empty."""
    if planes == 4:
        parts = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        return [p.tobytes() if p.any() else b"" for p in parts]
    top = int(ids.max(initial=0)).bit_length()
    return [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes() if b < top else b"" for b in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, part in enumerate(parts):
        if part:
            held = np.frombuffer(part, np.uint8)
            held = held if len(parts) == 4 else np.unpackbits(held, count=n)
            out |= held.astype(np.uint32) << np.uint32(k * 32 // len(parts))
    return out


class Writer:
    """A file of ids to which documents are appended."""

    def __init__(self, folder: str, block: int = BLOCK, planes: int = 4):
        import zstandard

        self.uri = f"{folder}/{uuid.uuid4().hex}.ids"
        fs, path = FileSystem.from_uri(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.block, self.planes = fs.open_output_stream(path), block, planes
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.index, self.lengths, self.docs = [], [], []
        self.out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, counts))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for a in range(0, whole, self.block):
                self._write(ids[a : a + self.block])
            self.held, self.waiting = [ids[whole:].copy()], len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        parts = [self.pack(p) if p else b"" for p in to_planes(ids, self.planes)]
        self.index.append((self.at, self.ids, len(ids)))
        self.lengths.append([len(p) for p in parts])
        self.out.write(b"".join(parts))
        self.at += sum(self.lengths[-1])
        self.ids += len(ids)

    def close(self) -> None:
        if self.waiting:
            self._write(np.concatenate(self.held))
        held = io.BytesIO()
        schema = pa.schema([("doc_id", self.docs[0][0].type), ("n_tokens", pa.int64())])
        with pa.ipc.new_stream(held, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            for doc_ids, counts in self.docs:
                stream.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(counts.astype(np.int64))], schema=schema))
        index = np.array(self.index, INDEX).tobytes() + np.array(self.lengths, "<u4").tobytes()
        self.out.write(held.getvalue() + index)
        docs_at, index_at = self.at, self.at + len(held.getvalue())
        self.out.write(TRAILER.pack(docs_at, index_at, self.ids, len(self.index), self.block, self.planes, MAGIC))
        self.out.close()


class Reader:
    """Documents of a file, and its ids by range."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        docs_at, index_at, self.ids, blocks, self.block, self.planes, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"not a file of ids: {uri}")
        index = self.file.read_at(size - TRAILER.size - index_at, index_at)
        self.index = np.frombuffer(index, INDEX, blocks)
        self.lengths = np.frombuffer(index, "<u4", offset=INDEX.itemsize * blocks).reshape(blocks, self.planes)
        self.docs_at, self.docs_size = docs_at, index_at - docs_at

    def documents(self) -> Iterator[pa.RecordBatch]:
        """doc_id, n_tokens in order, in batches."""
        return iter(pa.ipc.open_stream(self.file.read_at(self.docs_size, self.docs_at)))

    def _block(self, k: int) -> np.ndarray:
        at, n, size = int(self.index["offset"][k]), int(self.index["count"][k]), self.lengths[k].tolist()
        data, parts, place = self.file.read_at(sum(size), at), [], 0
        for s in size:
            parts.append(self.unpack(data[place : place + s]) if s else b"")
            place += s
        return from_planes(parts, n)

    def blocks(self) -> Iterator[np.ndarray]:
        return map(self._block, range(len(self.index)))

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; only their blocks are read."""
        if not 0 <= start <= stop <= self.ids:
            raise ValueError(f"ids {start} to {stop} of {self.ids}")
        if start == stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        return np.concatenate([self._block(k) for k in range(first, last + 1)])[start - first * self.block : stop - first * self.block]

    def close(self) -> None:
        self.file.close()


@cache
def _size(path: str) -> int:
    return tokens(path).encoder.get_vocab_size(with_added_tokens=True)


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, ids: binary, 2 bytes an id where the vocabulary allows it, else 4."""
    kind = "<u2" if max(_size(path), end + 1) <= 1 << 16 else "<u4"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, first = [], 0, 0
            for i, text in enumerate(batch.column("text").fill_null("").cast(pa.binary())):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= SLICE or i + 1 == batch.num_rows:
                    ids, n = with_end(*ids_of(held, path), end)
                    ends = np.concatenate(([0], np.cumsum(n))) * int(kind[-1])
                    column = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(n)), column.cast(pa.binary())], ["doc_id", "ids"])
                    held, size, first = [], 0, i + 1
                    release()
        tokens(path).rest()

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(work), f"doc_id {key}, ids binary")


def write(docs: DataFrame, path: str | None = None, end: int = END, folder: str | None = None, block: int = BLOCK, planes: int = 4, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write all documents: shard (in order), uri, ids, docs of each file."""
    path = path or default_vocabulary()
    folder = folder or f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    width = 2 if max(_size(path), end + 1) <= 1 << 16 else 4
    rows = stash(encoded(docs, path, end), "ids-rows")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("ids").cast("long")), F.lit(0))).first()
    shards = max(1, -(-size * 4 // width // shard_bytes), -(-n // SHARD_DOCS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = None
        for batch in batches:
            if batch.num_rows:
                file = file or Writer(folder, block, planes)
                column = batch.column("ids").cast(pa.large_binary())
                ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                ids = np.frombuffer(column.buffers()[2], f"<u{width}", (ends[-1] - ends[0]) // width, ends[0])
                file.add(batch.column("doc_id"), np.diff(ends) // width, ids.astype(np.uint32))
        if file is not None:
            file.close()
            shard = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": file.uri, "ids": file.ids, "docs": sum(len(d) for d, _ in file.docs)}])

    order = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("row")]
    dealt = rows.withColumns({"h": F.xxhash64("ids"), "row": F.monotonically_increasing_id()}).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    out = stash(dealt.select("doc_id", "ids").mapInArrow(tidied(work), "shard long, uri string, ids long, docs long"), "ids-files")
    discard(rows)
    return out


#: Files whose sizes are added up in one window.
GROUP = 4096


def placed(files: DataFrame) -> DataFrame:
    """Adds before: the ids of all files before each one. Sums run over groups of files, and over the groups."""
    before = lambda by: F.coalesce(F.expr(f"sum(ids) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    part = F.floor(F.col("shard") / GROUP)
    groups = files.groupBy(part.alias("part")).agg(F.sum("ids").alias("ids")).select(F.col("part").alias("g"), before("ORDER BY part").alias("base"))
    own = files.withColumn("part", part).withColumn("own", before("PARTITION BY part ORDER BY shard"))
    return own.join(groups, F.col("part") == F.col("g")).withColumn("before", F.col("own") + F.col("base")).select(*files.columns, "before")


def documents(files: DataFrame, kind: str = "bigint") -> DataFrame:
    """doc_id (of type ``kind``), start, n_tokens, ids_crc32 of every document, read back from the files of ``write``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist()):
                file = Reader(uri)
                blocks, held = file.blocks(), np.empty(0, np.uint32)
                for docs in file.documents():
                    counts, crc = docs.column("n_tokens").to_numpy(), []
                    for n in counts.tolist():
                        if len(held) < n:
                            parts, have = [held], len(held)
                            while have < n:
                                parts.append(next(blocks))
                                have += len(parts[-1])
                            held = np.concatenate(parts)
                        crc.append(zlib.crc32(held[:n]))
                        held = held[n:]
                    ends = start + np.cumsum(counts)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start = int(ends[-1]) if len(ends) else start
                file.close()

    n = max(1, files.count())
    return placed(files).select("uri", "before").repartition(n).mapInArrow(tidied(work), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return documents(write(docs), docs.schema["doc_id"].dataType.simpleString())
