"""Best-fit packing into fixed-length sequences, hierarchical with residuals.

Documents are tokenised once, ended by id 0, and cut only where longer than a sequence. Pieces
shorter than a sequence are packed in rounds: every task packs its share best-fit decreasing,
nearly full bins are final, and all underfull bins go on as items to a round with an eighth of the
tasks, or with more where a task would else hold more than ``per_task`` bins. Items are dealt evenly, so that
each task has a fair sample of sizes and small items meet large ones. Rounds end with a single task or, where the
bins left are too many for one, when a round merged none of them. Bins carry their pieces, at most ``capacity`` of them, so no join is needed
to find a piece's place.

Tokenising (``tokens``): a task works on about 3 MB of text at a time, or on one longer text.

Edge cases: a null or empty text is the one id 0; repeated rows are packed each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.deploy import release, tidied
from stopwise.llm.common import stash, table
from stopwise.llm.tokens import default_vocabulary, ids_of, ranges, tokens, with_end

CAPACITY = 2048
SLICE = 3 << 20


def pieces_of(texts: list[bytes], path: str, capacity: int) -> tuple[np.ndarray, ...]:
    """For each piece: row, piece, start, length, crc32 of its ids."""
    own, size = with_end(*ids_of(texts, path), 0)
    cuts = -(-size // capacity)
    row = np.repeat(np.arange(len(texts)), cuts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start = piece * capacity
    length = np.minimum(size[row] - start, capacity)
    at = (np.cumsum(size) - size)[row] + start
    crc = np.array([zlib.crc32(own[a : a + k]) for a, k in zip(at.tolist(), length.tolist())], np.int64)
    return row, piece, start, length, crc


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every row."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.binary())
            held, size, first = [], 0, 0
            for i, t in enumerate(texts):
                held.append(t.as_py())
                size += len(held[-1])
                if size >= SLICE or i + 1 == len(texts):
                    row, piece, start, length, crc = pieces_of(held, path, capacity)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                        ["doc_id", "piece", "start", "length", "ids_crc32"],
                    )
                    held, size, first = [], 0, i + 1
                    release()
        tokens(path).rest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(used: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin. Open bins are kept by their room, and a bit mask tells which rooms occur."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-used, kind="stable").tolist():
        size = int(used[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            left = room - size
        else:
            b = len(bins)
            bins.append([i])
            left = capacity - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _merge(table_: pa.Table, capacity: int, full: int) -> pa.RecordBatch:
    """Pack the bins of a task into new ones; ``open``: whether a bin goes on to the next round."""
    used = table_.column("used").to_numpy().astype(np.int64)
    lists = table_.column("items").combine_chunks()
    offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values
    bins = best_fit(used, capacity)
    n = np.array([len(b) for b in bins])
    order = np.fromiter(chain.from_iterable(bins), np.int64, len(used))
    last = np.cumsum(n)
    filled = np.cumsum(used[order])
    base = filled - used[order] - np.repeat(np.concatenate(([0], filled[last[:-1] - 1])), n)
    size = np.diff(offsets)[order]
    values = values.take(pa.array(ranges(offsets[:-1][order], size)))
    names = [f.name for f in values.type]
    place = values.field("offset").to_numpy() + np.repeat(base, size)
    values = pa.StructArray.from_arrays([pa.array(place) if k == "offset" else values.field(k) for k in names], names)
    total = np.add.reduceat(used[order], last - n)
    ends = np.concatenate(([0], np.cumsum(size)[last - 1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(total), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values), pa.array(total < full)], ["used", "items", "open"]
    )


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = 50_000, slack: int = 8) -> DataFrame:
    """``items``: doc_id, piece, start, length, ids_crc32. Adds sequence_id and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    single = items.select(
        F.col("length").alias("used"),
        F.array(F.struct(*columns, F.lit(0).cast("long").alias("offset"))).alias("items"),
    )
    kind = single.schema["items"].dataType.simpleString()

    def round_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield _merge(pa.Table.from_batches(rows), capacity, capacity - slack)

    final = [single.where(F.col("used") >= capacity)]
    todo = single.where(F.col("used") < capacity)
    bins = todo.count()
    tasks = max(1, -(-bins // per_task))
    while True:
        done = stash(
            todo.select("used", "items").repartition(tasks).mapInArrow(tidied(round_of), f"used long, items {kind}, open boolean"), "packed"
        )
        final.append(done.where("NOT open"))
        todo = done.where("open")
        left, held = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
        if tasks == 1 or left == bins:
            final.append(todo)
            break
        bins, tasks = left, max(1, -(-tasks // 8), -(-left // per_task), -(-held // (8 * per_task)))
    every = final[0]
    for more in final[1:]:
        every = every.unionByName(more.select("used", "items"))
    return (
        every.withColumn("sequence_id", F.monotonically_increasing_id())
        .select("sequence_id", F.inline("items"))
        .select(*columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stash(pieces(docs, capacity, vocabulary), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
