"""Substring dedup by recompression: repeats of ``window`` words and more are removed.

Rounds of recompression rename each document's words: maximal runs of a symbol, then pairs whose
left symbol lies in one half of the alphabet and whose right one lies in the other. A name is a
64-bit hash of what it stands for and the halves are a bit of a hash of the name, so that all
tasks name alike without a shuffle for each round, and equal substrings get equal symbols wherever
these depend on nothing outside. Each symbol carries its extent, the words that decide it.

Every window picks an anchor among the symbols whose extent it holds: of the highest level found,
the one with the least hash, the leftmost of equals. The choice depends on the window's words
alone, so two equal windows pick equal anchors at equal offsets: symbols bring candidates together. Consecutive
windows of a document with one anchor form a stretch. What is removed goes by the words themselves: stretches and windows are
equal if the 128-bit digests (BLAKE2b) of their words' bytes are, so that no clash of names can remove text.

1. Per anchor: number, least and greatest stretch name (map-side combined). Anchors met once end here.
2. Per (anchor, stretch): the smallest document. All windows of a stretch are repeats in each
   later document that has it.
3. First stretches of an anchor with several stretches are compared window by window.

Only step 3 handles single windows, and only around the edges of repeats, so that a passage or a
group of copies with a third of all rows costs one row a stretch. Ranges go back to the texts in
one join by document.

Edge cases: a null or wordless text has no words and its digest is that of the empty text; texts
with fewer than ``window`` words keep all; repeats within a document, or between rows of one
doc_id, are kept; a null doc_id is never removed from nor counted as earlier; repeated rows are
judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.deploy import tidied
from stopwise.llm.common import discard, stash, table

WINDOW = 50
ROUNDS = 3
U = np.uint64
#: Bytes of text handled at once in a task; a longer text is handled alone.
SLICE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(32))


def join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(a * U(0xA0761D6478BD642F) + mix(b + U(salt)))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def bounds_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word of the documents in ``data`` (ending at ``ends``), and which bytes are in words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    in_word = ~_SPACE[data]
    first, last = in_word.copy(), in_word.copy()
    first[1:] &= ~in_word[:-1]
    last[:-1] &= ~in_word[1:]
    begins = np.concatenate(([0], ends[:-1]))
    inner = begins[(begins > 0) & (begins < len(data))]
    first[inner], last[inner - 1] = in_word[inner], in_word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1, in_word


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the documents in ``data`` (ending at ``ends``), and words per document."""
    import xxhash

    begins = np.concatenate(([0], ends[:-1]))
    s, e, _ = bounds_of(data, ends)
    n = e - s
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
    h = n.astype(U) * U(0x9FB21C651E98DF25)
    todo = np.arange(len(s))
    for at in range(0, 256, 8):
        todo = todo[n[todo] > at]
        if not len(todo):
            break
        part = eight[s[todo] + at] & masks[np.minimum(n[todo] - at, 8)]
        h[todo] = mix(h[todo] * U(0xA0761D6478BD642F) + part)
    for i in np.flatnonzero(n > 256):
        h[i] = xxhash.xxh64_intdigest(data[s[i] : e[i]], 1)
    return h, np.searchsorted(s, ends) - np.searchsorted(s, begins)


class Joined:
    """The words of documents, each followed by one space."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        s, e, in_word = bounds_of(data, ends)
        n = e - s
        self.start = np.concatenate(([0], np.cumsum(n + 1)))
        text = np.full(self.start[-1], 32, np.uint8)
        text[np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)] = data[in_word]
        self.view = memoryview(text)

    def digests(self, first: np.ndarray, n: np.ndarray, lead: np.ndarray) -> list[bytes]:
        """Of the ``n`` words from ``first`` on, and of a number ``lead``."""
        a, b = self.start[first].tolist(), self.start[first + n].tolist()
        return [hashlib.blake2b(self.view[x:y], digest_size=16, salt=b"%d" % k).digest() for x, y, k in zip(a, b, lead.tolist())]


def recompress(name, lo, hi, start, doc, edge, level):
    """One round on symbols with extents [lo, hi): runs, then pairs. ``edge``: (begin, end) words of each document."""
    # Runs. That a run is maximal shows in its neighbours; at a document's edge, beyond the document.
    same = np.zeros(len(name), bool)
    same[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    at = np.flatnonzero(~same)
    size = np.diff(np.append(at, len(name)))
    begin, end = edge[0][doc[at]], edge[1][doc[at]]
    left, right = at - 1, at + size
    new_lo = np.where((left >= 0) & (doc[left] == doc[at]), lo[left], begin - 1)
    inside = right < len(name)
    near = np.minimum(right, len(name) - 1)
    new_hi = np.where(inside & (doc[near] == doc[at]), hi[near], end + 1)
    named = join(name[at], size.astype(U), 2 * level + 1)
    name, lo, hi, start, doc = np.where(size > 1, named, name[at]), new_lo, new_hi, start[at], doc[at]
    # Pairs of a left-half symbol and a right-half one.
    right_half = (mix(name + U(0x5851F42D4C957F2D * level & 0xFFFFFFFFFFFFFFFF)) & U(1)).astype(bool)
    pair = np.zeros(len(name), bool)
    pair[:-1] = ~right_half[:-1] & right_half[1:] & (doc[:-1] == doc[1:])
    second = np.zeros(len(name), bool)
    second[1:] = pair[:-1]
    at = np.flatnonzero(~second)
    paired = pair[at]
    nxt, prv = np.minimum(at + 1, len(name) - 1), np.maximum(at - 1, 0)
    begin, end = edge[0][doc[at]], edge[1][doc[at]]
    after = np.where((at + 1 < len(name)) & (doc[nxt] == doc[at]), hi[nxt], end + 1)
    before = np.where((at > 0) & (doc[prv] == doc[at]), lo[prv], begin - 1)
    # A symbol left alone shows that its neighbour is in the wrong half.
    alone_right = right_half[at] & ~paired
    new_lo = np.where(alone_right, before, lo[at])
    new_hi = np.where(alone_right, hi[at], after)
    return np.where(paired, join(name[at], name[nxt], 2 * level + 2), name[at]), new_lo, new_hi, start[at], doc[at]


def least_in(order: np.ndarray, i0: np.ndarray, i1: np.ndarray) -> np.ndarray:
    """Position of the leftmost least of order[i0:i1], by a sparse table."""
    longest = int((i1 - i0).max())
    tables = [np.arange(len(order))]
    while 2 << (len(tables) - 1) <= longest:
        a, step = tables[-1], 1 << (len(tables) - 1)
        b = a[np.minimum(np.arange(len(a)) + step, len(a) - 1)]
        tables.append(np.where(order[b] < order[a], b, a))
    k = np.frexp((i1 - i0).astype(np.float64))[1] - 1
    stacked = np.stack(tables)
    a, b = stacked[k, i0], stacked[k, i1 - (1 << k)]
    return np.where(order[b] < order[a], b, a)


def windows(word: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, and for each the word where its anchor begins and the anchor's hash."""
    end = np.cumsum(count)
    begin = end - count
    doc = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(word))
    starts = pos[pos + window <= end[doc]] if len(word) else pos
    anchor, spot = np.zeros(len(starts), U), np.zeros(len(starts), np.int64)
    if not len(starts):
        return starts, spot, anchor
    levels = [(word, pos, pos + 1, pos, doc)]
    for level in range(1, ROUNDS + 1):
        levels.append(recompress(*levels[-1], (begin, end), level))
    open_ = np.arange(len(starts))
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(word + U(77)))))  # an extent's words, order told by the symbols
    for name, lo, hi, start, _ in reversed(levels):
        i0 = np.searchsorted(lo, starts[open_], "left")
        i1 = np.searchsorted(hi, starts[open_] + window, "right")
        has = i1 > i0
        if has.any():
            order = mix(name ^ U(0xC2B2AE3D27D4EB4F))
            pick = least_in(order, i0[has], i1[has])
            who = open_[has]
            spot[who] = start[pick]
            anchor[who] = join(name[pick], total[hi[pick]] - total[lo[pick]], 3)
            open_ = open_[~has]
        if not len(open_):
            break
    return starts, spot, anchor


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, document ends) of about SLICE bytes of a batch's texts at a time; nulls are empty."""
    texts = batch.column(column).fill_null("").cast(pa.binary())
    sizes = np.array([len(x) for x in (t.as_buffer() for t in texts)], np.int64)
    row = 0
    while row < len(sizes):
        upto = max(row + 1, int(np.searchsorted(np.cumsum(sizes[row:]), SLICE, "right")) + row)
        data = np.frombuffer(b"".join(t.as_buffer() for t in texts[row:upto]), np.uint8)
        yield row, data, np.cumsum(sizes[row:upto])
        row = upto


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, digest, doc_id, text_key, first and last window (word numbers within the document)."""
    for batch in batches:
        for row, data, ends in slices(batch):
            word, count = words_of(data, ends)
            starts, spot, anchor = windows(word, count, WINDOW)
            if not len(starts):
                continue
            end = np.cumsum(count)
            doc = np.searchsorted(end, starts, "right")
            cut = np.ones(len(starts), bool)
            cut[1:] = (spot[1:] != spot[:-1]) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(cut)
            n = np.diff(np.append(at, len(starts)))
            # where the anchor lies in the stretch belongs to its digest
            digest = Joined(data, ends).digests(starts[at], n + WINDOW - 1, spot[at] - starts[at])
            first = starts[at] - (end - count)[doc[at]]
            rows = pa.array(row + doc[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[at].view(np.int64)), pa.array(digest, pa.binary()), batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(first.astype(np.int32)), pa.array((first + n - 1).astype(np.int32))],
                ["anchor", "digest", "doc_id", "text_key", "first", "last"],
            )


def _ranges(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows in the lists of row ``i``."""
    structs = column[i].values
    if structs is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(structs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))


def expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers in the ranges [first, last]."""
    n = last - first + 1
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows with ``ranges``: the digest of each window in them, doc_id, text_key, window."""
    for batch in batches:
        for row, data, ends in slices(batch):
            words = bounds_of(data, ends)[0]
            begin = np.searchsorted(words, np.concatenate(([0], ends[:-1])))
            at, who = [], []
            for i in range(len(ends)):
                first, last = _ranges(batch.column("ranges"), row + i)
                got = expand(first, last)
                at.append(got + begin[i])
                who.append(np.full(len(got), row + i))
            at, who = np.concatenate(at), pa.array(np.concatenate(who))
            if len(at):
                digest = Joined(data, ends).digests(at, np.full(len(at), WINDOW), np.zeros(len(at), np.int64))
                local = (at - begin[np.asarray(who) - row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.binary()), batch.column("doc_id").take(who), batch.column("text_key").take(who), pa.array(local)],
                    ["digest", "doc_id", "text_key", "first"],
                )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed, kept (the kept words joined by spaces)."""
    for batch in batches:
        counts, gone, kept = [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            words = (text.as_py() or b"").split()
            first, last = _ranges(batch.column("ranges"), i)
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, first, 1)
            np.add.at(drop, last + WINDOW, -1)
            stay = np.cumsum(drop[:-1]) == 0
            counts.append(len(words))
            gone.append(len(words) - int(stay.sum()))
            kept.append(b" ".join(words if stay.all() else [w for w, s in zip(words, stay.tolist()) if s]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        sha = [hashlib.sha256(t.as_buffer()).hexdigest() for t in batch.column("kept").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, text, text_key. Returns doc_id, text_key, first, last: windows that repeat an earlier document's."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.where("doc_id IS NOT NULL")
    parts = stash(
        known.mapInArrow(tidied(_stretches), f"anchor long, digest binary, doc_id {kind}, text_key long, first int, last int"), "stretches"
    )
    shared = (
        parts.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), (F.min("digest") != F.max("digest")).alias("mixed"))
        .where("n > 1")
        .drop("n")
    )
    # Aggregates are written before they are joined: a join of two plain shuffles can split a crowded key.
    # Each table goes when the next has been written, which holds disk to about twice the input.
    shared = stash(shared, "anchors-shared")
    met = stash(parts.join(shared, "anchor"), "stretches-met")
    discard(parts, shared)
    first_doc = stash(met.groupBy("anchor", "digest").agg(F.min("doc_id").alias("first_doc")), "stretches-first")
    judged = stash(met.join(first_doc, ["anchor", "digest"]).select("doc_id", "text_key", "first", "last", "mixed", "first_doc"), "stretches-judged")
    discard(met, first_doc)
    later = judged.where("doc_id > first_doc").select("doc_id", "text_key", "first", "last")
    open_ = (
        judged.where("doc_id = first_doc AND mixed")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    )
    singles = stash(
        known.join(open_, ["doc_id", "text_key"])
        .select("doc_id", "text_key", "text", "ranges")
        .mapInArrow(tidied(_window_hashes), f"digest binary, doc_id {kind}, text_key long, first int"),
        "windows",
    )
    least = singles.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    least = stash(least.drop("last_doc"), "windows-repeated")
    single = singles.join(least, "digest").where("doc_id > first_doc").select("doc_id", "text_key", "first", F.col("first").alias("last"))
    single = stash(single, "windows-later")
    discard(singles, least)
    return later.unionByName(single)


def with_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, ranges (null where nothing repeats) for every row."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = repeated_ranges(rows).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return rows.join(found, ["doc_id", "text_key"], "left").select("doc_id", "text", "ranges")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the kept words joined by one space)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_ranges(docs).mapInArrow(tidied(_cut), f"doc_id {kind}, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_ranges(docs).mapInArrow(tidied(_digest), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, row_number() OVER () AS rid FROM documents
), x AS (
  SELECT rid, doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50
), h AS (
  SELECT rid, doc_id, p, hash(array_to_string(w[p:p + 49], ' ')) AS h FROM x
), m AS (
  SELECT rid, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS f FROM h) WHERE doc_id > f
), g AS (
  SELECT DISTINCT rid, unnest(range(p, p + 50)) AS i FROM m
), c AS (
  SELECT rid, list(i) AS gone FROM g GROUP BY rid
), k AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END AS kept
  FROM d LEFT JOIN c USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
