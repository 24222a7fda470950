"""SimHash near-dedup with Golay-code fuzzy keys.

Fingerprints are 64-bit SimHashes of 4-word shingles. Two are linked if at most 4 bits differ. A
fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect
[23, 12, 7] Golay code with zeros in front. The fuzzy keys of a segment are the codewords that the
segment, or the segment with any one bit flipped, decodes to: one to six of them. If two segments
differ in at most two bits, a word between them is within one flip of both, so they share a key.

Pigeonhole over the segments, errors summing to at most 4:
* all three have at most two errors: they share a triple of fuzzy keys (family 0);
* one has three or four: of the other two one is equal and the other has at most one error, so
  they share an exact segment with a fuzzy key (one family for each ordered pair).
Candidates under a key are verified by XOR and bit count.

Scale: fingerprints are computed once and written out; from there on only distinct fingerprints
travel, so exact copies cost one row. Under one key a spanning set of links is emitted instead of
all pairs. Keys that a 1/64 sample of fingerprints shows to be crowded are cut into blocks of
about ``block`` fingerprints and every two blocks meet in a task of their own, so no task holds
an unbounded group and no link is lost. Components are found by star contraction.

Edge cases: a null or wordless text has fingerprint 0, linked like any other; fewer than 4 words
are one shingle; repeated rows are answered each; a null id never names a component unless all its
ids are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.deploy import tidied
from stopwise.llm.common import checked_broadcast, discard, split_crowded, stash, table
from stopwise.llm.graph import components

WIDTHS = (22, 21, 21)
SHIFTS = (42, 21, 0)
MOST_BITS = 4
#: Fingerprints whose keys one task makes.
PER_TASK = 10_000
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def simhash(words: list[bytes], size: int = 4) -> int:
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - size + 1)
    h = partial(xxhash.xxh64_intdigest, seed=42)
    last = ends[min(size, len(words)) - 1 :] - 1
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 100_000):
        a, b = starts[i : min(n, i + 100_000)].tolist(), last[i : min(n, i + 100_000)].tolist()
        hashes = np.fromiter((h(joined[x:y]) for x, y in zip(a, b)), np.uint64, len(a))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        found = np.fromiter((simhash((t.as_py() or b"").lower().split()) for t in texts), np.uint64, len(texts))
        columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "fp"])


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of all 23-bit words by their parts, and the error pattern of each remainder."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    units = np.array([remainder(1 << i) for i in range(23)], np.uint32)
    part = np.zeros((2, 4096), np.uint32)
    for half in range(2):
        for i in range(12 if half == 0 else 11):
            part[half][np.arange(4096) >> i & 1 == 1] ^= units[12 * half + i]
    pattern = np.zeros(2048, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            pattern[np.bitwise_xor.reduce(units[list(bits)])] = sum(1 << b for b in bits)
    return part, pattern


def decode(x: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    part, pattern = _golay()
    x = x.astype(np.uint32)
    return (x ^ pattern[part[0][x & 4095] ^ part[1][x >> 12]]) >> 11


def fuzzy(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (n, 7) and how many of a row count; a word has at most seven."""
    flips = np.concatenate(([0], 1 << np.arange(width))).astype(np.uint32)
    every = np.sort(decode(segment.astype(np.uint32)[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(every.shape, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    count = new.sum(axis=1)
    keys = np.zeros((len(every), int(count.max(initial=1))), np.int64)
    row, col = np.nonzero(new)
    keys[row, np.cumsum(new, axis=1)[row, col] - 1] = every[row, col]
    return keys, count


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, index of the fingerprint) of uint64 fingerprints."""
    segs = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]
    soft = [fuzzy(x, w) for x, w in zip(segs, WIDTHS)]
    valid = [np.arange(k.shape[1])[None, :] < n[:, None] for k, n in soft]
    triple = (soft[0][0] << 24)[:, :, None, None] | (soft[1][0] << 12)[:, None, :, None] | soft[2][0][:, None, None, :]
    use = valid[0][:, :, None, None] & valid[1][:, None, :, None] & valid[2][:, None, None, :]
    keys, who = [triple[use]], [np.nonzero(use)[0]]
    family = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                family += 1
                key = np.int64(family) << 40 | segs[i][:, None] << 12 | soft[j][0]
                keys.append(key[valid[j]])
                who.append(np.nonzero(valid[j])[0])
    return np.concatenate(keys), np.concatenate(who)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 2000):
            part = fp[i : i + 2000]
            key, who = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[who])], ["key", "fp"])


def spanning_links(fp: np.ndarray) -> np.ndarray:
    """Links (k, 2) that connect what links of at most MOST_BITS connect among distinct uint64s.

    A breadth-first search against those not yet reached: at most len(fp) - 1 links.
    """
    out, rest = [], fp
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= MOST_BITS
            if near.any():
                hit = rest[near]
                out.append(np.stack([np.full(len(hit), x), hit], axis=1))
                front.extend(hit)
                rest = rest[~near]
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of each run of equal keys in a partition sorted by key and block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(cut)
        found = [np.empty((0, 2), np.uint64)]
        two = cut[:-1][size == 2]
        pair = np.stack([fp[two], fp[two + 1]], axis=1)
        found.append(pair[np.bitwise_count(pair[:, 0] ^ pair[:, 1]) <= MOST_BITS])
        found += [spanning_links(fp[a : a + n]) for a, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist())]
        links = np.concatenate(found)
        links = np.unique(np.sort(links.view(np.int64), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 1]), pa.array(links[:, 0])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if cut:
            held.append((key[:cut], fp[:cut]))
            yield settle(*(np.concatenate(x) for x in zip(*held)))
            held = []
        held.append((key[cut:], fp[cut:]))
        if len(held) > 1 and held[0][0][0] != key[-1]:
            yield settle(*(np.concatenate(x) for x in zip(*held[:-1])))
            held = held[-1:]
    if held:
        yield settle(*(np.concatenate(x) for x in zip(*held)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp (the 64 bits as a signed long) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(tidied(_fingerprint), f"doc_id {kind}, text_key long, fp long")


def links_of(fps: DataFrame, block: int = 4096, share: int = 64) -> DataFrame:
    """``fps``: distinct fp. Links (a, b) that connect all fingerprints within MOST_BITS bits."""
    # a fingerprint gives some 180 keys: tasks follow the number of rows, not the size of their files
    fps = fps.select("fp").repartition(max(1, -(-fps.count() // PER_TASK)))
    keyed = fps.mapInArrow(tidied(_keys), "key long, fp long")
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("fp").mapInArrow(tidied(_keys), "key long, fp long")
    out = None
    for part in split_crowded(keyed, sample, "fp", block, share):
        links = part.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(tidied(_link), "a long, b long")
        out = links if out is None else out.unionByName(links)
    return out.distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, fp), and (fp, root) for every distinct fingerprint."""
    rows = stash(fingerprints(docs), "simhash-fp")
    nodes = stash(rows.select("fp").distinct(), "simhash-nodes")
    roots = components(links_of(nodes))
    return rows, nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_dups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    rows, named = classes(docs)
    named = stash(named.join(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp"), "simhash-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = stash(named.join(least, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, classes=classes) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each class of near copies that ``classes`` finds.

    The smallest doc_id stays, null coming last; of several rows with that id, one. Columns may have any names.
    """
    names = docs.columns
    held = docs.toDF(*[f"k{i}" for i in range(len(names))])
    doc, text = (f"k{names.index(c)}" for c in ("doc_id", "text"))
    rows, named = classes(docs.select("doc_id", "text"))
    named = stash(named, "simhash-roots")
    classed = rows.join(named, "fp").select("root", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key").alias("row"))
    classed = stash(classed.groupBy("root", "row").agg(F.count(F.lit(1)).alias("times")), "simhash-rows")
    first = classed.groupBy("root").agg(F.min("row").alias("first"), F.sum("times").alias("n")).where("n > 1").drop("n")
    first = stash(first, "simhash-first")
    beaten = classed.join(first, "root").where("row <> first OR times > 1")
    beaten = stash(beaten.select(F.col("row.doc_id").alias("d"), F.col("row.text_key").alias("t"), (F.col("row") == F.col("first")).alias("again")), "simhash-beaten")
    discard(named, classed, first)
    keyed = held.withColumn("key", F.xxhash64(text))

    def joined(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
        return df.join(other, F.col(doc).eqNullSafe(F.col("d")) & (F.col("key") == F.col("t")), how)

    kept = joined(keyed, checked_broadcast(beaten).select("d", "t"), "left_anti")
    again = beaten.where("again").select("d", "t")
    if not again.isEmpty():  # rows that occur several times and stay once
        kept = kept.unionByName(joined(keyed, again, "left_semi").dropDuplicates([doc, "key"]))
    return kept.drop("key").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"))
