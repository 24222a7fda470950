"""Line dedup by a segment-partition edit join.

Two lines are linked if they are no more edits (insertions, deletions, substitutions of code points) apart than the shorter
of them allows: one for every ``per_edit`` characters, at most ``edits``. Linked lines, directly or through others, and equal
lines form a class, of which the corpus's first line, by doc_id and place, stays. Blank lines belong to none.

A line that allows k edits is cut into k + 1 even segments. Of two lines within k edits the
shorter has a segment that the longer holds unchanged, near its place. A line therefore has a key for
each of its own segments and for each of its substrings that could be a segment of a line at most
k characters shorter; which substrings is narrowed by the edits possible on either side of
a segment (for two edits 12 keys in all). Lines that share a key are verified by a banded
bit-parallel edit distance, after their common ends are cut off.

Scale: texts do not travel with keys. A key names a set of lines; equal sets are met once, and only
lines in sets of two or more have their text fetched. Under a set a spanning set of links is found
against lines not yet reached, not all pairs. Keys that a sample shows to be crowded, by lines or by their length,
are cut into blocks. Removed line numbers go back to the texts as one row a document. Equal lines are known by a
128-bit digest of their bytes (BLAKE2b); the rolling 64-bit hashes only bring lines together, and what they bring
together is compared as text.

Edge cases: a null or empty text has no lines to remove and stays as it is; blank lines (of the bytes that
part words) are never removed, whatever their length; rows with a null doc_id come last in the order; repeated rows are one
document and keep the same lines; an empty table gives an empty result; other columns are not read unless named in
``keep``, where names that the result has itself are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.deploy import tidied
from stopwise.llm.common import checked_broadcast, discard, split_crowded, stash, table
from stopwise.llm.graph import components

EDITS = 2
#: Characters for each edit that a line allows.
PER_EDIT = 10
U = np.uint64
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(32))


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(x: int, n: int) -> np.ndarray:
    """x ** 0 .. x ** (n - 1), kept for the next call unless they are many."""
    kept = _POWERS.get(x, ())
    if n > len(kept):
        out = np.full(max(n, SLICE), x, U)
        out[0] = 1
        kept = np.cumprod(out)
        if n <= 2 * SLICE:
            _POWERS[x] = kept
    return kept[:n]


_MIXED = mix(np.arange(1, 0x10001, dtype=U))


def coefficients(points: np.ndarray) -> np.ndarray:
    out = _MIXED[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        out[far] = mix(points[far].astype(U) + U(1))
    return out


class Lines:
    """Lines of several texts, of ``least`` characters and more and not blank, as code points, with hashes of any stretch of them."""

    def __init__(self, texts: list[str], least: int):
        self.whole = "\n".join([*texts, ""])
        points = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.flatnonzero(points == 10)
        begin = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
        ends_text = np.cumsum([len(t) + 1 for t in texts])
        row = np.searchsorted(ends_text, begin, "right")
        number = np.arange(len(begin)) - np.searchsorted(begin, (ends_text - [len(t) + 1 for t in texts])[row]) if len(begin) else begin
        words = np.concatenate(([0], np.cumsum((points != 32) & ((points < 9) | (points > 13)))))
        keep = (stops - begin >= least) & (words[stops] > words[begin])
        self.points, self.row, self.number, self.place = points, row[keep], number[keep], np.flatnonzero(keep)
        self.begin, self.size = begin[keep], (stops - begin)[keep]
        power, self.back = (powers(x, len(points) + 1) for x in (BASE, INVERSE))
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(coefficients(points) * power[:-1])))
        self.line = mix(self.hash(self.begin, self.size) + self.size.astype(U))

    def hash(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.back[at]

    def digests(self) -> list[bytes]:
        """Of every line."""
        data, stops = self._bytes()
        begin = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
        view = memoryview(data)
        spans = zip(begin[self.place].tolist(), stops[self.place].tolist())
        return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in spans]

    def every(self) -> pa.Array:
        """All lines as binary values, also those left out."""
        data, stops = self._bytes()
        ends = stops - np.arange(len(stops))  # without the line feeds
        offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(stops), [None, offsets, pa.py_buffer(data[data != 10])])

    def _bytes(self) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(self.whole.encode("utf-8", "surrogatepass"), np.uint8)
        return data, np.flatnonzero(data == 10)

    def once(self) -> dict[bytes, int]:
        """Digests of the lines, and of each the last line that has it."""
        return {d: i for i, d in enumerate(self.digests())}

    def keys(self, edits: int, per_edit: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, index of the line): own segments come up as substrings of a line as long as itself."""
        keys, who = [], []
        for shorter in range(edits + 1):
            allowed = np.minimum(edits, (self.size - shorter) // per_edit)
            for most in range(max(1, shorter), edits + 1):
                of = np.flatnonzero(allowed == most)
                n = self.size[of] - shorter
                short, rest = np.divmod(n, most + 1)
                for i in range(most + 1):  # the last ``rest`` segments are one longer
                    long_before = np.maximum(0, i - (most + 1 - rest))
                    at = i * short + long_before
                    width = short + (i >= most + 1 - rest)
                    for shift in range(max(-i, shorter - (most - i)), min(i, shorter + (most - i)) + 1):
                        start = at + shift
                        ok = (start >= 0) & (start + width <= self.size[of])
                        h = self.hash(self.begin[of[ok]] + start[ok], width[ok])
                        keys.append(mix(h + mix(n[ok].astype(U) * U(64) + U(i))))
                        who.append(of[ok])
        return np.concatenate(keys), np.concatenate(who)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about SLICE bytes at a time."""
    held, size, first = [], 0, 0
    for i, t in enumerate(batch.column("text")):
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= SLICE or i + 1 == batch.num_rows:
            yield first, held
            held, size, first = [], 0, i + 1


def keys_of(edits: int, per_edit: int, share: int = 0):
    """Rows (key, line) of texts; with ``share``, (key, line, bytes) of one distinct line in so many, chosen by its CRC."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch):
                if share:
                    texts = ["\n".join([x for x in t.split("\n") if zlib.crc32(x.encode()) % share == 0]) for t in texts]
                lines = Lines(texts, per_edit)
                first = np.fromiter(lines.once().values(), np.int64)
                lines.begin, lines.size, lines.line = lines.begin[first], lines.size[first], lines.line[first]
                key, who = lines.keys(edits, per_edit)
                got = [pa.array(key.view(np.int64)), pa.array(lines.line[who].view(np.int64))]
                if share:
                    got.append(pa.array(lines.size[who]))
                yield pa.RecordBatch.from_arrays(got, ["key", "line", "bytes"][: len(got)])

    return keys


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, line) rows to (set, line) of keys with at least two lines; equal sets have one name."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> pa.RecordBatch:
        key, line = (np.concatenate(x) for x in zip(*held))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        key, line = key[new], line[new]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(cut, len(key)))
        name = mix(np.add.reduceat(mix(line.view(U)), cut) + n.astype(U))
        several = np.repeat(n > 1, n)
        rows = np.unique(np.stack([np.repeat(name, n)[several].view(np.int64), line[several]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["set", "line"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, line = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "line"))
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if cut:
            held.append((key[:cut], line[:cut]))
            yield settle()
            held = []
        elif held and held[0][0][-1] != key[0]:
            yield settle()
            held = []
        held.append((key[cut:], line[cut:]))
    if held:
        yield settle()


def within(a: str, b: str, edits: int) -> bool:
    """Whether two strings are at most ``edits`` edits apart."""
    if abs(len(a) - len(b)) > edits:
        return False
    if len(a) > len(b):
        a, b = b, a
    a, b = _middle(a, b)
    if len(a) <= 2 * edits:
        return len(b) <= 3 * edits and _plain(a, b) <= edits
    # Column by column of b, bits stand for rows of a: the top one for row j + edits. The band reaches
    # below the last diagonal that matters, so that what is missing under it has no effect.
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    width = 3 * edits + 3
    under = width - 1 - edits
    mask, top = (1 << width) - 1, 1 << (width - 1)
    up, down, distance = mask & ~((1 << under) - 1), 0, edits
    row = top >> 1
    for j, c in enumerate(b):
        at = places.get(c, 0)
        same = (at >> (j - under) if j >= under else at << (under - j)) & mask
        zero = ((((same & up) + up) ^ up) | same | down) & mask
        more, less = (down | ~(zero | up)) & mask, zero & up
        if j < len(a) - edits:
            distance += not zero & top  # along the band's last diagonal
        else:
            distance += bool(more & row) - bool(less & row)  # along a's last row
            row >>= 1
        if j < len(a) - edits and distance > 2 * edits + len(b) - len(a):
            return False
        next_ = zero >> 1
        up, down = (less | ~(next_ | more)) & mask, next_ & more
    return distance <= edits


def _middle(a: str, b: str) -> tuple[str, str]:
    """``a`` and ``b`` without their common ends."""
    n = min(len(a), len(b))
    low, high = 0, n
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half - 1)
    a, b, n = a[low:], b[low:], n - low
    low, high = 0, n
    while low < high:
        half = (low + high + 1) // 2
        same = a[len(a) - half : len(a) - low] == b[len(b) - half : len(b) - low]
        low, high = (half, high) if same else (low, half - 1)
    return a[: len(a) - low], b[: len(b) - low]


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def sketch(text: str) -> int:
    """Parities of 64 classes of neighbouring characters; an edit changes at most four."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    if len(p) < 2:
        return 0
    return int(np.bitwise_xor.reduce(U(1) << (mix(p[1:] * U(0x110000) + p[:-1]) & U(63))))


def spanning_links(texts: list[str], edits: int, per_edit: int) -> list[tuple[int, int]]:
    """Links that connect what links within the edits allowed connect; breadth first, at most len(texts) - 1."""
    size = np.array([len(t) for t in texts])
    marks = np.array([sketch(t) for t in texts], U)
    rest, out = np.arange(len(texts)), []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            most = np.minimum(edits, np.minimum(size[rest], size[i]) // per_edit)
            near = (np.abs(size[rest] - size[i]) <= most) & (np.bitwise_count(marks[rest] ^ marks[i]) <= 4 * most)
            for k in np.flatnonzero(near):
                near[k] = within(texts[i], texts[rest[k]], int(most[k]))
            hit = rest[near].tolist()
            out += [(i, k) for k in hit]
            front += hit
            rest = rest[~near]
    return out


def links_of(edits: int, per_edit: int):
    """Rows (set, digest, text) sorted by set to verified links (a, b) of digests."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, texts = None, [], []

        def settle() -> pa.RecordBatch:
            found = spanning_links(texts, edits, per_edit)
            return pa.RecordBatch.from_arrays([pa.array([lines[f[side]] for f in found], pa.binary()) for side in (0, 1)], ["a", "b"])

        for batch in batches:
            for name, line, text in zip(*(batch.column(c).to_pylist() for c in ("set", "digest", "text"))):
                if name != now:
                    if len(texts) > 1:
                        yield settle()
                    now, lines, texts = name, [], []
                lines.append(line)
                texts.append(text)
        if len(texts) > 1:
            yield settle()

    return links


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line but blank ones: its digest, doc_id, text_key and number in the document."""
    for batch in batches:
        for first, texts in _slices(batch):
            lines = Lines(texts, 1)
            row = pa.array(first + lines.row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines.digests(), pa.binary()), batch.column("doc_id").take(row), batch.column("text_key").take(row), pa.array(lines.number.astype(np.int32))],
                ["digest", "doc_id", "text_key", "number"],
            )


def texts_of(least: int):
    """(line, digest, text), once for each slice."""

    def texts_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch):
                lines = Lines(texts, least)
                once = lines.once()
                at = np.fromiter(once.values(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines.line[at].view(np.int64)), pa.array(list(once), pa.binary()), lines.every().take(pa.array(lines.place[at])).cast(pa.string())], ["line", "digest", "text"]
                )

    return texts_


def line_links(docs: DataFrame, edits: int, per_edit: int, block: int = 4096, share: int = 64) -> DataFrame:
    """Links (a, b) of line digests that connect all lines within the edits they allow."""
    text = docs.select("text")
    keyed = text.mapInArrow(tidied(keys_of(edits, per_edit)), "key long, line long")
    sample = text.mapInArrow(tidied(keys_of(edits, per_edit, share)), "key long, line long, bytes long").distinct()
    parts = split_crowded(keyed, sample, "line", block, share)
    sets = None
    for part in parts:
        got = part.repartition("key").sortWithinPartitions("key", "line").mapInArrow(tidied(sets_of), "set long, line long")
        sets = got if sets is None else sets.unionByName(got)
    sets = stash(sets.distinct(), "line-sets")
    wanted = checked_broadcast(stash(sets.select("line").distinct(), "lines-wanted"))
    texts = text.mapInArrow(tidied(texts_of(per_edit)), "line long, digest binary, text string").join(wanted, "line", "left_semi")
    texts = texts.groupBy("line", "digest").agg(F.min("text").alias("text"))
    links = (
        sets.join(texts, "line")
        .select("set", "digest", "text")
        .repartition("set")
        .sortWithinPartitions("set", "digest")
        .mapInArrow(tidied(links_of(edits, per_edit)), "a binary, b binary")
        .distinct()
    )
    links = stash(links, "line-links")
    discard(sets)
    return links


def removed_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """``docs``: doc_id, text, text_key. Returns doc_id, text_key, removed (line numbers) where there are any; a table in files."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    links = line_links(docs, edits, per_edit)
    roots = components(links)
    discard(links)
    placed = stash(docs.mapInArrow(tidied(places), f"digest binary, doc_id {kind}, text_key long, number int"), "line-places")
    classed = placed.join(checked_broadcast(roots), placed.digest == roots.node, "left").select(
        F.coalesce("root", "digest").alias("class"),
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "number").alias("place"),
    )
    first = stash(
        classed.groupBy("class").agg(F.min("place").alias("first"), F.max("place").alias("final")).where("first <> final").drop("final"),
        "line-firsts",
    )
    gone = classed.join(first, "class").where("place <> first").select("place.*").distinct()
    gone = stash(gone.groupBy("doc_id", "text_key").agg(F.collect_list("number").alias("removed")), "lines-removed")
    discard(roots, placed, first)
    return gone


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``text`` without its removed lines, and numbers of lines before and removed."""
    for batch in batches:
        texts, counts, gone = [], [], []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            lines = (text or "").split("\n")
            drop = set(removed or ())
            counts.append(len(lines))
            gone.append(len(drop))
            texts.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text)
        at = batch.schema.get_field_index("text")
        columns = [c for i, c in enumerate(batch.columns) if i != at and batch.schema.names[i] != "removed"]
        names = [n for n in batch.schema.names if n not in ("text", "removed")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*names, "text", "n_lines", "n_removed"]
        )


def line_dedup(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the columns ``keep``, text (what stays), n_lines, n_removed."""
    names = [c for c in dict.fromkeys(keep) if c not in ("doc_id", "text", "n_lines", "n_removed")]
    rows = docs.select("doc_id", "text", *[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.xxhash64("text").alias("text_key"))
    gone = checked_broadcast(removed_lines(rows.select("doc_id", "text", "text_key"), edits, per_edit))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "removed")
    # text_key decides with doc_id, which may be null
    wide = rows.join(gone, rows.doc_id.eqNullSafe(gone.d) & (rows.text_key == gone.t), "left").drop("d", "t", "text_key")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in wide.schema if f.name not in ("text", "removed")]
    out = wide.mapInArrow(tidied(cut), ", ".join([*fields, "text string", "n_lines long", "n_removed long"]))
    return out.select("doc_id", *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "text", "n_lines", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
