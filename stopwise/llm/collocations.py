"""Collocations: phrases of 2 to 5 words that are commoner than their parts would have it, counted by an FM-index for each shard.

A shard is what a task has read of one language, about SHARD_BYTES of text: words as numbers, 0 between pieces. Its index is
the Burrows-Wheeler transform of its words in reverse order, sorted by DEPTH words. A phrase is an interval of the index: what stands in it are
the words that follow the phrase (its extensions to the right), and LF steps from there lead to the intervals of the extended
phrases; all phrases of a shard take their step at once. The interval of a phrase lies inside that of the phrase without its first word, so extensions to
the left need no second index: a step that does not end inside a known phrase extends one to the left that is too rare, and is left out.

Words are counted first; each shard gets those that are frequent over all shards, and all others are gaps to it. A shard then extends all
its phrases up to the longest, whatever their counts, and names each window once: the longest phrase that begins at a word, with how often it
does. There is at most one for each word of the text, so that these rows follow the input and not the number of
frequent phrases. Windows are sorted over all shards, by ranges. There a phrase is a run of windows that begin with it; a
task tells those that are frequent from one pass over its range. Of the runs that a range's ends may have cut it passes on parts, at most two for each length,
which are summed afterwards; no word or phrase has to fit into one task.

Counts of a phrase's parts come along with it: of its beginnings from what it extends, of its ends from the phrase that its left extension started from.
Scores are whole numbers, computed in decimals of 38 digits.

Shards and indexes are written under fresh names, so a retried task leaves an unused file behind and never changes one that
rows point to. Any file system that pyarrow can open by URI may hold them.

Edge cases: a null or empty text has no words; a null lang is ``und``, together with rows that say so; repeated rows count each;
an empty table gives an empty result; a piece of any length is never cut, a text longer than a shard is cut between pieces; other columns
are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.deploy import free_heaps, hadoop_path, release, shared_dir, tidied
from stopwise.llm.common import checked_broadcast, discard, stash, table
from stopwise.llm.tokens import ranges

# Fixed values of the query.
MIN_COUNT, LONGEST, TOP, INSIDE = 100, 5, 2000, 100
SHARD_BYTES = 16 << 20
#: Of texts that a task holds back, of all languages.
WAITING_BYTES = 48 << 20
#: Words by which the index is sorted; more than a phrase has.
DEPTH = 6

_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def numbers(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """A text as numbers, 0 between pieces and k + 1 for word k, and its words."""
    raw = np.frombuffer(b"\n" + data + b"\n", np.uint8)
    kind = _KIND[raw]
    on = kind == 0
    starts = np.flatnonzero(on & ~np.concatenate(([False], on[:-1])))
    letters = _LOWER[raw[on]]
    begins = np.flatnonzero(np.concatenate(([False], ~on[:-1]))[on])
    offsets = np.append(begins, len(letters)).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    place = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=-1) > 0)  # a gap before each piece
    out = np.zeros(int(place[-1]) + 2 if len(place) else 1, np.int32)
    out[place] = column.indices.to_numpy() + 1
    return out, column.dictionary


def put(folder: str, *arrays: np.ndarray) -> str:
    import zstandard

    uri = f"{folder}/{uuid.uuid4().hex}.words"
    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    held = io.BytesIO()
    for a in arrays:
        np.save(held, a, allow_pickle=False)
    with fs.open_output_stream(path) as out:
        out.write(zstandard.ZstdCompressor(level=1).compress(held.getbuffer()))
    return uri


def get(uri: str, n: int) -> list[np.ndarray]:
    import zstandard

    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        held = io.BytesIO(zstandard.ZstdDecompressor().decompress(file.read()))
    return [np.load(held, allow_pickle=False) for _ in range(n)]


def pieces_of(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of about ``most`` bytes, cut between pieces."""
    import re

    at, cut = 0, re.compile(rb"[.,;:!?\x0A-\x0D]")
    while len(text) - at > most and (found := cut.search(text, at + most)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def shards(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, lang, uri, words, counts: each shard's file of numbers, its distinct words and how often it has them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        made = 0

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            found, words = numbers(b"\n".join(held.pop(lang)))
            size.pop(lang)
            counts = np.bincount(found, minlength=len(words) + 1)[1:]
            row = {"shard": TaskContext.get().partitionId() << 24 | made, "lang": lang, "uri": put(folder, found)}
            made += 1
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), v) for v in (words.cast(pa.string()), pa.array(counts.astype(np.int32)))]
            release()
            return pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), *(pa.array([row[c]]) for c in ("lang", "uri")), *lists], ["shard", "lang", "uri", "words", "counts"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                if not text.is_valid:
                    continue
                lang = "und" if lang is None else lang
                for part in pieces_of(text.as_py(), shard_bytes):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part) + 1
                    if size[lang] >= shard_bytes:
                        yield flush(lang)
                    elif sum(size.values()) >= WAITING_BYTES:
                        yield flush(max(size, key=size.get))
        while size:
            yield flush(next(iter(size)))

    return docs.select("lang", "text").mapInArrow(tidied(work), "shard long, lang string, uri string, words array<string>, counts array<int>")


class Index:
    """The transform of a shard: ``bwt`` (the word after each context) and ``lf`` (where the context with that word stands)."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        self.lf = np.empty(len(bwt), np.int32)
        self.lf[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)

    @classmethod
    def of(cls, words: np.ndarray, depth: int = DEPTH) -> Index:
        """``words``: symbols with 0 for gaps, the last of them a gap."""
        t = words[::-1]
        n, bits = len(t), max(int(t.max(initial=0)).bit_length(), 1)
        have = max(1, min(62 // bits, depth))
        wide = np.concatenate((t.astype(np.int64), np.zeros(depth, np.int64)))
        key = wide[:n].copy()
        for k in range(1, have):  # as many words as fit into a number
            key = key << bits | wide[k : k + n]
        order = np.argsort(key)
        while have < depth:
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = np.zeros(n + have, np.int64)
            rank[order] = new + 1
            key = rank[:n] << 32 | rank[have : have + n]
            order = np.argsort(key)
            have *= 2
        kind = np.uint16 if bits <= 16 else np.uint32
        return cls(t[order - 1].astype(kind))

    def extended(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """One word to the right of phrases of one length: at, count, phrase (its place in ``at``) and symbol of each extension.

        Extensions whose words but the first are not among the phrases are left out.
        """
        known = np.zeros(len(self.bwt), bool)
        place = ranges(at, count)
        known[place] = True
        symbol, to = self.bwt[place], self.lf[place]
        keep = (symbol > 0) & known[to]
        parent, here = np.full(len(self.bwt), -1, np.int32), np.zeros(len(self.bwt), self.bwt.dtype)
        parent[to[keep]] = np.repeat(np.arange(len(at), dtype=np.int32), count)[keep]
        here[to[keep]] = symbol[keep]
        found = np.flatnonzero(parent >= 0)
        parent, here = parent[found], here[found]
        first = np.flatnonzero(np.concatenate(([True], (parent[1:] != parent[:-1]) | (here[1:] != here[:-1])))) if len(found) else np.empty(0, int)
        return found[first], np.diff(np.append(first, len(found))), parent[first], here[first]


#: Parts of a phrase: its last word, the phrase before that, and in the lower half of ``place`` its number. Rows with a uri name files and are passed on.
STEP = "shard long, place long, p long, w long, uri string"
#: Of a part; a larger number is given by several.
MOST = (1 << 32) - 1
#: Windows that a task sorts, about.
RANGE_ROWS = 1 << 20
#: Windows that a shard gives at a time.
BATCH_ROWS = 1 << 16


class Keys:
    """Phrases as numbers that sort like their words: ``bits`` for each word's id + 1, 0 where there is none, as many words as fit into 63 bits."""

    def __init__(self, words: int, longest: int):
        self.bits = max(1, int(words).bit_length())
        self.per = 63 // self.bits
        self.longest = longest
        self.columns = [f"k{i}" for i in range(-(-longest // self.per))]

    def put(self, ident: np.ndarray, k: int) -> tuple[int, np.ndarray]:
        """The column that has word ``k`` (from 0), and what the word adds to it."""
        return k // self.per, (ident.astype(np.int64) + 1) << self.bits * (self.per - 1 - k % self.per)

    def words(self, columns: list[np.ndarray]) -> np.ndarray:
        """A row of ids + 1 for each place of a word."""
        return np.stack([columns[k // self.per] >> self.bits * (self.per - 1 - k % self.per) & (1 << self.bits) - 1 for k in range(self.longest)])


def windows(index: Index, ident: np.ndarray, keys: Keys) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The longest phrases that begin at words of a shard, those of two words or more, and how often they are the longest."""
    n = np.bincount(index.bwt, minlength=len(ident) + 1)
    at, count = np.cumsum(n)[:-1], n[1:]
    columns = [np.zeros(len(at), np.int64) for _ in keys.columns]
    columns[0] += keys.put(ident, 0)[1]
    for k in range(1, keys.longest):
        longer, number, parent, symbol = index.extended(at, count)
        if k > 1:
            rest = count - np.bincount(parent, number, len(at)).astype(np.int64)
            some = rest > 0
            yield [c[some] for c in columns], rest[some]
        columns = [c[parent] for c in columns]
        where, more = keys.put(ident[symbol.astype(np.int64) - 1], k)
        columns[where] += more
        at, count = longer, number
    yield columns, count


def runs(batches: Iterator[tuple[list[np.ndarray], np.ndarray]], keys: Keys, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases (ids, a row each) and their numbers, from windows in order: those that are frequent, and of each length the first and the last."""
    lengths = range(2, keys.longest + 1)
    last, open_, inner = None, dict.fromkeys(lengths, 0), dict.fromkeys(lengths, False)
    for columns, n in batches:
        if not len(n):
            continue
        words = keys.words(columns)
        new = words != np.concatenate((words[:, :1] if last is None else last, words[:, :-1]), axis=1)
        new = np.logical_or.accumulate(new)
        upto = np.concatenate(([0], np.cumsum(n)))
        for k in lengths:
            starts = np.flatnonzero(new[k - 1])
            if not len(starts):
                open_[k] += int(upto[-1])
                continue
            ends = open_[k] + int(upto[starts[0]])
            before = words[:k, starts[0] - 1] if starts[0] else last[:k, 0]
            if before[-1] and (ends >= least or not inner[k]):
                yield before[None] - 1, np.array([ends])
            inner[k], open_[k] = True, int(upto[-1] - upto[starts[-1]])
            number, starts = np.diff(upto[starts]), starts[:-1]
            found = (number >= least) & (words[k - 1, starts] > 0)
            if found.any():
                yield words[:k, starts[found]].T - 1, number[found]
        last = words[:, -1:].copy()
    if last is not None:
        for k in lengths:
            if last[k - 1, 0]:
                yield last[:k].T - 1, np.array([open_[k]])


def _sorted(group: pa.Table) -> tuple[int, str, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, file, and begin, length and id of a group's other rows in order of ``place``."""
    shard, uri = group.column("shard")[0].as_py(), next(iter(group.column("uri").drop_null())).as_py()
    place, ident = (group.column(c).to_numpy() for c in ("place", "id"))
    order = np.argsort(place, kind="stable")
    order = order[place[order] >= 0]
    return shard, uri, place[order] >> 32, place[order] & 0xFFFFFFFF, ident[order]


def _by_shard(known: DataFrame, files: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each shard with its words or phrases (shard, place, id) and its file (shard, uri)."""
    heads = files.select("shard", F.lit(-1).cast("long").alias("place"), F.lit(-1).cast("long").alias("id"), "uri")
    rows = known.select("shard", "place", "id", F.lit(None).cast("string").alias("uri")).unionByName(heads)
    parts = max(1, files.count())  # the work goes by words of the shard and not by bytes of the rows
    return rows.repartition(parts, "shard").groupBy("shard").applyInArrow(work, schema)


def _counted(steps: DataFrame, min_count: int) -> DataFrame:
    """Those extensions whose phrase is frequent over all shards, and the rows that name files; written.

    Adds id and a of the phrase, and ``first``, true for one of its rows. An id is that row's number among all.
    """
    same = Window.partitionBy("p", "w")
    rows = steps.repartition("p", "w").sortWithinPartitions("p", "w").withColumn("row", F.monotonically_increasing_id())
    n = F.col("place").bitwiseAND(0xFFFFFFFF)
    summed = rows.withColumn("id", F.min("row").over(same)).withColumn("a", F.sum(n).over(same))
    frequent = summed.where(F.col("uri").isNotNull() | (F.col("a") >= min_count))
    return stash(frequent.withColumn("first", F.col("uri").isNull() & (F.col("row") == F.col("id"))).drop("row"), "phrase-steps", "zstd")


def numbered(df: DataFrame, tag: str) -> DataFrame:
    """Adds id, from 0 without gaps, and writes the table; what goes to the driver is a number for each partition."""
    rows = stash(df.withColumn("at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("at", 33)
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect())
    base = np.concatenate(([0], np.cumsum([n for _, n in counts])))
    known = rows.sparkSession.createDataFrame([(k, int(b)) for (k, _), b in zip(counts, base)], "part long, base long")
    out = stash(rows.withColumn("part", part).join(F.broadcast(known), "part").withColumn("id", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "base", "at"), tag)
    discard(rows)
    return out


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by number of words, and lang, n of all words.

    Columns: id, p (the phrase without its last word), s (without its first), w (its last word), lang, phrase, tail, a, and the counts l of its beginnings and r of its ends by
    where it is cut.
    """
    if not 2 <= longest <= DEPTH - 1:
        raise ValueError(f"phrases have 2 to {DEPTH - 1} words")
    folder = f"{shared_dir(docs.sparkSession)}/phrases-{uuid.uuid4().hex}"
    parts = stash(shards(docs, f"{folder}/words", shard_bytes), "phrase-shards")
    words = parts.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("shard", "lang", F.shiftleft(F.col("at").cast("long"), 32).alias("place"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals = stash(parts.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, v: s + v)).alias("n")), "phrase-totals")
    frequent = numbered(words.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count), "phrase-words")
    none = F.array().cast("array<bigint>")
    minus = F.lit(-1).cast("long")
    levels = [frequent.select("id", minus.alias("p"), minus.alias("s"), F.col("id").alias("w"), "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), "a", none.alias("l"), none.alias("r"))]
    known = words.join(checked_broadcast(frequent).select("lang", "word", "id"), ["lang", "word"], "left")  # a word without a name is rare

    def build(group: pa.Table) -> pa.Table:
        group = group.filter(pc.is_valid(group.column("id")))
        shard, uri, word, _, ident = _sorted(group)
        (found,) = get(uri, 1)
        names = np.zeros(int(found.max(initial=0)) + 1, np.int32)
        names[word + 1] = np.arange(1, len(word) + 1)
        found = names[found]
        gap = found == 0
        gap[1:] &= gap[:-1]  # of gaps side by side one is kept
        gap[0] = False
        bwt = Index.of(np.append(found[~gap], 0)).bwt
        release()
        return pa.table({"shard": pa.array([shard]), "uri": pa.array([put(f"{folder}/indexes", bwt, ident)])})

    keys = Keys(frequent.count(), longest)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                bwt, ident = get(uri, 2)
                for columns, n in windows(Index(bwt), ident, keys):
                    for i in range(0, len(n), BATCH_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + BATCH_ROWS]) for c in (*columns, n.astype(np.int64))], [*keys.columns, "n"])
                release()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        given = (([b.column(c).to_numpy() for c in keys.columns], b.column("n").to_numpy()) for b in batches)
        for ids, n in runs(given, keys, min_count):
            while len(n):
                lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * ids.shape[1], pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), lists, pa.array(np.minimum(n, MOST))], ["shard", "words", "place"])
                ids, n = ids[n > MOST], n[n > MOST] - MOST

    indexes = stash(_by_shard(known, parts, build, "shard long, uri string"), "phrase-indexes")
    discard(parts)
    free_heaps(docs.sparkSession)  # shards are Python's
    fs, path = hadoop_path(docs.sparkSession, folder)
    fs.delete(hadoop_path(docs.sparkSession, f"{folder}/words")[1], True)
    dealt = indexes.repartition(max(1, indexes.count()), "shard")
    seen = stash(dealt.mapInArrow(tidied(opened), ", ".join(f"{c} long" for c in (*keys.columns, "n"))), "phrase-windows", "zstd")  # ranges are found by a pass of their own
    discard(indexes)
    fs.delete(path, True)
    sorted_ = seen.repartitionByRange(seen.count() // RANGE_ROWS + 1, *keys.columns).sortWithinPartitions(*keys.columns)
    parts = stash(sorted_.mapInArrow(tidied(counted), "shard long, words array<long>, place long").withColumn("p", F.col("words")[0]), "phrase-parts")
    discard(seen)
    free_heaps(docs.sparkSession)
    for k in range(2, longest + 1):
        steps = _counted(parts.where(F.size("words") == k).select("shard", "place", "p", F.col("words")[k - 1].alias("w"), F.lit(None).cast("string").alias("uri")), min_count)
        found = steps.where("first").select("id", "p", "w", "a")
        levels.append(_named(found, levels[-1]))
        if k < longest:  # longer ones begin with one of these, or are not frequent
            longer = parts.where(F.size("words") > k).withColumn("w", F.col("words")[k - 1]).join(found, ["p", "w"])
            more = stash(longer.select("shard", "words", "place", F.col("id").alias("p")), "phrase-parts")
            discard(parts)
            parts = more
        discard(steps)
    discard(parts)
    return levels, totals


def _named(counted: DataFrame, shorter: DataFrame) -> DataFrame:
    """``phrases`` of one length, from id, p, w, a and those of one word less."""
    first = shorter.select(F.col("id").alias("p"), F.col("s").alias("q"), "lang", F.col("phrase").alias("head"), F.col("a").alias("b"), F.col("l").alias("bl"))
    rest = shorter.select(F.col("id").alias("s"), F.col("p").alias("q"), "w", "tail", F.col("a").alias("e"), F.col("r").alias("er"))
    rows = counted.join(first, "p").join(rest, ["q", "w"])
    made = rows.select(
        "id", "p", "s", "w", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "tail", "a",
        F.concat("bl", F.array("b")).alias("l"), F.concat(F.array("e"), "er").alias("r"),
    )
    return stash(made, "phrases")


#: Of the cut with the least score, the first: score, words before it, counts of both parts.
CUT = """array_min(transform(sequence(1, size(l)), k -> named_struct(
  'score', (CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l[k - 1] AS DECIMAL(19, 0)) * CAST(r[k - 1] AS DECIMAL(19, 0))),
  'k', k, 'l', l[k - 1], 'r', r[k - 1])))"""


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's first ``top`` candidates: lang, rank, phrase, a, l, r, n, score, words_before_cut.

    Candidates inside a longer one with at least ``inside`` percent of their count go. It is enough to look one word further: what lies inside a longer one
    lies inside one of one word more that is no rarer.
    """
    levels, totals = phrases(docs, min_count, longest, shard_bytes)
    kept = []
    for k in range(1, len(levels)):
        own = levels[k]
        if k + 1 < len(levels):
            longer = levels[k + 1].select(F.explode(F.array("p", "s")).alias("id"), F.col("a").alias("m")).groupBy("id").agg(F.max("m").alias("m"))
            own = own.join(longer, "id", "left").where(F.col("m").isNull() | (F.col("m") * 100 < F.col("a") * inside))
        kept.append(own.select("lang", "phrase", "a", "l", "r"))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    scored = every.join(checked_broadcast(totals), "lang").withColumn("cut", F.expr(CUT))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.col("cut.k").cast("long").alias("words_before_cut"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g FROM split, range(1, 6) r(k) WHERE len(w) >= k) GROUP BY ALL),
total AS (SELECT lang, sum(f)::HUGEINT AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM grams WHERE f >= 100),
cand AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM often WHERE k >= 2),
inside AS (SELECT lang, k, g, max(a) AS longest FROM (SELECT lang, a, m AS k, unnest(list_transform(range(1, c.k - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS g FROM cand c JOIN range(2, 5) t(m) ON m < c.k) GROUP BY ALL),
parts AS (SELECT lang, k, g, a, cut, array_to_string(w[1 : cut], ' ') AS lg, array_to_string(w[cut + 1 : k], ' ') AS rg FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
cuts AS (SELECT p.lang, p.k, p.g, a, cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM parts p JOIN total USING (lang) JOIN often l ON l.lang = p.lang AND l.k = cut AND l.g = lg JOIN often r ON r.lang = p.lang AND r.k = p.k - cut AND r.g = rg),
best AS (SELECT c.* FROM cuts c LEFT JOIN inside i USING (lang, k, g) WHERE longest IS NULL OR 100 * longest < 100 * a QUALIFY row_number() OVER (PARTITION BY lang, k, g ORDER BY score, cut) = 1)
SELECT lang, rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, cut AS words_before_cut
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best) WHERE rank <= 2000
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
