import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from stopwise.llm import packing as op
from stopwise.llm import tokens
from stopwise.llm.common import table

from .helpers import HARD, docs_of


#: Special strings inside and between words, and letters whose composition and lower case don't commute.
ODD = [
    "a <|endoftext|> b", "foo<|endoftext|>Bar, x", "<|ENDOFTEXT|> <|StartOfText|> <|startoftext|>", "<|endoftext|>\u0301e A<B, C<D.",
    "é, É. \u00d7, \u00f7. e\u0301, a\u0300. \u2014, Ãx, xÃ. \u00ff, a,, é,. é", "\u00c0. , . ,a", "H\u0331 J\u030c T\u0308 W\u030a Y\u030a", "E\u0301cole. ECOLE, ÉCOLE, \u00c5 A\u030a \u212b", "\u1fbc\u0399 \u0130I i\u0307, ẞ SS", "x\u0085Y\u00a0Z, N\u3000M.",
]


def check(spark, docs, capacity=2048):
    enc = Tokenizer.from_file(tokens.default_vocabulary())
    want = []
    for r in docs.collect():
        ids = [*enc.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            want.append((r.doc_id, k // capacity, k, len(part), zlib.crc32(part)))
    got = op.pack_documents(docs, capacity).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_whole_table(spark, sf_dir):
    bins, total = check(spark, table(spark, sf_dir, "documents"))
    assert bins <= 1.02 * -(-total // 2048) + 1


def test_hard_rows_and_empty_table(spark):
    check(spark, docs_of(spark, [*HARD, *[(30 + i, t) for i, t in enumerate(ODD)], (20, "don't İstanbul ΑΣ ΑΣ. 's <|endoftext|> naïve é ́x co-op", None, None)]))
    assert op.pack_documents(docs_of(spark, [])).count() == 0


def test_small_sequences_and_rounds(spark):
    rng = np.random.default_rng(1)
    n = [int(x) for x in rng.integers(1, 100, 3000)]
    items = spark.createDataFrame([(i, 0, 0, x, i) for i, x in enumerate(n)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = op.pack(items, 100, per_task=100, slack=1).collect()
    used = defaultdict(int)
    for r in rows:
        assert r.length == n[r.doc_id]
        used[r.sequence_id] += r.length
    assert len(rows) == len(n) and max(used.values()) <= 100
    assert len(used) <= 1.05 * sum(n) / 100


def test_cache_overflow_keeps_ids_right():
    t = tokens.Tokens(tokens.default_vocabulary(), most=5)
    for text in ("one two three four five six seven", "one, TWO. eight nine-ten", "six six two, two. two", "É. é, a.. b., c ,d e.f \x00, .", *ODD, ""):
        words, index, count = tokens.words_of([text.encode()])
        ids, n = t.encode(words, index)
        assert ids.tolist() == t.encoder.encode(text, add_special_tokens=False).ids
        assert n.sum() == len(ids) and count.sum() == len(index)


def test_half_full_bins_meet_small_items(spark):
    """Items over half a sequence and small ones, as many sequences as one task's best-fit decreasing but 2 %."""
    rng = np.random.default_rng(2)
    n = np.concatenate((rng.integers(1030, 1500, 50_000), rng.integers(100, 901, 50_000)))
    items = spark.range(len(n)).selectExpr("id AS doc_id")
    sizes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "doc_id long, length long")
    items = items.join(sizes, "doc_id").selectExpr("doc_id", "0 AS piece", "0L AS start", "length", "0L AS ids_crc32")
    one = len(op.best_fit(n, 2048))
    for per_task in (50_000, 5_000):
        rows = op.pack(items, 2048, per_task=per_task).select("sequence_id", "length").groupBy("sequence_id").sum("length").collect()
        assert max(r[1] for r in rows) <= 2048 and sum(r[1] for r in rows) == n.sum()
        assert len(rows) <= 1.02 * one


def test_bins_that_cannot_merge_end_early(spark):
    items = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1100L + id % 300 AS length", "0L AS ids_crc32")
    assert op.pack(items, 2048, per_task=100).select("sequence_id").distinct().count() == 3000


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    df = docs_of(spark, [(1, "one two"), (1, "one two")]).select("*", *[F.lit(1).alias(c) for c in ("piece", "used", "items", "open", "sequence_id", "offset", "length", "start")])
    assert sorted((r.doc_id, r.piece, r.length) for r in op.pack_documents(df).collect()) == [(1, 0, 3)] * 2


def test_common_words_stay_for_the_next_task():
    """At most half a cache, those that most slices had; ids are those of the whole text whatever is held."""
    import numpy as np

    from stopwise.llm import tokens as op

    held, path = op.Tokens(op.default_vocabulary(), most=40), op.default_vocabulary()
    texts = [[f"the word {k} and café number {k + 1}, <b> Été {k}x".encode()] for k in range(12)]
    for text in texts:
        words, index, _ = op.words_of(text)
        held.encode(words, index)
    held.rest()
    assert 0 < held.known <= 20 and {b"the", b"word", b"and", "café".encode()} <= held.number.keys()
    learned = []
    learn = held._learn
    held._learn = lambda words: (learned.extend(words), learn(words))
    for text in texts:
        words, index, _ = op.words_of(text)
        want = held.encoder.encode(text[0].decode(), add_special_tokens=False).ids
        assert np.array_equal(held.encode(words, index)[0], want)
    assert learned and not {b"the", b"word", b"and"} & set(learned)
    assert op.tokens(path).rest() is None
