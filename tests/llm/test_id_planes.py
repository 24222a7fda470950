import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stopwise.llm import id_planes as op
from stopwise.llm.common import table
from stopwise.llm.tokens import default_vocabulary

from .helpers import HARD, docs_of
from .test_packing import ODD


def brute(rows):
    """doc_id, start, n_tokens, crc32 by the tokenizer alone; rows of one doc_id may come in any order, so those get no start."""
    enc = Tokenizer.from_file(default_vocabulary())
    coded = [(d, np.array([*enc.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t in rows]
    out, at = [], 0
    for d, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((d, at if [x for x, _ in rows].count(d) == 1 else None, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return sorted(out, key=str), at


def check(docs, **how):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, total = brute(rows)
    got = op.documents(op.write(docs, **how)).collect()
    once = {d for d, s, *_ in want if s is not None}
    assert sorted(((r.doc_id, r.start if r.doc_id in once else None, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    at = 0  # starts leave no gap, whatever the order among equal doc_ids
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert at == total and [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))


def test_whole_table(spark, sf_dir):
    check(table(spark, sf_dir, "documents"))


@pytest.mark.parametrize("planes", [4, 32])
def test_hard_rows_in_several_shards(spark, planes):
    docs = docs_of(spark, [*HARD, *[(30 + i, t) for i, t in enumerate(ODD)], *[(7, "same row")] * 40])
    check(docs, planes=planes, block=1000, shard_bytes=20_000)


def test_empty_table_and_clashing_names(spark):
    from pyspark.sql import functions as F

    assert op.documents(op.write(docs_of(spark, []))).collect() == []
    df = docs_of(spark, [(2, "b"), (1, None)]).select("*", *[F.lit(1).alias(c) for c in ("ids", "h", "row", "start", "n_tokens", "shard", "uri")])
    assert [(r.doc_id, r.start, r.n_tokens) for r in op.documents(op.write(df)).orderBy("start").collect()] == [(1, 0, 1), (2, 1, 2)]


def test_doc_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "z"), (None, "z")], "doc_id string, text string")
    assert [(r.doc_id, r.start) for r in op.documents(op.write(docs), "string").orderBy("start").collect()] == [(None, 0), ("a", 2), ("b", 4)]


@pytest.mark.parametrize("planes", [4, 32])
@pytest.mark.parametrize("top", [1, 255, 49408, 2**32 - 1])
def test_planes_round_trip(planes, top):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, top, n, dtype=np.uint32, endpoint=True)
        parts = op.to_planes(ids, planes)
        assert len(parts) == planes and (op.from_planes(parts, n) == ids).all()
    assert op.to_planes(np.zeros(9, np.uint32), planes) == [b""] * planes


@pytest.mark.parametrize("planes", [4, 32])
def test_ranges_read_only_their_blocks(tmp_path, planes):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 49408, 100_000, dtype=np.uint32)
    file = op.Writer(f"file://{tmp_path}", 1000, planes)
    for a in range(0, len(ids), 777):
        file.add(pa.array([a]), np.array([len(ids[a : a + 777])]), ids[a : a + 777])
    file.close()
    read = op.Reader(file.uri)
    assert read.ids == len(ids) and [len(b) for b in read.blocks()] == [1000] * 100
    seen, block = [], read._block
    read._block = lambda k: seen.append(k) or block(k)
    for a, b in ((0, 100_000), (999, 1001), (5000, 6000), (99_999, 100_000), (70, 70)):
        seen.clear()
        assert (read.read(a, b) == ids[a:b]).all()
        assert seen == list(range(a // 1000, -(-b // 1000))) if a < b else not seen
    with pytest.raises(ValueError):
        read.read(5, 100_001)
    assert sum(d.num_rows for d in read.documents()) == -(-100_000 // 777)
