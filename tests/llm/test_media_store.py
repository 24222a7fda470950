import hashlib
import tarfile
import zlib

from stopwise.llm import media_store as op
from stopwise.llm.common import table

from .helpers import HARD, docs_of


def check(docs, folder):
    texts = sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=str)
    got = sorted(op.media_columns(docs, folder).collect(), key=lambda r: str((r.doc_id, None)) if r.doc_id is None else str((r.doc_id,)))
    assert len(got) == len(texts)
    want = sorted((str(d), len(t), len(p := t + bytes(-len(t) % 64 or (64 if not t else 0))), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for d, t in texts)
    assert want == sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    for r in got:
        assert r.width == 64 and r.height * 64 == r.payload_bytes and r.bit_depth == 8
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            data = f.read(r.length)
        assert hashlib.sha256(data).hexdigest() == r.media_sha256 and len(data) == r.media_bytes
        assert hashlib.sha256(op.from_png(data)).hexdigest() == r.payload_sha256
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r.payload_sha256, (r.media_sha256, r.feature, r.shard, r.offset)) == (r.media_sha256, r.feature, r.shard, r.offset)
    return got


def test_whole_table(spark, sf_dir, tmp_path):
    got = check(table(spark, sf_dir, "documents"), f"file://{tmp_path}/m")
    for shard in {r.shard for r in got}:
        with tarfile.open(shard.removeprefix("file://")) as tar:
            for member in tar.getmembers():
                data = tar.extractfile(member).read()
                assert hashlib.sha256(op.from_png(data)).hexdigest() + ".png" == member.name


def test_hard_rows_and_empty_table(spark, tmp_path):
    check(docs_of(spark, [*HARD, (90, "x" * 64), (91, "x" * 63), (92, "x" * 128)]), f"file://{tmp_path}/m")
    assert op.media_columns(docs_of(spark, []), f"file://{tmp_path}/e").count() == 0


def test_reads_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "READ_BYTES", 4 << 10)
    rows = [(i, "".join(chr(33 + (i * k * 7919 >> 3) % 90) for k in range(3000))) for i in range(40)]
    check(docs_of(spark, rows), f"file://{tmp_path}/m")


def test_clashing_names(spark, tmp_path):
    from pyspark.sql import functions as F

    df = docs_of(spark, HARD).select("*", *[F.lit(1).alias(c) for c in ("digest", "shard", "offset", "length", "n_bytes", "width", "feature")])
    check(df, f"file://{tmp_path}/m")
