import hashlib

from stopwise.llm import exact_dedup as op

from .helpers import HARD, docs_of, duck, spark_rows


def brute(rows, best=max):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(low(t), []).append(d)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((i, len(ids), keep, kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, keep="largest"):
    return sorted(((r.doc_id, r.group_size, r.keep_id, r.kept, r.text_sha256) for r in op.exact_dedup(df, keep=keep).collect()), key=str)


def test_hard_rows(spark):
    rows = [r[:2] for r in HARD]
    assert found(docs_of(spark, HARD)) == brute(rows)
    assert found(docs_of(spark, HARD), "smallest") == brute(rows, min)
    assert found(docs_of(spark, [(None, "x"), (None, "X")])) == brute([(None, "x"), (None, "X")])


def test_empty_table_and_extra_columns(spark):
    from pyspark.sql import functions as F

    assert found(docs_of(spark, [])) == []
    df = docs_of(spark, HARD).select("*", *[F.lit(1).alias(c) for c in ("hash", "norm", "sha", "keep_id", "times", "nth")])
    assert found(df) == brute([r[:2] for r in HARD])


def test_many_repeated_hashes_are_not_broadcast(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_BYTES", 0)
    assert spark_rows(op.query(spark, sf_dir)) == duck(op.ORACLE, documents=f"{sf_dir}/documents.parquet")


def test_query_equals_sql(spark, sf_dir):
    assert spark_rows(op.query(spark, sf_dir)) == duck(op.ORACLE, documents=f"{sf_dir}/documents.parquet")
