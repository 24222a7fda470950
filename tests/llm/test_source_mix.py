from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.llm import source_mix as op

from .helpers import HARD, docs_of, duck, spark_rows


def water(sizes, share=1.5, weights=(3, 1, 2), cap=2.0):
    """Targets by repeated capping and resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def check(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.src] += r.size
        taken[r.src] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    goal = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.src] and r.target == pytest.approx(goal[r.src])
    for s in sizes:
        assert taken[s] == int(goal[s] + 1e-6)


def mixed(df, **k):
    out = op.mix(df, **k)
    src = df.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("source").alias("src")).distinct()
    return out.join(src, out.doc_id.eqNullSafe(src.doc_id) & (out.text_key == src.text_key)).select(out["*"], "src").collect()


def test_hard_rows(spark):
    check(mixed(docs_of(spark, HARD)))
    assert op.mix(docs_of(spark, [])).count() == 0
    wordless = op.mix(docs_of(spark, [(1, None, None, "a"), (2, " ", None, None)])).collect()
    assert [(r.size, r.taken, r.target) for r in wordless] == [(0, 0, 0.0)] * 2


@pytest.mark.parametrize("lengths", [(5, 400, 3, 70), (1000, 1, 1, 1), (10, 10, 10), (7,), (1, 2, 4, 8, 16, 32, 64)])
def test_targets(spark, lengths):
    rows = [(10_000 * i + j, "w " * (1 + j % 5), "en", f"s{i}") for i, n in enumerate(lengths) for j in range(n)]
    check(mixed(docs_of(spark, rows)))


def test_parts_do_not_matter_and_reruns_agree(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b, c = (sorted(map(str, op.mix(df, per_task=n).collect())) for n in (20, 1000, 1000))
    assert a == b == c


@pytest.mark.parametrize("quality", [0.02, 1e-6, 1.0, 20.0])
def test_parts_are_even_for_any_quality(spark, quality):
    rows = spark.range(20_000).select(F.lit("s").alias("source_key"), (-F.log(op.uniform(7, F.col("id"))) / F.lit(quality)).alias("key"))
    sizes = [r["count"] for r in op.ranged(rows, ["source_key", "key"], 1000, "test").groupBy("part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000


def test_many_sources_in_parts(spark):
    rng = np.random.default_rng(3)
    sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 900, 300))} | {None: 40}
    totals = spark.createDataFrame([(s, n) for s, n in sizes.items()], "src string, source_size long").withColumn("source_key", op.source_key(F.col("src")))
    got = {r.source_key: r.target for r in op.targets(totals.drop("src"), 1.5, (3, 1, 2), 2.0, per_task=25).collect()}
    want = water(sizes)
    assert len(got) == len(want) and all(got["t" if s is None else f"s{s}"] == pytest.approx(x) for s, x in want.items())


def test_odd_qualities_and_clashing_names(spark):
    df = docs_of(spark, [(i, "w w", "en", "s") for i in range(60)]).select("*", *[F.lit(1).alias(c) for c in ("q", "key", "part", "size", "src", "target", "text_key")])
    odd = [float("nan"), float("inf"), 0.0, -1.0, None, 1e-300]
    quality = spark.createDataFrame([(i, odd[i % 6]) for i in range(60)], "doc_id long, quality double")
    assert sum(r.taken for r in op.mix(df, quality).collect()) == 180


def test_better_documents_come_first(spark):
    df = docs_of(spark, [(i, "w w", "en", "s") for i in range(2000)])
    quality = df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1).alias("quality"))
    got = op.mix(df, quality).collect()
    twice = [r.doc_id % 2 for r in got if r.taken == 4]
    assert len(twice) == 1000 and twice.count(0) > 800


def test_query_equals_sql(spark, sf_dir):
    want = duck(op.ORACLE, documents=f"{sf_dir}/documents.parquet", labels=f"{sf_dir}/labels.parquet")
    assert spark_rows(op.query(spark, sf_dir)) == want
