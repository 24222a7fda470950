import numpy as np
import xxhash

from stopwise.llm import simhash_dedup as op
from stopwise.llm.common import table

from .helpers import HARD, docs_of


def brute(rows):
    """{(doc_id, fingerprint, component_id)} by definition: all shingles, all pairs."""
    fps = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    f = np.array(fps, np.uint64)
    comp = list(range(len(f)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4):
            a, b = root(i), root(int(j))
            comp[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in op.near_dups(df).collect()), key=str)


def test_whole_table_like_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_hard_rows_and_empty_table(spark):
    assert found(docs_of(spark, HARD)) == brute([r[:2] for r in HARD])
    assert found(docs_of(spark, [])) == []


def test_keys_meet_for_any_four_errors():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**64, 3000, np.uint64)
    other = fp.copy()
    for i in range(len(fp)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    a, b = op.fuzzy_keys(fp), op.fuzzy_keys(other)
    pairs = set(zip(a[0].tolist(), a[1].tolist())) & set(zip(b[0].tolist(), b[1].tolist()))
    assert {i for _, i in pairs} == set(range(len(fp)))


def test_crowded_keys_are_cut_into_blocks_without_loss(spark):
    rng = np.random.default_rng(5)
    base = np.uint64(0x0123456789ABCDEF)
    fps = {int(base)}
    for _ in range(600):
        x = base
        for b in rng.choice(64, 2, replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        fps.add(int(x))
    far = [int(x) for x in rng.integers(0, 2**64, 50, np.uint64)]
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in [*fps, *far]], "fp long")
    links = op.links_of(df, block=64).collect()
    assert all((a ^ b) % 2**64 and bin((a ^ b) % 2**64).count("1") <= 4 for a, b in links)
    from stopwise.llm.graph import components

    roots = {r.node: r.root for r in components(op.links_of(df, block=64)).collect()}
    assert len({roots[int(np.uint64(x).astype(np.int64))] for x in fps}) == 1
    assert len(links) < 40 * len(fps)


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    df = docs_of(spark, HARD).select("*", *[F.lit(1).alias(c) for c in ("fp", "text_key", "root", "component_id", "first", "key")])
    assert found(df) == brute([r[:2] for r in HARD])
