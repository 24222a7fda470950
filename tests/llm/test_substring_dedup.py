import numpy as np

from stopwise.llm import substring_dedup as op

from .helpers import HARD, docs_of, duck, spark_rows


def compare(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = spark_rows(op.query(spark, str(tmp_path)))
    assert got == duck(op.ORACLE, documents=f"{tmp_path}/documents.parquet/*.parquet")


def test_hard_rows(spark, tmp_path):
    compare(spark, docs_of(spark, HARD), tmp_path)


def test_planted_repeats_and_periods(spark, tmp_path):
    rng = np.random.default_rng(2)
    word = lambda n, k: [f"w{x}" for x in rng.integers(0, k, n)]
    shared = [word(n, 500) for n in (49, 50, 51, 80, 300)]
    rows = []
    for i in range(120):
        parts = word(rng.integers(0, 120), 500)
        for _ in range(rng.integers(0, 3)):
            p = list(shared[rng.integers(0, len(shared))])
            if rng.random() < 0.4:
                p[rng.integers(0, len(p))] = "edit"
            parts += p + word(rng.integers(0, 40), 3)
        rows.append((i % 110, " ".join(parts)))
    rows += [(200, "a " * 70), (201, "a " * 120), (202, "a b " * 60), (203, "b " + "a b " * 40), (204, "x " + "a " * 55 + "y")]
    compare(spark, docs_of(spark, rows), tmp_path)


def test_empty_table(spark, tmp_path):
    compare(spark, docs_of(spark, []), tmp_path)


def test_equal_windows_pick_equal_anchors():
    rng = np.random.default_rng(9)
    common = [f"c{x}" for x in rng.integers(0, 40, 200)]
    docs = [[f"d{x}" for x in rng.integers(0, 40, n)] + common + [f"e{x}" for x in rng.integers(0, 9, 30)] for n in (0, 13, 77)]
    picked = []
    for d in docs:
        data = np.frombuffer(" ".join(d).encode(), np.uint8)
        word, count = op.words_of(data, np.array([len(data)]))
        starts, spot, anchor = op.windows(word, count, 50)
        at = len(d) - 230
        picked.append([(int(spot[p]) - p, int(anchor[p])) for p in range(at, at + 151)])
    assert picked[0] == picked[1] == picked[2]


def test_digests_go_by_words(spark, tmp_path):
    """Equal words have equal digests whatever parts them, others don't, nor do places of the anchor."""
    one = " ".join(f"a{i}" for i in range(80))
    rows = [(1, one), (2, " ".join(f"b{i}" for i in range(80))), (3, "x  " + one)]
    data = np.frombuffer(" ".join(t for _, t in rows).encode(), np.uint8)
    joined = op.Joined(data, np.array([len(data)]))
    names = joined.digests(np.array([0, 80, 161, 0]), np.full(4, 60), np.array([0, 0, 0, 1]))
    assert names[0] == names[2] != names[1] and names[3] != names[0]
    compare(spark, docs_of(spark, rows), tmp_path)


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    df = docs_of(spark, HARD).select("*", *[F.lit(1).alias(c) for c in ("anchor", "stretch", "text_key", "ranges", "n_words", "first", "last")])
    plain, more = (sorted(map(str, op.substring_dedup(d).collect())) for d in (docs_of(spark, HARD), df))
    assert plain == more
