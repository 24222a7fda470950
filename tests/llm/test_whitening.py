import math
from fractions import Fraction

import numpy as np
import pytest

from stopwise.llm import whitening as op
from stopwise.llm.common import table


def brute(rows, most=16):
    """From the definitions, with fractions: per row deviation, and covariance, eigenvalues and vectors of the fit list."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    y = np.array([[n * x[k] - s[k] for k in range(d)] for x in fit], object)
    cross = y.T @ y
    cov = np.array([[float(Fraction(int(cross[i, j]), n**3)) for j in range(d)] for i in range(d)])
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)[:most]
    dev = [(i, sum((n * c - t) ** 2 for c, t in zip(x, s))) for i, x in kept]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s)] for _, x in kept])
    return n, dev, value[order], value.sum(), centred @ vector[:, order] / np.sqrt(value[order])


def check(df, most=16):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    n, dev, value, trace, white = brute(rows, most)
    got = op.whiten(df, components=most).collect()
    assert len(got) == len(dev) * len(value) and {r.n for r in got} == {n}
    assert sorted({(r.vec_id, r.deviation) for r in got}, key=str) == sorted(set(dev), key=str)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-9
    for k in range(len(value)):
        own = [r for r in got if r.component == k + 1]
        assert all(r.explained == pytest.approx(value[k] / trace, rel=1e-9) for r in own)
        mine = sorted((str(r.vec_id), r.whitened) for r in own)
        want = sorted(((str(i), w) for (i, _), w in zip(dev, white[:, k])), key=lambda x: x)
        flip = sorted(((str(i), -w) for (i, _), w in zip(dev, white[:, k])), key=lambda x: x)
        near = lambda a: all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-7 * max(1, abs(y[1])) for x, y in zip(mine, a))
        assert near(want) or near(flip)


def vectors(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, n int, x string")


def test_whole_table(spark, sf_dir):
    check(table(spark, sf_dir, "embeddings"))


def test_hard_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, [3, 1, 0.5, 2, 1])], 1, "a") for i in range(60)]
    rows += [(i % 7, rows[0][1], None, None) for i in range(200)]  # a third and more of the rows are one vector
    rows += [(900, None, 0, ""), (901, [1.0, None, 0.0, 0.0, 0.0], 0, ""), (902, [float("nan")] * 5, 0, ""), (903, [float("-inf"), 0.0, 0.0, 0.0, 0.0], 0, ""), (None, [1.0, 2.0, 3.0, 4.0, 5.0], 0, "")]
    check(vectors(spark, rows))
    check(vectors(spark, rows, "array<double>"), 3)


def test_nothing_to_whiten(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None, 0, "")], [(1, [1.0, 2.0], 0, "")] * 3, [(1, [], 0, "")]):
        out = op.whiten(vectors(spark, rows))
        assert out.columns == names and out.collect() == []


def test_flat_dimensions_are_left_out(spark):
    rows = [(i, [float(i), 5.0, float(-i)], 0, "") for i in range(9)]
    got = op.whiten(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and got[0].explained == pytest.approx(1)


def test_lengths_that_differ_raise(spark):
    with pytest.raises(Exception, match="differ in length"):
        op.whiten(vectors(spark, [(1, [1.0, 2.0], 0, ""), (2, [1.0], 0, "")])).collect()


def test_large_entries_stay_exact():
    rng = np.random.default_rng(4)
    z = rng.integers(-(2**31), 2**31, (50, 3))
    got, want = op.polarised(z), z.astype(object).T @ z.astype(object)
    assert all(got[i, i] == want[i, i] for i in range(3))
    assert all(got[i, j] == want[i, i] + want[j, j] + 2 * want[i, j] for i in range(3) for j in range(i + 1, 3))
