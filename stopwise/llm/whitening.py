"""Whitening of embeddings by a polarised covariance.

Entries become integers (a fixed-point scale and an offset), so that all sums are exact and don't depend on how rows are
dealt. The fit list is each distinct vector once. Two aggregations cover it: sums of each dimension, and squares of
the centred values of each dimension and of each sum of two dimensions. Half of what the squares of a sum exceed those of its two dimensions by is their
cross product, for all pairs at once; from there one ``eigh`` of dimension x dimension numbers on the driver gives
the components. What travels to the driver depends on the dimensions alone.

Centring: values are centred at the integer next to their mean before they are squared, which keeps the squares small, and the fraction
that is left over (under 1) is taken off in integers of any size. So sum((n x_i - S_i) (n x_j - S_j)) is known exactly, and rounded once.

Edge cases: rows whose vector is null or holds null or non-finite entries are dropped, and a null id is an id like any other;
repeated rows are answered each; an empty table, and a fit list in which nothing varies, give an empty result; components whose eigenvalue is not
above the rounding error of the largest can't be whitened and are left out; vectors of different lengths, and sums that leave 64 bits where the result is
one, raise; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.deploy import tidied
from stopwise.llm.common import discard, stash, table

# Fixed values of the query.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows that are worked on at once.
ROWS = 4096
EXACT = 1 << 62


def fixed_point(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and x, an array of longs, of the rows whose vector is whole."""
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))
    return rows.where(whole).select("vec_id", x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def _exact(values: np.ndarray, most: int) -> np.ndarray:
    """``values`` of any size if sums of ``most`` could leave 64 bits."""
    return values if most < EXACT else values.astype(object)


def _summed(rows: DataFrame, sums) -> dict[tuple[int, int], int]:
    """Totals over all rows of a (row batch -> square array of whole numbers) function, by place; each task emits its own once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column("x"))
            for a in range(0, len(x), ROWS):
                part = sums(x[a : a + ROWS]).astype(object)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            some = np.array(total != 0)
            columns = [pa.array(i[some].astype(np.int32)), pa.array(j[some].astype(np.int32)), pa.array([str(v) for v in total[some]], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "v"])

    found = rows.select("x").mapInArrow(tidied(work), "i int, j int, v string")
    found = found.groupBy("i", "j").agg(F.sum(F.col("v").cast(T.DecimalType(38, 0))).alias("v"))
    return {(r.i, r.j): int(r.v) for r in found.collect()}


def polarised(z: np.ndarray) -> np.ndarray:
    """Place (i, i): squares of dimension i; (i, j > i): squares of the sum of both."""
    d = z.shape[1]
    most = 4 * len(z) * max(int(np.abs(z).max(initial=0)), 1) ** 2
    z = _exact(z, most)
    out = np.zeros((d, d), z.dtype)
    for i in range(d):
        both = z[:, i:] + z[:, i : i + 1]
        both[:, 0] = z[:, i]
        out[i, i:] = (both * both).sum(0)
    return out


class Model:
    """n, the integer centre m, the sums Z of x - m, the exact scatter, and components by falling eigenvalue."""

    def __init__(self, n: int, centre: list[int], rest: list[int], squares: dict[tuple[int, int], int], most: int):
        d = len(centre)
        self.n, self.centre, self.rest = n, np.array(centre, np.int64), np.array(rest, np.int64)
        cov = np.empty((d, d))
        for i in range(d):
            for j in range(i, d):
                cross = squares.get((i, i), 0)
                if j > i:
                    cross, odd = divmod(squares.get((i, j), 0) - squares.get((i, i), 0) - squares.get((j, j), 0), 2)
                    assert not odd
                cov[i, j] = cov[j, i] = float(Fraction(n * cross - rest[i] * rest[j], n * n))
        self.trace = float(np.trace(cov))
        value, vector = np.linalg.eigh(cov)
        order = np.argsort(-value, kind="stable")[:most]
        order = order[value[order] > d * np.finfo(float).eps * max(float(value[-1]), 0.0)] if d else order
        self.value = value[order]
        # of a component's two signs the one whose largest entry is positive
        vector = vector[:, order]
        self.vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(len(order))]) if len(order) else vector

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, as longs."""
        z = x - self.centre
        most = self.n * (int(np.abs(z).max(initial=0)) + 1)
        y = _exact(z, most) * self.n - self.rest
        total = (_exact(y, x.shape[1] * most * most) ** 2).sum(1)
        if total.dtype == object and any(v > np.iinfo(np.int64).max for v in total):
            raise OverflowError("a deviation leaves 64 bits")
        return total.astype(np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest / self.n) @ self.vector / np.sqrt(self.value)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a written table of distinct vectors x; None if there are none."""
    n, short, long = distinct.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n or not long:
        return None
    if short != long:
        raise ValueError("vectors differ in length")
    sums = _summed(distinct, lambda x: _exact(x, len(x) * max(int(np.abs(x).max(initial=0)), 1)).sum(0, keepdims=True))
    centre = [sums.get((0, i), 0) // n for i in range(long)]
    rest = [sums.get((0, i), 0) - n * m for i, m in enumerate(centre)]
    held = np.array(centre, np.int64)
    return Model(n, centre, rest, _summed(distinct, lambda x: polarised(x - held)), components)


def identity_error(distinct: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from its rows."""
    k = len(model.value)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))  # products, then sums
        for batch in batches:
            x = matrix(batch.column("x"))
            for a in range(0, len(x), ROWS):
                w = model.whitened(x[a : a + ROWS])
                total += np.concatenate((w.T @ w, w.sum(0, keepdims=True)))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in distinct.select("x").mapInArrow(tidied(work), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    total /= model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row for each whole row and component: vec_id and SCHEMA."""
    points = fixed_point(rows, vector, scale, offset)
    kind = f"vec_id {points.schema['vec_id'].dataType.simpleString()}, {SCHEMA}"
    distinct = stash(points.select("x").distinct(), "whitening-fit")
    model = fit(distinct, components)
    if model is None or not len(model.value):
        return rows.sparkSession.createDataFrame([], kind)
    error = identity_error(distinct, model)
    discard(distinct)
    k = len(model.value)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = matrix(part.column("x"))
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(np.arange(n), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, model.n)),
                        pa.array(np.repeat(model.deviation(x), k)),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(model.value / model.trace, n)),
                        pa.array(np.full(n * k, error)),
                    ],
                    ["vec_id", *(c.split()[0] for c in SCHEMA.split(", "))],
                )

    return points.mapInArrow(tidied(work), kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
