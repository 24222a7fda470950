"""What is measured over whole planes, by NumPy: candidate traces of a line, and means of rows and columns.

A plane is worked on where it is decoded, or where its rows are gathered, one plane in a task at a time; columns are read as slices of the
plane, so that no sample is a row of its own and nothing is transposed by a shuffle. Temporaries cover LINES lines.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values.
LEAST_CONTRAST = 0.15
SIDE = 0.35
MOST_SUPPORT = 0.75
LEVEL = 0.45
LINES = 256
POINT = pa.struct([("cand", pa.int32()), ("major", pa.int32()), ("minor", pa.float64()), ("contrast", pa.float64())])
POINT_DDL = "struct<cand: int, major: int, minor: double, contrast: double>"


def trace(across: np.ndarray, base: int) -> list[tuple[np.ndarray, ...]]:
    """cand, major, minor, contrast of the six candidates of one orientation; ``across``: (lines, samples across a line).

    Candidates are three bands (near the start, near the end, all) of two polarities (dark, bright). A line has a point where its samples differ
    enough, and fewer than three quarters of them are beyond the level: their weighted centre.
    """
    n = across.shape[1]
    side = min(max(math.ceil(n * SIDE), 1), n)
    out = []
    for k, (a, b) in enumerate(((0, side), (n - side, n), (0, n))):
        places = np.arange(a, b, dtype=float)
        for first in range(0, len(across), LINES):
            part = np.ascontiguousarray(across[first : first + LINES, a:b], float)
            low, contrast = part.min(1), np.ptp(part, axis=1)
            for bright in (0, 1):
                level = low + contrast - contrast * LEVEL if bright else low + contrast * LEVEL
                weight = (part - level[:, None]) * (1 if bright else -1)
                support = (weight >= 0).sum(1) / (b - a)
                np.maximum(weight, 0, out=weight)
                total = weight.sum(1)
                found = np.flatnonzero((contrast >= LEAST_CONTRAST) & (support <= MOST_SUPPORT) & (total > 0))
                minor = weight[found] @ places / total[found]
                out.append((np.full(len(found), base + 2 * k + bright), first + found, minor, contrast[found]))
    return out


def points(plane: np.ndarray) -> pa.StructArray:
    """Points of all twelve candidates: 0 to 5 along columns (horizontal lines), 6 to 11 along rows."""
    found = [np.concatenate(c) for c in zip(*trace(plane.T, 0), *trace(plane, 6))]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(found, POINT)], fields=list(POINT))


def listed(values: list[pa.Array]) -> pa.ListArray:
    """A list column of one array a row."""
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.concat_arrays(values))


def gathered(rows: DataFrame, traced: bool) -> DataFrame:
    """run_id, width, height and points (``traced``), or row_means and column_means, of planes given as rows (run_id, y, samples).

    Rows that are dealt by run_id already are not dealt again.
    """
    made = {"points": f"array<{POINT_DDL}>"} if traced else {"row_means": "array<double>", "column_means": "array<double>"}

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("y").combine_chunks()
        samples = group.column("samples").combine_chunks()
        plane = samples.flatten().to_numpy().reshape(len(samples), -1)
        if traced:
            lists = [listed([points(plane)])]
        else:
            lists = [listed([pa.array(plane.mean(k))]) for k in (1, 0)]
        size = [pa.array([n], pa.int32()) for n in plane.shape[::-1]]
        return pa.table([group.column("run_id").slice(0, 1), *size, *lists], ["run_id", "width", "height", *made])

    kind = rows.schema["run_id"].dataType.simpleString()
    schema = f"run_id {kind}, width int, height int, " + ", ".join(f"{n} {k}" for n, k in made.items())
    return rows.select("run_id", "y", "samples").groupBy("run_id").applyInArrow(work, schema)
