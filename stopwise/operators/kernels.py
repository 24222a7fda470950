"""Patch sharpness and colour shift for large patches, vectorised: the same quantities as ``sharpness`` and
``colour_shift`` without lambda expressions.

Patches of real frames have hundreds of thousands of samples, where array expressions are the slow path;
one Arrow batch is blurred by NumPy at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from stopwise.functions.arrays import gaussian
from stopwise.operators.colour_shift import EPSILON, LEAST_ENERGY, LEAST_LENGTH, window_of
from stopwise.operators.sharpness import COARSE, FINE, LEAST_SIGNAL


def blur(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Zero-padded separable blur, columns first."""
    taps = gaussian(sigma)
    reach = len(taps) // 2
    for axis in (0, 1):
        n = plane.shape[axis]
        wide = np.zeros([size + 2 * reach * (k == axis) for k, size in enumerate(plane.shape)])
        wide[(slice(None),) * axis + (slice(reach, reach + n),)] = plane
        part = lambda k: wide[(slice(None),) * axis + (slice(k, k + n),)]  # noqa: E731, B023
        plane = taps[0] * part(0)
        for k, t in enumerate(taps[1:], 1):
            plane += t * part(k)
    return plane


def measure(plane: np.ndarray) -> tuple[float, float, float]:
    """Acutance, contrast, median."""
    fine, coarse = blur(plane, FINE), blur(plane, COARSE)
    middle = (fine - coarse).std()
    spread, mean = plane.std(), plane.mean()
    acutance = 0.0 if spread <= LEAST_SIGNAL or middle <= LEAST_SIGNAL else (plane - fine).std() / middle
    median = float(np.median(plane))
    if not median > 0:
        raise ValueError("median luminance is not positive")
    return float(acutance), float(spread / mean) if mean > 0 else 0.0, median


def correlations(red: np.ndarray, blue: np.ndarray, most: int) -> dict[int, float | None]:
    """Of red[i] with blue[i - lag] for each lag of up to ``most``, at 9 decimals; None for too few pairs or too little energy."""
    lags, n = np.arange(-most, most + 1), len(red)
    at = np.arange(n) - lags[:, None]
    met = (at >= 0) & (at < n)
    pairs = met.sum(1)
    a, b = (np.where(met, v, 0.0) for v in (red, blue[np.clip(at, 0, n - 1)]))
    a, b = (np.where(met, v - v.sum(1, keepdims=True) / np.maximum(pairs, 1)[:, None], 0.0) for v in (a, b))
    xx, yy, xy = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
    known = (pairs >= LEAST_LENGTH) & (xx > LEAST_ENERGY) & (yy > LEAST_ENERGY)
    score = xy / np.sqrt(np.where(known, xx * yy, 1.0))
    return {lag: round(v, 9) if ok else None for lag, v, ok in zip(lags.tolist(), score.tolist(), known.tolist())}


def axis_shift(red: np.ndarray, blue: np.ndarray) -> tuple[float | None, str | None]:
    """Shift between two profiles in samples, or what stands against it."""
    if len(red) < LEAST_LENGTH:
        return None, "profile_too_short"
    if red.var() < LEAST_ENERGY or blue.var() < LEAST_ENERGY:
        return None, "flat_profile"
    most = window_of(len(red))
    score = correlations(red, blue, most + 1)
    known = [lag for lag in range(-most, most + 1) if score[lag] is not None]
    if not known:
        return None, "correlation_peak_not_found"
    at = max(known, key=lambda lag: (score[lag], -abs(lag), -lag))
    left, right = score[at - 1], score[at + 1]
    if left is None or right is None or abs(curve := left - 2 * score[at] + right) <= EPSILON:
        return float(at), None
    return at + min(max(0.5 * (left - right) / curve, -0.5), 0.5), None


def shift(red: np.ndarray, blue: np.ndarray) -> tuple[float | None, float | None, str | None]:
    """Shift along x and y of two patches, and the first blocker."""
    x, no_x = axis_shift(red.mean(0), blue.mean(0))
    y, no_y = axis_shift(red.mean(1), blue.mean(1))
    blocker = no_x or no_y
    return (None, None, blocker) if blocker else (x, y, None)


def patch_metrics(patches: DataFrame) -> DataFrame:
    """``patches``: id, width, samples. Returns id, acutance, contrast, luminance."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [measure(np.asarray(s, float).reshape(-1, w)) for s, w in zip(pdf["samples"], pdf["width"])]
            yield pd.DataFrame({"id": pdf["id"], "acutance": [r[0] for r in rows], "contrast": [r[1] for r in rows], "luminance": [r[2] for r in rows]})

    kind = patches.schema["id"].dataType.simpleString()
    return patches.select("id", "width", "samples").mapInPandas(work, f"id {kind}, acutance double, contrast double, luminance double")
