"""Column expressions over arrays of samples; all map-only and without Python workers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def null_text() -> Column:
    return F.lit(None).cast("string")



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def upto(n: Column | int) -> Column:
    """0 .. n-1; empty for 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def variance(values: Column, centre: Column) -> Column:
    """Population variance about a mean that has been computed already."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - centre) * (v - centre)) / F.size(values)


def gaussian(sigma: float) -> list[float]:
    """Normalised taps out to three sigmas, rounded down."""
    reach = int(3 * sigma)
    taps = [math.exp(-0.5 * (t / sigma) ** 2) for t in range(-reach, reach + 1)]
    return [t / sum(taps) for t in taps]


def blur_columns(samples: Column, width: Column | int, sigma: float) -> Column:
    """Along columns; taps outside the plane are dropped and not made up for."""
    taps = gaussian(sigma)
    reach = len(taps) // 2

    def at(i: Column) -> Column:
        parts = [F.coalesce(F.get(samples, i + (k - reach) * width), F.lit(0.0)) * F.lit(t) for k, t in enumerate(taps)]
        return sum(parts[1:], parts[0])

    return F.transform(upto(F.size(samples)), at)


def blur_rows(samples: Column, width: Column | int, sigma: float) -> Column:
    taps = gaussian(sigma)
    reach = len(taps) // 2
    width = F.lit(width) if isinstance(width, int) else width

    def at(i: Column) -> Column:
        x = i % width
        parts = []
        for k, t in enumerate(taps):
            d = k - reach
            inside = (x + d >= 0) & (x + d < width)
            parts.append(F.when(inside, F.coalesce(F.get(samples, i + d), F.lit(0.0)) * F.lit(t)).otherwise(F.lit(0.0)))
        return sum(parts[1:], parts[0])

    return F.transform(upto(F.size(samples)), at)


def finite(value: Column, name: str) -> Column:
    """``value``, or an error if it is NaN or infinite; null stays null."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast("double")).otherwise(value)


def positive(value: Column, name: str) -> Column:
    """``finite``, and above 0."""
    return F.when(value <= 0, F.raise_error(F.lit(f"{name} is not positive")).cast("double")).otherwise(finite(value, name))


def names(*pairs: tuple[Column, str]) -> Column:
    """Names whose condition holds, in the given order, joined by commas."""
    return F.concat_ws(",", *[F.when(cond, F.lit(name)) for cond, name in pairs])


def counts(*pairs: tuple[Column, str]) -> Column:
    """name:count of counts above zero, in the given order, joined by commas."""
    return F.concat_ws(",", *[F.when(n > 0, F.concat(F.lit(f"{name}:"), n.cast("string"))) for n, name in pairs])


#: Means of round steps often end in a 5 at the seventh decimal; this settles which way all engines round it.
NUDGE = 3.7e-10


def r6(value: Column) -> Column:
    """Rounded to 6 decimals, without negative zero."""
    return F.round(value + F.lit(NUDGE), 6) + F.lit(0.0)
