"""Sensor mosaics: zones, level normalisation, green extraction, red and blue interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.arrays import let, upto

# Sensor patterns, their phases, and luma weights.
PATTERNS = ("RGGB", "BGGR", "GBRG", "GRBG")
#: Column and row of the first green, the red and the blue sample of a 2 x 2 cell.
GREEN = {"RGGB": (1, 0), "BGGR": (1, 0), "GBRG": (0, 0), "GRBG": (0, 0)}
RED = {"RGGB": (0, 0), "BGGR": (1, 1), "GBRG": (0, 1), "GRBG": (1, 0)}
BLUE = {"RGGB": (1, 1), "BGGR": (0, 0), "GBRG": (1, 0), "GRBG": (0, 1)}
LUMA = (0.2126, 0.7152, 0.0722)


def phase(pattern: Column, table: dict[str, tuple[int, int]]) -> tuple[Column, Column]:
    x = y = F.lit(None).cast("int")
    for name, (px, py) in table.items():
        x, y = F.when(pattern == name, px).otherwise(x), F.when(pattern == name, py).otherwise(y)
    return x, y


def scaled(length: Column, num: int, den: int) -> Column:
    """length * num / den, rounded half up and held to 1 .. length."""
    part = F.floor((length * num + den // 2) / den).cast("int")
    return F.least(F.greatest(part, F.lit(1)), length)


def zones(frames: DataFrame) -> DataFrame:
    """Five rows for each (.., width, height): zone, x, y, w, h."""
    w, h = F.col("width"), F.col("height")
    pw, ph, ix, iy = scaled(w, 13, 100), scaled(h, 13, 100), scaled(w, 45, 1000), scaled(h, 45, 1000)
    right, low = F.greatest(w - ix - pw, F.lit(0)), F.greatest(h - iy - ph, F.lit(0))
    cx, cy = F.floor((w - pw) / 2).cast("int"), F.floor((h - ph) / 2).cast("int")
    places = (("centre", cx, cy), ("top_left", ix, iy), ("top_right", right, iy), ("bottom_left", ix, low), ("bottom_right", right, low))
    rows = F.array(*[F.struct(F.lit(n).alias("zone"), x.cast("int").alias("x"), y.cast("int").alias("y"), pw.alias("w"), ph.alias("h")) for n, x, y in places])
    return frames.withColumn("_z", F.explode(rows)).select(*frames.columns, "_z.*")


def project(start: Column, size: Column, first: Column) -> tuple[Column, Column]:
    """Start and length of a range on the grid of every second sample from ``first`` on."""
    at = F.when((start % 2) == (first % 2), start).otherwise(start + 1)
    at = F.greatest(at, first)
    length = F.floor((start + size - 1 - at) / 2).cast("int") + 1
    return F.floor((at - first) / 2).cast("int"), length


def normalise(samples: Column, black: Column, white: Column) -> Column:
    """(s - black) / (white - black) by component; levels are arrays of one or of all components."""
    n = F.size(black)
    return F.transform(samples, lambda s, i: (s - F.get(black, i % n)) / (F.get(white, i % n) - F.get(black, i % n)))


def green(samples: Column, width: int, height: int, pattern: Column, black: Column, white: Column) -> Column:
    """The first green phase at half size, normalised by that phase's levels (arrays of four)."""
    px, py = phase(pattern, GREEN)
    half = F.floor((F.lit(width) - px - 1) / 2).cast("int") + 1
    rows = F.floor((F.lit(height) - py - 1) / 2).cast("int") + 1
    b, w = F.get(black, py * 2 + px), F.get(white, py * 2 + px)

    def at(i: Column) -> Column:
        x, y = px + (i % half) * 2, py + F.floor(i / half).cast("int") * 2
        return (F.get(samples, y * width + x) - b) / (w - b)

    return F.transform(upto(half * rows), at)


def interpolate(samples: Column, width: int, height: int, pattern: Column, black: Column, white: Column, table: dict) -> Column:
    """One colour at full size: its own samples, elsewhere the mean of neighbours of that colour."""
    px, py = phase(pattern, table)
    b, w = F.get(black, py * 2 + px), F.get(white, py * 2 + px)

    def at(i: Column) -> Column:
        x, y = i % width, F.floor(i / width).cast("int")
        same_x, same_y = (x % 2) == px, (y % 2) == py
        sums, n = F.lit(0.0), F.lit(0)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                wanted = (F.lit(dx == 0) == same_x) & (F.lit(dy == 0) == same_y)
                inside = (x + dx >= 0) & (x + dx < width) & (y + dy >= 0) & (y + dy < height)
                use = wanted & inside
                sums = sums + F.when(use, F.coalesce(F.get(samples, i + dy * width + dx), F.lit(0.0))).otherwise(F.lit(0.0))
                n = n + F.when(use, 1).otherwise(0)
        return (sums / n - b) / (w - b)

    return F.transform(upto(width * height), at)


def luma(samples: Column, components: int) -> Column:
    if components == 1:
        return samples
    take = [F.lit(x) for x in LUMA]
    return F.transform(
        upto(F.floor(F.size(samples) / 3).cast("int")),
        lambda i: F.get(samples, i * 3) * take[0] + F.get(samples, i * 3 + 1) * take[1] + F.get(samples, i * 3 + 2) * take[2],
    )


def channel(samples: Column, which: int) -> Column:
    return F.transform(upto(F.floor(F.size(samples) / 3).cast("int")), lambda i: F.get(samples, i * 3 + which))


#: Below this the two green phases of a decoded mosaic don't show one picture.
LEAST_GREEN = 0.9


def green_correlation(samples: Column, width: int, height: int, pattern: Column) -> Column:
    """Pearson correlation of the two green samples of each whole cell; null where either doesn't vary."""
    px, py = phase(pattern, GREEN)
    cells = F.sequence(F.lit(0), F.lit((width // 2) * (height // 2) - 1))

    def pair(k: Column) -> Column:
        x, y = (k % (width // 2)) * 2, F.floor(k / (width // 2)).cast("int") * 2
        return F.struct(F.get(samples, (y + py) * width + x + px).alias("a"), F.get(samples, (y + 1 - py) * width + x + 1 - px).alias("b"))

    def correlated(p: Column) -> Column:
        total = lambda f: F.aggregate(p, F.lit(0.0), lambda s, v: s + f(v))
        n = F.size(p)

        def about(m: Column) -> Column:
            a, b = (lambda v: v["a"] - m["a"]), (lambda v: v["b"] - m["b"])
            energy = total(lambda v: a(v) * a(v)) * total(lambda v: b(v) * b(v))
            return total(lambda v: a(v) * b(v)) / F.sqrt(F.when(energy > 0, energy))

        return let(F.struct((total(lambda v: v["a"]) / n).alias("a"), (total(lambda v: v["b"]) / n).alias("b")), about)

    return let(F.transform(cells, pair), correlated)


def checked_green(samples: Column, width: int, height: int, pattern: Column, least: float = LEAST_GREEN) -> Column:
    """``green_correlation`` as a self-test of a decoder: raises below ``least``, and where there is nothing to correlate."""

    def test(c: Column) -> Column:
        return F.when(c >= least, c).otherwise(F.raise_error(F.format_string("the green phases of a mosaic correlate by %s only", c.cast("string"))).cast("double"))

    return let(green_correlation(samples, width, height, pattern), test)


def top_centre_falloff(rows: DataFrame, width: int, height: int) -> DataFrame:
    """run_id, top_left, top_right in stops against the middle of the top, of planes as rows (run_id, y, samples): sky that darkens downwards doesn't count.

    Patches of a tenth of the sides, a 25th away from the edges. A median that is not positive raises.
    """
    from stopwise.operators.sharpness import median

    w, h, left, top = width // 10, height // 10, width // 25, height // 25
    starts = {"left": left, "middle": width // 2 - w // 2, "right": width - left - w}
    sizes = {"left": w, "middle": w // 2 * 2, "right": w}
    inside = rows.where((F.col("y") >= top) & (F.col("y") < top + h))
    patch = lambda n: F.flatten(F.collect_list(F.slice("samples", starts[n] + 1, sizes[n]))).alias(n)
    found = inside.groupBy("run_id").agg(*[patch(n) for n in starts])
    found = found.select("run_id", *[median(F.array_sort(n)).alias(n) for n in starts])
    least = F.least(*starts)
    stops = lambda n: F.when(least > 0, F.log2(F.col(n) / F.col("middle"))).otherwise(F.raise_error(F.lit("median luminance is not positive")).cast("double"))
    return found.select("run_id", stops("left").alias("top_left"), stops("right").alias("top_right"))
