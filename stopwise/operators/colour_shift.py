"""Lateral colour shift between two planes of a zone, by correlation of their column and row profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.arrays import null_text, mean, total, upto, variance

# Fixed values.
LEAST_LENGTH = 5
LEAST_ENERGY = 1e-8
EPSILON = 1.1920929e-7


def column_profile(samples: Column, width: int, height: int) -> Column:
    return F.transform(upto(width), lambda x: total(F.transform(upto(height), lambda y: F.get(samples, y * width + x))) / height)


def row_profile(samples: Column, width: int, height: int) -> Column:
    return F.transform(upto(height), lambda y: total(F.slice(samples, y * width + 1, F.lit(width))) / width)


def window_of(n: int) -> int:
    return max(1, min(n // 4, 12))


def score(red: Column, blue: Column, lag: int, n: int) -> Column:
    """Pearson correlation of red[i] with blue[i - lag]; null for too few pairs or too little energy."""
    k = n - abs(lag)
    if k < LEAST_LENGTH:
        return F.lit(None).cast("double")
    a = F.slice(red, max(0, lag) + 1, k)
    b = F.slice(blue, max(0, -lag) + 1, k)
    # one pass of sums over centred pairs
    ma, mb = mean(a), mean(b)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    bound = F.transform(F.array(F.struct(ma.alias("a"), mb.alias("b"))), lambda m: F.aggregate(
        pairs,
        F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")),
        lambda s, p: F.struct(
            (s["xy"] + (p["x"] - m["a"]) * (p["y"] - m["b"])).alias("xy"),
            (s["xx"] + (p["x"] - m["a"]) * (p["x"] - m["a"])).alias("xx"),
            (s["yy"] + (p["y"] - m["b"]) * (p["y"] - m["b"])).alias("yy"),
        ),
        lambda s: F.when((s["xx"] > LEAST_ENERGY) & (s["yy"] > LEAST_ENERGY), s["xy"] / F.sqrt(s["xx"] * s["yy"])),
    ))
    return F.get(bound, 0)


def lag_scores(red: Column, blue: Column, n: int) -> Column:
    """Scores of lags one further out than the search window, as structs (lag, score)."""
    m = window_of(n) + 1
    return F.array(*[F.struct(F.lit(s).alias("lag"), F.round(score(red, blue, s, n), 9).alias("score")) for s in range(-m, m + 1)])


def axis_shift(df: DataFrame, red: str, blue: str, n: int, name: str) -> DataFrame:
    """Adds ``name`` (pixels, null if blocked) and ``name``_blocker for one axis."""
    m = window_of(n)
    if n < LEAST_LENGTH:
        return df.withColumn(name, F.lit(None).cast("double")).withColumn(f"{name}_blocker", F.lit("profile_too_short"))
    df = df.withColumn("_s", lag_scores(F.col(red), F.col(blue), n)).withColumn("_ma", mean(F.col(red))).withColumn("_mb", mean(F.col(blue)))
    flat = (variance(F.col(red), F.col("_ma")) < LEAST_ENERGY) | (variance(F.col(blue), F.col("_mb")) < LEAST_ENERGY)
    inside = F.filter("_s", lambda x: (F.abs(x["lag"]) <= m) & x["score"].isNotNull())
    best = F.array_max(F.transform(inside, lambda x: F.struct(x["score"].alias("score"), (-F.abs(x["lag"])).alias("near"), (-x["lag"]).alias("low"))))
    df = df.withColumn("_flat", flat).withColumn("_best", best)
    at = -F.col("_best.low")
    for side, d in (("_l", -1), ("_r", 1)):
        df = df.withColumn(side, F.get(F.col("_s"), at + d + m + 1)["score"])
    curve = F.col("_l") - 2 * F.col("_best.score") + F.col("_r")
    offset = F.when(F.abs(curve) > EPSILON, F.least(F.greatest(0.5 * (F.col("_l") - F.col("_r")) / F.when(F.abs(curve) > EPSILON, curve), F.lit(-0.5)), F.lit(0.5)))
    df = df.withColumn("_off", F.coalesce(offset, F.lit(0.0)))
    blocker = F.when(F.col("_flat"), "flat_profile").when(F.col("_best").isNull(), "correlation_peak_not_found")
    return (
        df.withColumn(f"{name}_blocker", blocker.otherwise(null_text()))
        .withColumn(name, F.when(F.col(f"{name}_blocker").isNull(), at + F.col("_off")))
        .drop("_s", "_ma", "_mb", "_flat", "_best", "_l", "_r", "_off")
    )


def shifts(pairs: DataFrame, width: int, height: int, scale: float = 1.0) -> DataFrame:
    """``pairs``: .., red, blue (arrays). Adds shift_x, shift_y, magnitude, blocker; x is looked at first."""
    df = pairs
    for plane in ("red", "blue"):
        df = df.withColumn(f"{plane}_cols", column_profile(F.col(plane), width, height)).withColumn(f"{plane}_rows", row_profile(F.col(plane), width, height))
    df = axis_shift(df, "red_cols", "blue_cols", width, "x")
    df = axis_shift(df, "red_rows", "blue_rows", height, "y")
    blocker = F.coalesce("x_blocker", "y_blocker")
    ok = blocker.isNull()
    return (
        df.withColumn("blocker", blocker)
        .withColumn("shift_x", F.when(ok, F.col("x") * scale))
        .withColumn("shift_y", F.when(ok, F.col("y") * scale))
        .withColumn("magnitude", F.hypot("shift_x", "shift_y"))
        .select(*pairs.columns, "shift_x", "shift_y", "magnitude", "blocker")
    )
