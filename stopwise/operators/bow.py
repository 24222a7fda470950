"""Straight-line bow of a plane: traces, quadratic fits and the choice of the best candidate.

Traces come from ``planes``, as points in a column of each plane; fits aggregate a trace's points, at most one for each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.arrays import mean, names
from stopwise.operators.planes import LEAST_CONTRAST, SIDE, gathered

# Fixed values.
MOST_GAP = 0.08
LEAST_SPAN, MEASURED_SPAN = 0.25, 0.72
MOST_RESIDUAL = 1.0
LEAST_SIZE = 16
BLOCKERS = ("low_contrast", "line_discontinuous", "profile_too_short", "fit_residual_too_high")


def exploded(found: DataFrame) -> DataFrame:
    """Rows run_id, width, height, cand (0 to 11), orientation, major, minor, contrast of planes with ``points``."""
    rows = found.select("run_id", "width", "height", F.inline("points"))
    return rows.withColumn("orientation", F.when(F.col("cand") < 6, "horizontal").otherwise("vertical"))


def trace_points(rows: DataFrame) -> DataFrame:
    """``exploded`` points of planes given as rows (run_id, y, samples): weighted centres of what a line crosses."""
    return exploded(gathered(rows, True))


def fits(points: DataFrame) -> DataFrame:
    """One row a trace: run_id, width, height, cand, orientation, n, contrast, gap, first, last, their minors, mean minor, mid, c0, c1, c2, residual.

    The fit is y = c0 + c1 u + c2 u^2 with u the distance from the mean major position. A trace has at most
    one point for each line of its plane, so it is one array, and all but its gathering is map-only. Fewer
    than three positions give null coefficients; the caller raises if such a trace would be fitted.
    """
    key = ["run_id", "width", "height", "cand", "orientation"]
    df = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("major", "minor", "contrast"))).alias("p"))
    n, head, tail = F.size("p"), F.get("p", 0), F.element_at("p", -1)
    steps = F.zip_with(F.slice("p", 1, n - 1), F.slice("p", 2, n - 1), lambda x, y: y["major"] - x["major"] - 1)
    df = df.select(
        *key, "p", n.cast("long").alias("n"), mean(F.transform("p", lambda x: x["contrast"])).alias("contrast"),
        F.coalesce(F.when(n > 1, F.array_max(steps)), F.lit(0)).alias("gap"),
        head["major"].alias("first"), tail["major"].alias("last"), head["minor"].alias("first_minor"), tail["minor"].alias("last_minor"),
        mean(F.transform("p", lambda x: x["minor"])).alias("mean_minor"), mean(F.transform("p", lambda x: x["major"].cast("double"))).alias("mid"),
    )
    names_ = ("s2", "s3", "s4", "t0", "t1", "t2")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in names_])

    def add(s: Column, x: Column) -> Column:
        u, y = x["major"] - F.col("mid"), x["minor"]
        more = (u * u, u * u * u, u * u * u * u, y, u * y, u * u * y)
        return F.struct(*[(s[c] + v).alias(c) for c, v in zip(names_, more)])

    df = df.withColumn("s", F.aggregate("p", zero, add))
    s2, s3, s4, t0, t1, t2 = (F.col(f"s.{c}") for c in names_)
    s0 = F.col("n").cast("double")
    # The sum of u is zero, which leaves a 3 x 3 system that Cramer's rule solves.
    df = df.withColumn("det", s0 * (s2 * s4 - s3 * s3) - s2 * s2 * s2)
    safe = F.when((s0 >= 3) & (F.abs("det") > 1e-9), F.col("det"))
    df = (
        df.withColumn("c0", (t0 * (s2 * s4 - s3 * s3) + s2 * (t1 * s3 - s2 * t2)) / safe)
        .withColumn("c1", (s0 * (t1 * s4 - s3 * t2) - s2 * (t1 * s2 - t0 * s3)) / safe)
        .withColumn("c2", (s0 * (s2 * t2 - t1 * s3) - s2 * s2 * t0) / safe)
    )

    def error(x: Column) -> Column:
        u = x["major"] - F.col("mid")
        return x["minor"] - (F.col("c0") + F.col("c1") * u + F.col("c2") * u * u)

    squares = F.aggregate("p", F.lit(0.0), lambda s, x: s + error(x) * error(x))
    return df.withColumn("residual", F.sqrt(squares / s0)).drop("p", "s", "det")


def candidates(points: DataFrame) -> DataFrame:
    """Adds to each trace's fit: span, bow (percent), sagitta, side, eligible, blocker."""
    horizontal = F.col("orientation") == "horizontal"
    major, minor = F.when(horizontal, F.col("width")).otherwise(F.col("height")), F.when(horizontal, F.col("height")).otherwise(F.col("width"))
    df = fits(points).withColumn("major_len", major).withColumn("minor_len", minor)
    df = df.withColumn("span", (F.col("last") - F.col("first") + 1) / F.col("major_len"))
    most = F.greatest(F.ceil(F.col("major_len") * MOST_GAP), F.lit(1))
    early = (
        F.when(F.col("contrast") < LEAST_CONTRAST, "low_contrast")
        .when(F.col("gap") > most, "line_discontinuous")
        .when(F.col("span") < LEAST_SPAN, "profile_too_short")
    )
    singular = F.col("c0").isNull() & early.isNull()
    df = df.withColumn("early", early).withColumn(
        "residual", F.when(singular, F.raise_error(F.lit("a trace has fewer than three positions")).cast("double")).otherwise(F.col("residual"))
    )
    df = df.withColumn("blocker", F.coalesce("early", F.when(F.col("residual") > MOST_RESIDUAL, "fit_residual_too_high")))
    u = (F.col("first") + F.col("last")) * 0.5 - F.col("mid")
    chord = (F.col("first_minor") + F.col("last_minor")) * 0.5
    raw = F.col("c0") + F.col("c1") * u + F.col("c2") * u * u - chord
    low, high = F.col("mean_minor") < F.col("minor_len") * SIDE, F.col("mean_minor") > F.col("minor_len") * (1 - SIDE)
    side = F.when(low, F.when(horizontal, "top").otherwise("left")).when(high, F.when(horizontal, "bottom").otherwise("right"))
    df = df.withColumn("side", side).withColumn("sagitta", F.when(F.col("side").isin("top", "left"), -raw).otherwise(raw))
    df = df.withColumn("bow", F.col("sagitta") / F.col("minor_len") * 100)
    return df.withColumn("eligible", F.col("blocker").isNull() & (F.col("span") >= MEASURED_SPAN) & F.col("side").isNotNull())


def plane_bows(rows: DataFrame) -> DataFrame:
    """One row a plane: run_id, method, orientation, side, bow, sagitta, span, residual, confidence, blockers; planes as rows (run_id, y, samples)."""
    return point_bows(gathered(rows, True))


def point_bows(found: DataFrame) -> DataFrame:
    """``plane_bows`` of planes with their size and ``points``; those with fewer than 16 rows or columns are too short."""
    short = F.least("width", "height") < LEAST_SIZE
    every = found.select("run_id", short.alias("short"))
    c = candidates(exploded(found.where(~short)))
    # Ranks are told apart at 9 decimals, ties go by trace order.
    rank = F.struct(F.col("eligible").cast("int").alias("e"), F.round("span", 9).alias("s"), F.round(F.abs("bow"), 9).alias("b"), (-F.col("cand")).alias("c"))
    best = c.groupBy("run_id").agg(
        F.max_by(F.struct("orientation", "side", "bow", "sagitta", "span", "residual", "eligible"), F.when(F.col("blocker").isNull(), rank)).alias("best"),
        F.max(F.col("blocker").isNull()).alias("fitted"),
        *[F.min(F.when(F.col("blocker") == b, F.col("cand"))).alias(b) for b in BLOCKERS],
    )
    found = F.coalesce("fitted", F.lit(False))
    order = F.array_sort(F.filter(F.array(*[F.struct(F.col(b).alias("at"), F.lit(b).alias("name")) for b in BLOCKERS]), lambda x: x["at"].isNotNull()))
    listed = F.concat_ws(",", F.transform(order, lambda x: x["name"]))
    eligible = F.col("best.eligible")
    out = every.join(best, "run_id", "left")
    get = lambda n: F.when(found, F.col(f"best.{n}"))
    return out.select(
        "run_id",
        F.when(found, F.when(eligible, "measured_straight_line_bow").otherwise("inferred_weak_reference_bow")).alias("method"),
        *[get(n).alias(n) for n in ("orientation", "side", "bow", "sagitta", "span", "residual")],
        F.when(found, F.when(eligible, 0.9).otherwise(0.4)).alias("confidence"),
        F.when(found, names((~eligible, "weak_reference_geometry"))).otherwise(F.when(F.col("short"), "profile_too_short").when(listed == "", "no_straight_reference").otherwise(listed)).alias("blockers"),
    )
