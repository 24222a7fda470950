"""Frame evidence to group evidence: one pass of aggregation by (run, lens, focal length, aperture).

Null keys group together. A group's ordinal is the least input index of its frames. All families are
aggregated in one shuffle with map-side combine; no list of frames is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.functions.arrays import counts, names, positive
from stopwise.operators.repeats import best_subsets

KEYS = ["run_id", "lens_model", "focal_length_mm", "f_number"]
CORNERS = ("top_left", "top_right", "bottom_left", "bottom_right")
SHORT = ("tl", "tr", "bl", "br")
# Fixed values.
TEXTURED = 0.15
SCATTER_LIMIT, DRIFT_LIMIT = 0.10, 0.25
SEARCH_FROM, SEARCH_TO = 3, 63  # groups of a run have no upper bound


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def validated(frames: DataFrame, *columns: str) -> DataFrame:
    """``frames``, of which none may hold NaN or an infinite number in ``columns``, whether it is aggregated or not; luminances must be positive.

    The check is a filter that raises: it runs before anything is left out, and no optimisation drops it.
    """
    wrong = {c: F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | (F.lit(c.startswith("lum_")) & (F.col(c) <= 0)) for c in columns}
    listed = F.concat_ws(", ", *[F.when(bad, c) for c, bad in wrong.items()])
    return frames.where(F.when(listed != "", F.raise_error(F.concat(F.lit("not finite or not positive: "), listed)).cast("boolean")).otherwise(True))


def falloff(corner: Column, centre: Column) -> Column:
    """Stops by which a corner is darker than the centre; luminances that are not finite and positive raise."""
    return F.log2(positive(corner, "corner luminance") / positive(centre, "centre luminance"))


def groups(frames: DataFrame) -> DataFrame:
    """``frames``: evidence of frames (``frames.analyse``). One row a group with the sums every family needs."""
    ok = F.col("eligible")
    top = (F.col("co_tl") >= TEXTURED) & (F.col("co_tr") >= TEXTURED)
    bottom = (F.col("co_bl") >= TEXTURED) & (F.col("co_br") >= TEXTURED)
    all5 = top & bottom & (F.col("co_centre") >= TEXTURED)
    d_top, d_bottom = F.col("ac_tl") - F.col("ac_tr"), F.col("ac_bl") - F.col("ac_br")
    corner = (F.col("ac_tl") + F.col("ac_tr") + F.col("ac_bl") + F.col("ac_br")) / 4
    status, key = F.col("target_status"), F.col("keystone_pct")
    i = F.col("input_index")

    def strongest(which: str) -> Column:
        return F.max(F.when(ok & (status == which), F.struct(key.alias("k"), (-i).alias("i"), F.col("target_axis").alias("axis"))))

    zones = [f"{v}_{c}" for v in ("ac", "co") for c in ("centre", *SHORT)]
    df = validated(frames, *zones, *[f"fa_{c}" for c in SHORT], "lum_centre", "keystone_pct").groupBy(*KEYS).agg(
        F.min(i).alias("group_ord"),
        F.count(F.lit(1)).alias("frames"),
        count_if(ok).alias("n_ok"),
        count_if(~ok).alias("n_unknown"),
        *[
            x
            for name, cond, delta in (("top", top, d_top), ("bottom", bottom, d_bottom))
            for x in (
                count_if(ok & cond).alias(f"{name}_n"),
                count_if(ok & ~cond).alias(f"{name}_low"),
                F.avg(F.when(ok & cond, delta)).alias(f"{name}_mean"),
                F.stddev_samp(F.when(ok & cond, delta)).alias(f"{name}_scatter"),
            )
        ],
        count_if(ok & all5).alias("fc_n"),
        count_if(ok & ~all5).alias("fc_low"),
        F.avg(F.when(ok & all5, F.col("ac_centre"))).alias("fc_centre"),
        F.avg(F.when(ok & all5, corner)).alias("fc_corner"),
        F.min(F.when(ok, F.col("lum_centre"))).alias("lum_min"),
        F.max(F.when(ok, F.col("lum_centre"))).alias("lum_max"),
        *[F.avg(F.when(ok, F.col(f"fa_{c}"))).alias(f"raw_{c}") for c in SHORT],
        F.greatest(*[F.max(F.when(ok, F.col(f"fa_{c}"))) - F.min(F.when(ok, F.col(f"fa_{c}"))) for c in SHORT]).alias("range"),
        count_if(status.isin("passed", "gated")).alias("t_assessed"),
        count_if((status == "blocked") | (status.isin("passed", "gated") & ~ok)).alias("t_blocked"),
        *[count_if(ok & (status == which)).alias(f"t_n_{which}") for which in ("gated", "passed")],
        *[F.max(F.when(ok & (status == which), key)).alias(f"t_k_{which}") for which in ("gated", "passed")],
        *[strongest(which).alias(f"t_{which}") for which in ("gated", "passed")],
        *[first.alias(f"t_at_{n}") for n, first in target_marks(ok, status, i)],
    )
    return df.withColumn("drift", F.log2(F.col("lum_max") / F.col("lum_min")))


#: What a blocked target frame may say, beside the two that come from its group.
TARGET_BLOCKERS = ("profile_too_short", "low_contrast", "no_suitable_target_reference", "weak_target_geometry", "line_discontinuous", "ambiguous_tilt_axis")


def target_marks(ok: Column, status: Column, i: Column) -> list[tuple[str, Column]]:
    """For each blocker of a group's target the least (frame, place in the frame) that has it, as one number: structs can't be aggregated by hash."""
    listed = F.split(F.coalesce("target_blockers", F.lit("no_suitable_target_reference")), ",")
    at = lambda cond, place: F.min(F.when(cond, F.shiftleft(i.cast("long"), 16) + place))
    marks = [("unknown_corrections", at(~ok & status.isin("passed", "gated", "blocked"), F.lit(0))), ("keystone_above_threshold", at(ok & (status == "gated"), F.lit(1)))]
    for name in TARGET_BLOCKERS:
        place = F.array_position(listed, name)
        marks.append((name, at((status == "blocked") & (place > 0), place + 1)))
    return marks


def pair_blockers(name: str) -> Column:
    return names((F.col(f"{name}_n") < 2, "insufficient_samples"))


def decentring(g: DataFrame) -> DataFrame:
    """Two rows a group: pair, included, excluded, mean delta, scatter, reliability blockers, exclusions."""
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{name}_pair").alias("pair"),
                F.col(f"{name}_n").alias("included"),
                (F.col("n_unknown") + F.col(f"{name}_low")).alias("excluded"),
                F.col(f"{name}_mean").alias("mean_delta"),
                F.col(f"{name}_scatter").alias("scatter"),
                pair_blockers(name).alias("blockers"),
                counts((F.col("n_unknown"), "unknown_corrections"), (F.col(f"{name}_low"), "low_texture")).alias("reasons"),
            )
            for name in ("top", "bottom")
        ]
    )
    return g.withColumn("p", F.explode(rows)).select("run_id", "group_ord", "f_number", "p.*")


def target_quality(g: DataFrame) -> DataFrame:
    """Adds t_status and, where ``g`` has what they are made of, t_keystone, t_axis and t_blockers (in order of first appearance, then by the place in the frame's own list)."""
    status = (
        F.when(F.col("t_n_gated") > 0, "gated")
        .when(F.col("t_n_passed") > 0, "passed")
        .when(F.col("t_blocked") > 0, "blocked")
        .otherwise("not_assessed")
    )
    out = {"t_status": status}
    if "t_k_gated" in g.columns:
        out["t_keystone"] = F.coalesce("t_k_gated", "t_k_passed")
    if "t_gated" in g.columns:
        out["t_axis"] = F.coalesce("t_gated.axis", "t_passed.axis")
    every = [n for n in ("unknown_corrections", "keystone_above_threshold", *TARGET_BLOCKERS) if f"t_at_{n}" in g.columns]
    if every:
        seen = F.filter(F.array(*[F.struct(F.col(f"t_at_{n}").alias("at"), F.lit(n).alias("name")) for n in every]), lambda x: x["at"].isNotNull())
        out["t_blockers"] = F.concat_ws(",", F.transform(F.array_sort(seen), lambda x: x["name"]))
    return g.withColumns(out)


#: What can stand against a corner's colour shift, in the order in which it is listed.
SHIFT_BLOCKERS = ("low_texture", "flat_profile", "correlation_peak_not_found", "profile_too_short", "unsupported_colour_channels")


def colour_shift(frames: DataFrame) -> DataFrame:
    """Four rows a group: corner, included, excluded, means, scatter, blockers, exclusions.

    ``frames`` have for each corner cx_, cy_ and cb_, a comma-separated list of blockers that is null where there is a shift. Frames that aren't eligible count as unknown corrections,
    and of their blockers only unsupported channels are listed, without being counted.
    """
    ok = F.col("eligible")
    aggs = [F.min("input_index").alias("group_ord"), count_if(~ok).alias("unknown")]
    for c in SHORT:
        blocked, listed = F.col(f"cb_{c}").isNotNull(), F.split(f"cb_{c}", ",")
        for a in ("x", "y"):
            v = F.when(ok & ~blocked, F.col(f"c{a}_{c}"))
            aggs += [F.avg(v).alias(f"m{a}_{c}"), F.stddev_samp(v).alias(f"s{a}_{c}")]
        aggs += [count_if(ok & ~blocked).alias(f"n_{c}"), count_if(F.array_contains(listed, SHIFT_BLOCKERS[-1])).alias(f"any_{c}")]
        aggs += [count_if(ok & F.array_contains(listed, b)).alias(f"{b}_{c}") for b in SHIFT_BLOCKERS]
    g = validated(frames, *[f"c{a}_{c}" for a in ("x", "y") for c in SHORT]).groupBy(*KEYS).agg(*aggs)

    def corner(name: str, c: str) -> Column:
        found = [(F.col("unknown"), "unknown_corrections"), *[(F.col(f"{b}_{c}"), b) for b in SHIFT_BLOCKERS]]
        shown = [(n > 0, b) for n, b in found[:-1]] + [(F.col(f"any_{c}") > 0, SHIFT_BLOCKERS[-1])]
        return F.struct(
            F.lit(name).alias("corner"),
            F.col(f"n_{c}").alias("included"),
            sum((n for n, _ in found[1:]), found[0][0]).alias("excluded"),
            F.col(f"mx_{c}").alias("mean_x"),
            F.col(f"my_{c}").alias("mean_y"),
            F.hypot(f"mx_{c}", f"my_{c}").alias("magnitude"),
            F.col(f"sx_{c}").alias("scatter_x"),
            F.col(f"sy_{c}").alias("scatter_y"),
            F.hypot(f"sx_{c}", f"sy_{c}").alias("scatter"),
            names((F.col(f"n_{c}") < 2, "insufficient_samples"), *shown).alias("blockers"),
            counts(*found).alias("reasons"),
        )

    return g.withColumn("z", F.explode(F.array(*[corner(n, c) for n, c in zip(CORNERS, SHORT)]))).select("run_id", "group_ord", "f_number", "z.*")


def bows(frames: DataFrame) -> DataFrame:
    """One row a group: included, mean bow, scatter, blockers, exclusions."""
    ok, found = F.col("eligible"), F.col("bow_blocker").isNull()
    used = F.when(ok & found & F.col("bow_measured"), F.col("bow"))
    order = (("unknown", "unknown_corrections"), ("none", "no_straight_reference"), ("weak", "weak_reference_geometry"), ("broken", "line_discontinuous"))
    g = validated(frames, "bow").groupBy(*KEYS).agg(
        F.min("input_index").alias("group_ord"),
        F.count(used).alias("included"),
        F.avg(used).alias("mean_bow"),
        F.stddev_samp(used).alias("scatter"),
        count_if(~ok).alias("unknown"),
        count_if(ok & (F.col("bow_blocker") == "no_straight_reference")).alias("none"),
        count_if(ok & found & ~F.col("bow_measured")).alias("weak"),
        count_if(ok & (F.col("bow_blocker") == "line_discontinuous")).alias("broken"),
    )
    return g.select(
        "run_id", "group_ord", "f_number", "included", "mean_bow", "scatter",
        names((F.col("included") < 2, "insufficient_samples"), *[(F.col(c) > 0, n) for c, n in order]).alias("blockers"),
        counts(*[(F.col(c), n) for c, n in order]).alias("reasons"),
    )


def _search(by: list[str]):
    """Rows of groups one after another (``first`` marks where one begins) to the groups of which repeats are left out; a group may go on in the next batch."""
    names = [*by, "sel_n", "sel_scatter", *[f"sel_{c}" for c in SHORT]]

    def settle(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        values = np.stack([rows.column(f"fa_{c}").to_numpy() for c in SHORT], axis=1)
        n, scatter, means = best_subsets(values, rows.column("lum").to_numpy(), starts)
        some = np.flatnonzero(n < np.diff(starts))
        keys = [rows.column(c).take(pa.array(starts[some])).combine_chunks() for c in by]
        return pa.RecordBatch.from_arrays([*keys, pa.array(n[some]), pa.array(scatter[some]), *[pa.array(means[some, k]) for k in range(4)]], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            starts = np.flatnonzero(held.column("first").to_numpy())
            if len(starts) > 1:
                yield settle(held.slice(0, starts[-1]), starts)
                held = held.slice(starts[-1])
        if held is not None and len(held):
            yield settle(held, np.array([0, len(held)]))

    return work


def stable_repeats(samples: DataFrame, by: list[str], order: tuple[str, ...] = ("pos",), made: dict[str, Column] | None = None, most: int | None = SEARCH_TO) -> DataFrame:
    """``samples``: by.., the columns ``order``, fa_tl.., lum; ``made``: those of them that are made of a sample once it is in its place, so that narrow rows are dealt.

    Returns by.., sel_n, sel_scatter and means of the largest stable subset of each group of 3 to ``most`` repeats (None: of any number) of which something is left out. All repeats
    stay if all are stable or no two are. No list of repeats is built: rows are dealt and sorted by a window.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = samples.withColumns({"first": F.row_number().over(w) == 1, "_n": n}).where((F.col("_n") >= SEARCH_FROM) & (F.lit(most is None) | (F.col("_n") <= F.lit(most))))
    made = {c: F.col(c) for c in (*[f"fa_{c}" for c in SHORT], "lum")} | (made or {})
    keys = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in by)
    rows = placed.select(*by, "first", *[v.alias(c) for c, v in made.items()])
    return rows.mapInArrow(_search(by), f"{keys}, sel_n long, sel_scatter double, sel_tl double, sel_tr double, sel_bl double, sel_br double")


def unstable() -> Column:
    """Groups whose repeats are searched."""
    return (F.col("n_ok") >= SEARCH_FROM) & ((F.round("range", 9) > SCATTER_LIMIT) | (F.round("drift", 9) > DRIFT_LIMIT))


def vignetting(frames: DataFrame, g: DataFrame) -> DataFrame:
    """Adds sel_n, outliers, sel_scatter and stable means (raw_..) to groups; searches only where repeats are unstable."""
    # Joined by run alone: frames that are dealt by run stay where they are. A run's groups are few.
    todo = g.where(unstable()).groupBy(F.col("run_id").alias("k_run_id")).agg(F.collect_list(F.struct("group_ord", *KEYS[1:])).alias("todo"))
    same = lambda x: F.col("lens_model").eqNullSafe(x["lens_model"]) & F.col("focal_length_mm").eqNullSafe(x["focal_length_mm"]) & F.col("f_number").eqNullSafe(x["f_number"])
    samples = (
        frames.where("eligible").join(todo, F.col("run_id") == F.col("k_run_id"))
        .select("run_id", F.get(F.filter("todo", same), 0)["group_ord"].alias("group_ord"), F.col("input_index").alias("pos"), *[f"fa_{c}" for c in SHORT], F.col("lum_centre").alias("lum"))
        .where("group_ord IS NOT NULL")
    )
    chosen = stable_repeats(samples, ["run_id", "group_ord"], most=None)
    df = g.join(chosen, ["run_id", "group_ord"], "left")
    n = F.coalesce("sel_n", "n_ok")
    df = df.withColumn("v_n", n).withColumn("v_scatter", F.coalesce("sel_scatter", F.when(F.col("n_ok") >= 2, F.col("range")), F.lit(0.0)))
    df = df.withColumn("v_outliers", F.col("n_ok") - F.col("v_n"))
    for c in SHORT:
        df = df.withColumn(f"raw_{c}", F.coalesce(f"sel_{c}", f"raw_{c}"))
    return (
        df.withColumn(
            "v_blockers",
            names((F.col("v_n") == 0, "insufficient_aperture_series"), (F.col("n_unknown") > 0, "unknown_corrections"), (F.lit(True), "symmetry_not_assessed")),
        )
        .withColumn("v_warnings", names((F.col("v_outliers") > 0, "unstable_repeat_outlier_excluded")))
        .withColumn("v_reasons", counts((F.col("v_outliers"), "unstable_repeat_outlier"), (F.col("n_unknown"), "unknown_corrections")))
        .drop("sel_n", "sel_scatter", *[f"sel_{c}" for c in SHORT])
    )
