import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stopwise.operators import capture, contact, repeats, series


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 5)] * 4, st.integers(0, 3)), min_size=3, max_size=8))
def test_stable_subset_like_power_set(rows):
    values = [[0.03 * v for v in r[:4]] for r in rows]
    centres = [1 + 0.12 * r[4] for r in rows]
    stable = lambda s: all(round(max(values[i][k] for i in s) - min(values[i][k] for i in s), 9) <= 0.10 for k in range(4)) and round(math.log2(max(centres[i] for i in s)) - math.log2(min(centres[i] for i in s)), 9) <= 0.25
    every = tuple(range(len(rows)))
    found = [s for n in range(2, len(rows) + 1) for s in itertools.combinations(every, n) if stable(s)]
    want = every
    if found and not stable(every):
        most = max(map(len, found))
        want = min((s for s in found if len(s) == most), key=lambda s: (round(repeats.scatter_of(values, s), 9), sum(1 << i for i in s)))
    assert repeats.best_subset(values, centres)[0] == want


def test_many_repeats_are_all_kept():
    assert len(repeats.best_subset([[float(i)] * 4 for i in range(64)], [1.0] * 64)[0]) == 64


G = (
    "run_id long, group_ord long, lens_model string, focal_length_mm double, f_number double, n_unknown long, fc_n long, fc_low long,"
    "fc_centre double, fc_corner double, top_n long, top_low long, top_mean double, bottom_n long, bottom_low long, bottom_mean double, t_status string"
)


def group(run, order, f, top=0.0, bottom=0.0, centre=1.0, corner=1.0, lens="a", focal=50.0, n=3, unknown=0, low=0, status="passed"):
    return (run, order, lens, focal, f, unknown, n, low, centre, corner, n, low, top, n, low, bottom, status)


def verdicts(spark, rows):
    g = spark.createDataFrame(rows, G)
    return {r.run_id: r for r in series.copy_assessment(series.copy_candidates(g), series.field_curvature(g)).collect()}


def ladder(run, top, bottom, **k):
    peaks = ((5.6, 1.0, 0.8), (8.0, 2.0, 2.0), (11.0, 1.1, 1.0))
    return [group(run, i, f, top, bottom, c, e, **k) for i, (f, c, e) in enumerate(peaks)]


def test_states(spark):
    rows = [
        *ladder(1, 0.08, -0.08),
        *ladder(2, 0.2, 0.3),
        *ladder(3, 0.12, 0.3),
        *ladder(4, 0.2, -0.3),
        *ladder(5, 0.2, 0.2, lens=None),
        *ladder(6, 0.2, 0.2)[:2],
        group(6, 5, 8.0, lens="b"),
        group(7, 0, 8.0, 0.3, 0.3),
        *ladder(8, 0.3, 0.3, status="gated"),
        *ladder(9, 0.3, 0.3, n=1),
        *ladder(10, 0.3, 0.3, unknown=2),
        group(11, 0, 5.6, 0.3, 0.3, 2.0, 1.0), group(11, 1, 8.0, 0.3, 0.3, 1.0, 1.5), group(11, 2, 11.0, 0.3, 0.3, 0.5, 2.0),
        group(12, 0, 5.6, 0.3, 0.3, 2.0, 2.0), group(12, 1, 8.0, 0.3, 0.3, 1.99, 1.0),
        group(13, 0, None, 0.3, 0.3), *[(*r[:1], r[1] + 1, *r[2:]) for r in ladder(13, 0.3, 0.3)],
    ]
    got = verdicts(spark, rows)
    expect = {
        1: ("supports_centred", ""),
        2: ("supports_decentred", ""),
        3: ("inconclusive", "asymmetry_above_centred_threshold,asymmetry_below_decentred_threshold"),
        4: ("inconclusive", "inconsistent_asymmetry"),
        5: ("inconclusive", "missing_lens_focal_identity"),
        6: ("inconclusive", "mixed_lens_focal_identity"),
        7: ("inconclusive", "insufficient_aperture_series"),
        8: ("inconclusive", "target_quality_not_passed,insufficient_aperture_series"),
        9: ("inconclusive", "insufficient_samples,insufficient_aperture_series"),
        10: ("inconclusive", "unknown_corrections,insufficient_aperture_series"),
        11: ("inconclusive", "field_curvature_counterevidence"),
        12: ("inconclusive", "ambiguous_field_curvature"),
        13: ("inconclusive", "missing_aperture"),
    }
    assert {k: (v.state, v.blockers) for k, v in got.items()} == expect
    assert got[8].reshoot == "improve_target_alignment,add_aperture_ladder"
    assert got[4].reshoot == ""
    assert got[5].gate_field_curvature == "no_controlled_target_series"


def test_aperture_that_is_not_positive_raises(spark):
    with pytest.raises(Exception, match="not positive"):
        verdicts(spark, [group(1, 0, -1.0), group(1, 1, 8.0)])


def test_field_curvature_lag(spark):
    rows = [group(1, 0, 5.6, centre=3.0, corner=1.0), group(1, 1, 8.0, centre=2.0, corner=1.5), group(1, 2, 11.0, centre=1.0, corner=2.0)]
    r = series.field_curvature(spark.createDataFrame(rows, G)).first()
    assert r.status == "supported" and r.lag_stops == pytest.approx(2 * math.log2(11 / 5.6))


def test_capture_metadata(spark):
    df = spark.createDataFrame([("a/B.DNG",), ("x.TiFf",), ("n.jpg",), ("plain",)], "path string")
    ext, decoder = capture.dispatch(F.col("path"))
    assert [tuple(r) for r in df.select(ext, decoder).collect()] == [("dng", "raw"), ("tiff", "tiff"), ("jpg", "unsupported"), ("", "unsupported")]
    with pytest.raises(Exception, match="already corrected"):
        spark.range(1).select(capture.status(F.lit(True))).collect()


def test_contact_labels_and_png(spark, tmp_path):
    made = spark.range(1).select(contact.label(F.lit("/a/Blüte 7.dng"), F.lit(5.6)).alias("a"), contact.label(F.lit("x.tif"), F.lit(float("inf"))).alias("b"), contact.to_byte(F.lit(0.5)).alias("c")).first()
    assert tuple(made) == ("bl?te 7 f/5.6", "x", 128)
    tiles = spark.createDataFrame([(1, i, [i * 40] * (96 * 72), f"f {i}") for i in range(4)] + [(1, 4, [9, 90, 200] * (96 * 72), None)], "run_id long, input_index int, thumb array<int>, label string")
    made = contact.sheets(tiles, f"file://{tmp_path}/sheets").first()
    png = (tmp_path / "sheets" / made.uri.rpartition("/")[2]).read_bytes()
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[16:24] == (4 * 108).to_bytes(4, "big") + (2 * 96).to_bytes(4, "big") and made.bytes == len(png)
    out = tmp_path / "s.png"
    contact.check_output(str(out), ["in.dng"])
    contact.write_atomic(str(out), png)
    assert out.read_bytes() == png and {p.name for p in tmp_path.iterdir()} == {"s.png", "sheets"}
    with pytest.raises(ValueError):
        contact.check_output(str(out), [str(out)])
    with pytest.raises(ValueError):
        contact.check_output(str(tmp_path), [])


def test_sheets_have_labels_and_colour(spark):
    import numpy as np

    from stopwise.operators import glyphs

    image = contact.draw([(np.full(96 * 72, 50, np.uint8), "a/1"), (np.tile(np.array([9, 90, 200], np.uint8), 96 * 72), "é")])
    assert image.shape == (96, 216, 3) and image[0, 0].tolist() == [34, 37, 40]
    assert image[6, 6].tolist() == [50] * 3 and image[6, 108 + 6].tolist() == [9, 90, 200]
    band = (image[81:86, 6 : 6 + 12] == np.array([226, 230, 232])).all(2)
    assert ["".join(".#"[int(v)] for v in row) for row in band] == [".#....#..#..", "#.#...#.##..", "###..#...#..", "#.#.#....#..", "#.#.#...###."]
    assert (glyphs.raster("é") == glyphs.raster("?")).all() and glyphs.raster("").shape == (5, 0)
    planes = spark.createDataFrame([(1, [float(v) / 12 for v in range(12)]), (3, [float(v) / 36 for v in range(36)])], "components int, s array<double>")
    gray, colour = (r.t for r in planes.select(contact.display(F.col("s"), 4, 3, F.col("components")).alias("t")).collect())
    assert len(gray) == 96 * 72 and len(colour) == 3 * 96 * 72
    assert colour[:3] == [0, 7, 14] and colour[-3:] == [234, 241, 248] and gray[-1] == 234


def test_numbers_that_are_not_finite_raise_even_where_frames_are_left_out(spark, sf_dir):
    from stopwise.operators import evidence
    from stopwise.sources import tables

    good = tables.zone_values(tables.frames(spark, sf_dir)).where("run_id = 1")
    assert evidence.groups(good).count() > 0
    for column, run in (("ac_tl", evidence.groups), ("lum_centre", evidence.groups), ("keystone_pct", evidence.groups), ("cx_br", evidence.colour_shift), ("bow", evidence.bows)):
        for value in (float("nan"), float("-inf")):
            bad = good.withColumn("eligible", F.lit(False)).withColumn(column, F.when(F.col("input_index") == 0, value).otherwise(F.col(column)))
            with pytest.raises(Exception, match=f"not positive: {column}"):
                run(bad).select("frames" if run is evidence.groups else "run_id").collect()
    dark = spark.createDataFrame([(1.0, 0.0), (float("inf"), 1.0)], "a double, b double")
    for r in (0, 1):
        with pytest.raises(Exception, match="not positive|not finite"):
            dark.where("b = 0" if r == 0 else "b = 1").select(evidence.falloff(F.col("a"), F.col("b"))).collect()


def test_files_are_told_apart_and_cleaned(spark, tmp_path):
    import os

    from stopwise.sources import tiff

    assert [capture.decoder_of(p) for p in ("/a.b/x.TIF", "y.Dng", "/shots/z.tiff")] == ["tiff", "raw", "tiff"]
    for path in ("x.nef", "x.jpg", "/a.dng/plain", "x"):
        with pytest.raises(ValueError, match="unsupported"):
            capture.decoder_of(path)
    texts = spark.createDataFrame([(" a lens \0rest",), ("\0",), ("   ",), (None,), ("b",)], "t string")
    assert [r[0] for r in texts.select(capture.clean(F.col("t"))).collect()] == ["a lens", None, None, None, "b"]
    os.mkfifo(tmp_path / "pipe.tif")
    with pytest.raises(ValueError, match="not a regular file"):
        tiff.preflight([str(tmp_path / "pipe.tif")])
