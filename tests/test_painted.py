"""Planes painted with known truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.operators import bow, colour_shift, kernels, mosaic, sharpness, target


def patch(spark, plane):
    return spark.createDataFrame([(0, [float(v) for v in plane.ravel()])], "vec_id int, samples array<double>")


def plane_rows(spark, planes):
    return spark.createDataFrame([(i, y, [float(v) for v in row]) for i, p in enumerate(planes) for y, row in enumerate(p)], "run_id long, y int, samples array<double>")


def ramp():
    return np.arange(225).reshape(15, 15) / 224


def impulse(at):
    p = np.zeros((15, 15))
    p[at] = 1
    return p + 1e-12


@pytest.mark.parametrize(
    ("plane", "acutance", "contrast"),
    [
        (ramp(), 1.069431, 0.579922),
        (np.indices((16, 16)).sum(0) % 2 * 1.0, 11.247479, 1.0),
        (np.eye(15), 3.136893, 3.741657),
        (impulse((7, 7)), 3.965870, None),
        (impulse((0, 0)), 4.857302, None),
    ],
)
def test_sharpness(spark, plane, acutance, contrast):
    df = patch(spark, plane)
    width = plane.shape[1]
    blurred = sharpness.spread(sharpness.blurs(df, width), "samples", "sd").first()
    fine, coarse = np.array(blurred.fine), np.array(blurred.coarse)
    got = (plane.ravel() - fine).std() / (fine - coarse).std()
    assert got == pytest.approx(acutance, abs=2e-5)
    assert np.allclose(kernels.blur(plane, 1.0).ravel(), fine) and np.allclose(kernels.blur(plane, 2.5).ravel(), coarse)
    if contrast is not None:
        assert blurred.sd / plane.mean() == pytest.approx(contrast, abs=2e-5)


def test_expressions_and_kernel_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.random(12 * 9) + 0.1]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id int, samples array<double>")
    a = {r.vec_id: r for r in sharpness.patch_metrics(df, 12).collect()}
    b = {r.id: r for r in kernels.patch_metrics(df.select(F.col("vec_id").alias("id"), F.lit(12).alias("width"), "samples")).collect()}
    for i in a:
        for c in ("acutance", "contrast", "luminance"):
            assert a[i][c] == pytest.approx(b[i][c], abs=1e-9)


def test_dark_patch_raises(spark):
    with pytest.raises(Exception, match="not positive"):
        sharpness.patch_metrics(patch(spark, np.zeros((5, 5))), 5).collect()


def texture(shift):
    y, x = np.indices((24, 24))
    value = lambda x, y: np.sin(0.37 * x) + np.cos(0.23 * y) + 0.01 * x + 0.02 * y
    return value(np.where(x >= shift, x - shift, x), y), value(x, y)


def test_colour_shift(spark):
    red, blue = texture(2)
    pair = spark.createDataFrame([([float(v) for v in red.ravel()], [float(v) for v in blue.ravel()])], "red array<double>, blue array<double>")
    r = colour_shift.shifts(pair, 24, 24).first()
    assert r.shift_x == pytest.approx(2.0083, abs=5e-3) and r.shift_y == pytest.approx(0, abs=0.1) and r.blocker is None
    flat = spark.createDataFrame([([0.5] * 576, [0.5] * 576)], "red array<double>, blue array<double>")
    r = colour_shift.shifts(flat, 24, 24).first()
    assert r.blocker == "flat_profile" and r.shift_x is None


def line(w, h, place, sag, vertical=False, dark=True, span=None):
    p = np.full((h, w), 0.85 if dark else 0.05)
    n, m = (h, w) if vertical else (w, h)
    for a in range(*(span or (0, n))):
        t = a / (n - 1)
        for b in range(m):
            if abs(b - (place + 4 * sag * t * (1 - t))) <= 1:
                p[(a, b) if vertical else (b, a)] = 0.05 if dark else 0.85
    return p


@pytest.mark.parametrize(
    ("plane", "side", "value", "method"),
    [
        (line(80, 50, 8, -4), "top", 7.556, "measured_straight_line_bow"),
        (line(80, 50, 8, -4, dark=False), "top", 7.556, "measured_straight_line_bow"),
        (line(60, 80, 50, 3, vertical=True), "right", 4.557, "measured_straight_line_bow"),
        (line(80, 50, 25, 3), None, 5.468, "inferred_weak_reference_bow"),
        (line(100, 70, 12, -5), "top", 6.836, "measured_straight_line_bow"),
    ],
)
def test_bow(spark, plane, side, value, method):
    r = bow.plane_bows(plane_rows(spark, [plane])).first()
    assert (r.side, r.method) == (side, method)
    assert r.bow == pytest.approx(value, abs=0.01)


def test_bow_blockers(spark):
    flat = np.full((50, 80), 0.5)
    broken = line(80, 50, 8, 0)
    broken[:, 20:50] = 0.85
    short = line(80, 50, 8, 0, span=(30, 44))
    got = {r.run_id: r for r in bow.plane_bows(plane_rows(spark, [flat, broken, short])).collect()}
    assert got[0].blockers == "no_straight_reference" and got[0].bow is None
    assert "line_discontinuous" in got[1].blockers.split(",")
    assert "profile_too_short" in got[2].blockers.split(",")
    assert bow.plane_bows(plane_rows(spark, [np.zeros((8, 8))])).first().blockers == "profile_too_short"


def courses(p1, p2):
    y, x = np.indices((96, 96))
    return np.where(y % np.where(y < 48, p1, p2) < 3, 0.05, 0.85 + (x % 3) * 0.01)


def test_target(spark):
    planes = [courses(12, 16), courses(12, 12), np.full((96, 96), 0.5)]
    got = {r.run_id: r for r in target.decide(target.keystones(target.runs(plane_rows(spark, planes)))).collect()}
    assert (got[0].status, got[0].axis) == ("gated", "vertical") and got[0].keystone == pytest.approx(20.0, abs=1e-6)
    assert got[1].status == "passed" and got[1].keystone == pytest.approx(0, abs=1e-9)
    assert (got[2].status, got[2].blockers) == ("blocked", "low_contrast")


def test_zones_and_projection(spark):
    df = spark.createDataFrame([(1, 1000, 800)], "id int, width int, height int")
    z = {r.zone: (r.x, r.y, r.w, r.h) for r in mosaic.zones(df).collect()}
    assert z["centre"] == (435, 348, 130, 104) and z["top_left"] == (45, 36, 130, 104) and z["bottom_right"] == (825, 660, 130, 104)
    (x, w), (y, h) = mosaic.project(F.lit(45), F.lit(130), F.lit(1)), mosaic.project(F.lit(36), F.lit(104), F.lit(0))
    assert tuple(spark.range(1).select(x, y, w, h).first()) == (22, 18, 65, 52)
