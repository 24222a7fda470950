"""From TIFF files to evidence and verdicts."""

import numpy as np
import pytest

from stopwise.operators import capture, colour_shift, frames, kernels, mosaic
from stopwise.plans import queries
from stopwise.sources import tables, tiff


def test_zone_rects_are_those_of_the_expressions(spark):
    sizes = [(1000, 800), (100, 100), (16, 16), (1, 1), (7392, 4950), (37, 201)]
    got = mosaic.zones(spark.createDataFrame(sizes, "width int, height int")).collect()
    assert len(got) == 5 * len(sizes)
    assert all(frames.zone_rects(r.width, r.height)[r.zone] == (r.x, r.y, r.w, r.h) for r in got)


def test_cut_stays_inside():
    plane = np.arange(12).reshape(3, 4)
    assert frames.cut(plane, (1, 1, 2, 2)).tolist() == [[5, 6], [9, 10]]
    for rect in ((3, 0, 2, 1), (0, 2, 1, 2), (-1, 0, 1, 1), (0, 0, 0, 1)):
        with pytest.raises(ValueError, match="not inside"):
            frames.cut(plane, rect)


def test_shift_like_the_expressions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(rng.random((20, 2, 13 * 11)))]
    rows += [(20, [0.5] * 143, rows[0][2]), (21, rows[0][1], rows[0][1])]
    for r in colour_shift.shifts(spark.createDataFrame(rows, "i int, red array<double>, blue array<double>"), 13, 11).collect():
        x, y, blocker = kernels.shift(*(np.array(v).reshape(11, 13) for v in (r.red, r.blue)))
        assert blocker == r.blocker
        assert blocker or (x == pytest.approx(r.shift_x, abs=1e-6) and y == pytest.approx(r.shift_y, abs=1e-6))


def test_files_of_a_folder(spark, tmp_path):
    """Painted truth through real files, one of them gray."""
    for i, kind in enumerate(tables.PAINTED):
        (tmp_path / f"{i}.tif").write_bytes(tiff.encode(tables.painted(kind, 1)))
    (tmp_path / "4.tif").write_bytes(tiff.encode(tables.painted("bow", -1)[:, :, 0]))
    got = {r.path[-5]: r for r in frames.frame_evidence(tiff.files(spark, str(tmp_path))).collect()}
    assert all(got["0"][f"fa_{c}"] == pytest.approx(-1, abs=1e-6) for c in ("tl", "tr", "bl", "br"))
    assert all(got["1"][f"cx_{c}"] == pytest.approx(1, abs=0.25) and got["1"][f"cy_{c}"] == pytest.approx(0, abs=0.25) for c in ("tl", "tr", "bl", "br"))
    assert got["2"].bow == pytest.approx(7.14, abs=0.8) and got["2"].bow_measured and got["2"].side == "top"
    assert got["3"].target_status == "gated" and got["3"].keystone_pct == pytest.approx(20)
    assert got["4"].bow == pytest.approx(-7.14, abs=0.8) and got["4"].cb_br == "unsupported_colour_channels"
    assert frames.frame_evidence(tiff.files(spark, str(tmp_path)).where("false")).count() == 0


def test_runs_from_files_reach_every_state(spark, sf_dir):
    states = {r.run_id: r.state for r in queries.analyse_runs(spark, sf_dir).collect()}
    assert states and all(s == ("supports_centred", "supports_decentred", "inconclusive", "inconclusive")[k % 4] for k, s in states.items())


def test_linear_colour_files(spark, tmp_path):
    """A DNG of linear colour is normalised by its levels, and its own metadata decides what becomes of it."""
    from stopwise.sources import dng

    image = tables.painted("vignetting", 1) // 2 + 1000
    (tmp_path / "0.dng").write_bytes(dng.encode(image, black=1000, white=40000, lens="a lens", f_number=(56, 10)))
    (tmp_path / "1.dng").write_bytes(dng.encode(image, black=1000, white=40000, opcodes=2))
    files = tiff.files(spark, str(tmp_path), "*.dng").select("path", "content")
    got = {r.path[-5]: r for r in frames.frame_evidence(files).collect()}
    assert all(got["0"][f"fa_{c}"] == pytest.approx(-1, abs=1e-3) for c in ("tl", "tr", "bl", "br"))
    assert (got["0"].lens_model, got["0"].f_number, got["0"].corrections_present, got["1"].corrections) == ("a lens", 5.6, False, "OpcodeList1,OpcodeList2")
    named = files.selectExpr("path", "content", "1L AS run_id", "0L AS input_index")
    assert frames.analyse_files(named.where("path LIKE '%0.dng'")).first().eligible
    with pytest.raises(Exception, match="already corrected"):
        frames.analyse_files(named).collect()


def test_every_file_is_decoded_once(spark, tmp_path):
    """However many sizes there are: the plan of the evidence reads the written table of measures, and decodes nothing."""
    for i, n in enumerate((96, 100, 130)):
        (tmp_path / f"{i}.tif").write_bytes(tiff.encode(np.indices((n, n)).sum(0) % 9 * 5000 + 100))
    found = frames.frame_evidence(tiff.files(spark, str(tmp_path)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 3 and "InArrow" not in plan and "InPandas" not in plan


def test_small_planes_are_too_short(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff.encode(np.indices((20, 40)).sum(0) * 900 + 100))
    r = frames.frame_evidence(tiff.files(spark, str(tmp_path))).first()
    assert (r.target_status, r.target_blockers) == ("blocked", "profile_too_short")


def test_folders_are_numbered_apart(spark):
    df = spark.createDataFrame([(p,) for p in ("/a/2.DNG", "/a/1.tif", "/b/0.tiff", "/a/x.jpg", "bare.dng")], "path string")
    assert sorted((r.path, r.input_index) for r in capture.folder_members(df).collect()) == [("/a/1.tif", 0), ("/a/2.DNG", 1), ("/b/0.tiff", 0), ("bare.dng", 0)]


def test_lags_of_a_profile_are_scored_at_once():
    import numpy as np

    from stopwise.operators import colour_shift, kernels

    rng = np.random.default_rng(3)
    for n in (2, 8, 11, 25, 90):
        red, blue = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
        blue[n // 2 :] = 0.5
        found = kernels.correlations(red, blue, 13)
        assert sorted(found) == list(range(-13, 14))
        for lag, score in found.items():
            a, b = red[max(0, lag) : n + min(0, lag)], blue[max(0, -lag) : n + min(0, -lag)]
            if n - abs(lag) < colour_shift.LEAST_LENGTH or min(((v - v.mean()) ** 2).sum() for v in (a, b)) <= colour_shift.LEAST_ENERGY:
                assert score is None
            else:
                assert abs(score - np.corrcoef(a, b)[0, 1]) < 2e-9


def test_blur_of_patches_narrower_than_its_reach():
    import numpy as np

    from stopwise.functions.arrays import gaussian
    from stopwise.operators import kernels

    for shape in ((1, 1), (3, 20), (20, 2), (17, 31)):
        plane = np.random.default_rng(1).uniform(0, 1, shape)
        for sigma in (1.0, 2.5):
            taps, want = np.array(gaussian(sigma)), plane
            for axis in (0, 1):
                reach = len(taps) // 2
                want = np.apply_along_axis(lambda v: np.convolve(v, taps, "full")[reach : reach + len(v)], axis, want)
            assert np.allclose(kernels.blur(plane, sigma), want, atol=1e-12)
