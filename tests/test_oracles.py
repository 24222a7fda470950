"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from stopwise.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(v[i] for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", [n for n in registry.NAMES if n in registry.ORACLES])
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(registry.ORACLES[name])
    assert got == rows([d[0] for d in want.description], want.fetchall())


def test_every_query_but_one_has_sql():
    assert set(registry.NAMES) - set(registry.ORACLES) == {"run_report_json"}


def test_report_documents(spark, sf_dir):
    import json

    found = registry.QUERIES["run_report_json"](spark, sf_dir).collect()
    verdicts = {r.run_id: r for r in registry.QUERIES["copy_assessment"](spark, sf_dir).collect()}
    assert len(found) == len(verdicts)
    # other queries, which have SQL
    of = lambda name: registry.QUERIES[name](spark, sf_dir).collect()
    shifts, pairs = {}, {}
    for x in of("ca_group"):
        shifts.setdefault((x.run_id, x.group_ord), {})[x.corner] = x
    for x in of("decentring_pairs"):
        pairs.setdefault((x.run_id, x.group_ord), {})[x.pair] = x
    bows = {(x.run_id, x.group_ord): x for x in of("distortion_group")}
    quality = {(x.run_id, x.group_ord): x for x in of("target_quality_group")}
    raw = {(x.run_id, x.group_ord): x for x in of("vignetting_group")}
    symmetry = {(x.run_id, x.group_ord): x for x in of("vignetting_symmetry")}
    names = lambda text: [b for b in text.split(",") if b]
    reasons = lambda text: [{"reason": r.split(":")[0], "count": int(r.split(":")[1])} for r in names(text)]

    def same(found, value, unit, method, *confidence):
        if value is None:
            return found is None
        want = ["value", "unit", "method", *["confidence"] * len(confidence)]
        return list(found) == want and found["value"] == pytest.approx(value, abs=2e-6) and (found["unit"], found["method"]) == (unit, method) and all(found["confidence"] == pytest.approx(c) for c in confidence)

    for r in found:
        doc = json.loads(r.report)
        assert list(doc) == ["schema_version", "tool_version", "inputs", "field_curvature", "copy_assessment", "groups"]
        copy, v = doc["copy_assessment"], verdicts[r.run_id]
        assert list(copy) == ["state", "method", "hard_support_eligible", "lens_model", "focal_length_mm", "included_aperture_groups", "evidence", "blockers", "reshoot"]
        assert (copy["state"], copy["blockers"], copy["included_aperture_groups"]) == (v.state, names(v.blockers), [float(x) for x in names(v.included)])
        gates = {k: g for k, g in copy["evidence"].items() if isinstance(g, dict) and "status" in g}
        assert list(gates) == ["target_quality", "correction_provenance", "aperture_series", "left_right_consistency", "field_curvature_counterevidence"]
        for gate, g in gates.items():
            assert g["blockers"] == names(v["gate_" + gate.replace("_counterevidence", "")]) and g["status"] == ("blocked" if g["blockers"] else "passed")
        assert same(copy["evidence"]["max_abs_pair_delta"], v.max_abs, "acutance_delta", "derived_from_measured_acutance")
        assert '"centred_threshold":0.08,"decentred_threshold":0.18' in r.report  # single precision, shortest form
        assert doc["field_curvature"]["method"] and all(s["lag_threshold_stops"] == 1.75 for s in doc["field_curvature"]["summaries"])
        assert [i["index"] for i in doc["inputs"]] == list(range(len(doc["inputs"]))) and all(i["path"] is None for i in doc["inputs"])  # nulls are written out
        firsts = [g["frames"][0]["input_index"] for g in doc["groups"]]
        assert firsts == sorted(firsts)
        assert sorted(f["input_index"] for g in doc["groups"] for f in g["frames"]) == list(range(len(doc["inputs"])))
        for g, first in zip(doc["groups"], firsts):
            key = (r.run_id, first)
            for name, x in g["decentring"]["left_right"].items():
                p = pairs[key][name]
                assert (x["id"], x["included_samples"], x["excluded_samples"], x["excluded"]) == (name, p.included, p.excluded, reasons(p.reasons))
                assert same(x["mean_delta"], p.mean_delta, "acutance_delta", "derived_from_measured_acutance")
            t, q = g["decentring"]["target_quality"], quality[key]
            assert (t["status"], t["assessed_frames"], t["blocked_frames"], t["blockers"]) == (q.status, q.assessed, q.blocked, names(q.blockers))
            assert same(t["keystone_pct"], q.keystone, "percent", "measured_periodic_reference_scale", 0.8) and (t["tilt_axis"] is None) == (q.keystone is None)
            for name, x in g["ca_lateral"].items():
                c = shifts[key][name]
                assert (x["included_samples"], x["excluded_samples"], x["blockers"], x["excluded"]) == (c.included, c.excluded, names(c.blockers), reasons(c.reasons))
                shift = x["mean_shift"] or dict.fromkeys(("x", "y", "magnitude"))
                assert all(same(shift[k], v, "px_fullres", "measured_channel_correlation", 1.0) for k, v in (("x", c.mean_x), ("y", c.mean_y), ("magnitude", c.magnitude)))
            d, b = g["distortion"], bows[key]
            assert (d["included_samples"], d["blockers"], d["excluded"]) == (b.included, names(b.blockers), reasons(b.reasons)) and d["excluded_samples"] == sum(x["count"] for x in d["excluded"])
            assert same(d["mean_bow"], b.mean_bow, "percent_frame", "measured_straight_line_bow", 0.9)
            y, s = g["vignetting"], symmetry[key]
            assert (y["included_samples"], y["excluded"]) == (raw[key].included, reasons(raw[key].reasons)) and y["symmetry"]["status"] == s.symmetry
            assert y["raw_corner_mean_stops"] is None or same(y["raw_corner_mean_stops"]["top_left"], raw[key].raw_tl, "stops", "measured_luminance_ratio")
            assert same(y["symmetry"]["max_corner_deviation_stops"], s.max_deviation, "stops", "derived_residual")
            for f in g["frames"]:
                eligible = doc["inputs"][f["input_index"]]["corrections"] == "confirmed_uncorrected"
                assert f["aggregation_eligible"] == eligible
                for z in f["measurements"]["sharpness"]["zones"].values():
                    assert z["acutance"]["confidence"] == float(eligible and z["texture_usable"]["value"]) and z["luminance"]["confidence"] == float(eligible)
                bent = f["measurements"]["distortion"]
                assert (bent["candidate"] is None) == bool(set(bent["blockers"]) - {"weak_reference_geometry"})
                assert bent["candidate"] is None or bent["candidate"]["bow"]["confidence"] == pytest.approx(0.4 if bent["blockers"] else 0.9)


def test_report_of_files(spark, sf_dir):
    """What files say of themselves reaches the document."""
    import json

    from stopwise.deploy import kept
    from stopwise.operators import evidence, frames, report, series
    from stopwise.sources import tables

    z = kept(frames.analyse_files(tables.painted_runs(spark, sf_dir).where("run_id = 4")), "frames")
    g = kept(evidence.groups(z), "groups")
    t, fc = evidence.target_quality(g), series.field_curvature(g)
    verdict = series.copy_assessment(series.copy_candidates(t), fc)
    docs = report.documents(verdict, fc, series.vignetting_series(evidence.vignetting(z, g)), evidence.decentring(g), evidence.colour_shift(z), evidence.bows(z), t, z)
    doc = json.loads(docs.first().report)
    assert doc["copy_assessment"]["state"] == "supports_centred" and doc["copy_assessment"]["hard_support_eligible"]
    assert [i["path"] for i in doc["inputs"]] == [f"/shots/4/{i}.dng" for i in range(8)] and doc["inputs"][0]["camera_make"] == "maker" and doc["inputs"][0]["source_kind"] == "rgb"
    assert [g["f_number"] for g in doc["groups"]] == [4.0, 5.6, 8.0, 11.0] and all(len(g["frames"]) == 2 for g in doc["groups"])
    frame = doc["groups"][0]["frames"][0]
    assert frame["qa"]["target"]["status"] == "passed" and frame["qa"]["target"]["tilt_axis"] in ("vertical", "horizontal") and frame["path"] == "/shots/4/0.dng"


def test_all_frames_of_a_run_are_not_sorted_for_the_report(spark, sf_dir):
    """They are one row, which passes by the tables it is joined with."""
    import re

    plan = registry.QUERIES["run_report_json"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+Join) \[run_id", plan)[:3] == ["ShuffledHashJoin"] * 3
