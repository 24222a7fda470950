"""What must not grow with the tables: plans that read frames once, and rows that are dealt before they are large."""

from stopwise.plans import registry
from stopwise.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_verdicts_read_groups_that_were_made_once(spark, sf_dir):
    for name in ("copy_assessment", "reshoot_actions", "field_curvature"):
        assert "Window" not in plan(registry.QUERIES[name](spark, sf_dir)), name


def test_repeats_join_by_run_alone(spark, sf_dir):
    from stopwise.operators import evidence

    z = tables.zone_values(tables.frames(spark, sf_dir))
    joins = [x for x in plan(evidence.vignetting(z, evidence.groups(z))).splitlines() if "Join Inner" in x]
    assert joins and all("k_lens_model" not in x for x in joins)


def test_a_report_shuffles_no_objects(spark, sf_dir):
    exchanged = [x for x in plan(registry.QUERIES["run_report_json"](spark, sf_dir)).splitlines() if "collect_list" in x and "texture_usable" in x]
    assert not exchanged


def test_planes_are_dealt_before_they_are_made(spark, sf_dir):
    for rows, name in ((tables.courses, "target_runs"), (tables.bowed_lines, "trace_points")):
        assert rows(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert physical(registry.QUERIES[name](spark, sf_dir))[1].count("Exchange hashpartitioning") == 1


def test_painted_files_come_in_small_batches(spark, sf_dir):
    import pandas as pd

    assert [len(x) for x in tables.few([pd.DataFrame({"a": range(70)})])] == [32, 32, 6]
    runs, known = tables.painted_runs(spark, sf_dir), tables.painted_captures(spark, sf_dir)
    assert "MapInPandas" not in plan(known)
    assert sorted(known.select("path", "run_id", "input_index").collect()) == sorted(runs.select("path", "run_id", "input_index").collect())


def test_only_searched_runs_are_dealt_again(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    from stopwise.deploy import kept
    from stopwise.operators import evidence
    from stopwise.plans import queries

    rows = kept(tables.numbered(spark, sf_dir), "frames")
    g = kept(evidence.groups(tables.zone_values(tables.framed(rows))).select(*queries.FOR_VIGNETTING), "groups")
    runs = {r.run_id for r in g.where(evidence.unstable()).select("run_id").collect()}
    dealt = queries.searched_frames(rows, g)
    assert {r.run_id for r in dealt.select("run_id").distinct().collect()} == runs and 0 < len(runs) < rows.select("l_suppkey").distinct().count()
    found = sorted(map(str, evidence.vignetting(dealt, g).collect()))
    monkeypatch.setattr(queries, "RUNS_SENT", 0)
    every = queries.searched_frames(rows, g)
    assert every.count() == rows.count() and sorted(map(str, evidence.vignetting(every, g).collect())) == found
    assert g.where(F.col("n_ok") > 0).count() > 0
