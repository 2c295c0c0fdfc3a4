"""Faults that showed on larger tables: sums that miss a bound by a digit, work that is done twice."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from meterline import fixtures_payloads
from meterline.fixtures import AS_OF, BASELINE, Bronze, estate
from meterline.operators import allocation, gold, history, silver
from meterline.plans import incremental
from meterline.plans.registry import REPORTS
from meterline.streaming import runs


@pytest.mark.parametrize("hours, tier", [([2.3, 4.1, 5.6], "standard"), ([0.5 - 2**-54], "standard"), ([4.0001], "slow"), ([0.4999], "fast")])
def test_tier_does_not_hang_on_the_last_digit_of_a_sum(spark, hours, tier):
    mean = sum(hours) / len(hours)
    df = spark.createDataFrame([(mean,)], "h double")
    assert df.select(allocation.sla_tier(F.col("h"))).first()[0] == tier


def scans(df, table):
    """Scans of a table in the plan that has run; a reused shuffle is read, not computed again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(rf"FileScan parquet [^\n]*{table}", plan))


@pytest.mark.parametrize("key, n", [("compare_baselines", 1), ("executive_report", 2), ("q_exec_report", 2), ("q_regressions", 2)])
def test_assessments_share_one_shuffle_of_the_runs(spark, tiny, key, n):
    # the second scan is that of the last days alone, for long runs
    assert scans(REPORTS[key].build(estate(spark, tiny)), "lineitem") == n


@pytest.mark.parametrize("key", ["compare_baselines", "executive_report", "q_regressions", "q_score_history"])
def test_copies_of_runs_are_told_apart_once(spark, tiny, key):
    df = REPORTS[key].build(estate(spark, tiny))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Window \[[^\n]*lag\(collect_timestamp", plan)) == 1


def test_run_statistics_of_several_assessments(spark, tiny):
    b = Bronze(spark, tiny)
    again = b.runs.filter("run_id % 3 = 0").withColumn("execution_duration", F.lit(None).cast("bigint"))
    runs = b.runs.unionByName(again)
    slots = [(BASELINE, None), (AS_OF, None), (AS_OF, BASELINE), (AS_OF, AS_OF)]
    counts = ["workspace_name", "job_id", "total_runs", "successful_runs", "failed_runs", "failure_rate", "efficiency_score"]
    hours = F.round("avg_duration_hours", 9).alias("hours")
    together = history.run_stats_together(runs, slots)
    for i, (known, started) in enumerate(slots):
        rows = silver.latest_runs(silver.seen_by(runs, known))
        rows = rows if started is None else rows.filter(F.col("start_time") <= started)
        want = gold.job_run_stats(silver.silver_job_runs(rows, as_of=known)).select(*counts, hours)
        got = together.filter(F.col("slot") == i).select(*counts, hours)
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_parts_of_a_report_are_those_of_the_whole(spark, tiny):
    e = estate(spark, tiny)
    whole = {r.workspace_name: r for r in e.report.collect()}
    for part, column in (("new_resources", "new_resources"), ("statuses", "recommendations_status")):
        some = {r.workspace_name: r for r in e.report_of(part).collect()}
        assert set(some) == set(whole)
        assert all(some[w][column] == whole[w][column] for w in whole)
    with pytest.raises(ValueError, match="unknown parts"):
        e.report_of("nothing")


def test_runs_known_at_two_instants(spark, tiny):
    b = Bronze(spark, tiny)
    half = b.runs.filter("run_id % 3 = 0")
    # copies that tie in time, and one that differs in a figure taken in by its hash only
    tied = half.withColumn("error", F.lit(None).cast("string"))
    rows = b.runs.unionByName(tied).unionByName(half)
    columns = sorted(rows.columns)
    for at in (BASELINE, AS_OF):
        one = silver.runs_known_at(rows, at, until=AS_OF).select(columns)
        other = silver.latest_runs(silver.seen_by(rows, at)).select(columns)
        assert one.count() == other.count() == silver.seen_by(b.runs, at).select("run_id").distinct().count()
        assert one.exceptAll(other).isEmpty()


def test_runs_are_not_sorted_before_their_shuffle(spark, tiny):
    plan = silver.latest_runs(Bronze(spark, tiny).runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "WindowGroupLimit" not in plan


def test_versions_are_not_sorted_before_the_shuffle(spark, tiny):
    df = REPORTS["snapshot_intervals"].build(estate(spark, tiny))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan
    below = plan.split("Exchange hashpartitioning(workspace_name")[-1]
    assert "Sort [" not in below


def test_payload_lines_are_compressed(spark, tiny):
    path = fixtures_payloads._lines(fixtures_payloads.run_pages(Bronze(spark, tiny).runs), "runs")
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert spark.read.schema("job_id bigint").json(path).count() == Bronze(spark, tiny).runs.count()


def test_first_fold_writes_the_history_once(spark, tiny, monkeypatch):
    staged = []
    plain = incremental._staged
    monkeypatch.setattr(incremental, "_staged", lambda df, label: staged.append(label) or plain(df, label))
    b = Bronze(spark, tiny)
    some = b.runs.filter("workspace_name in ('ws_1', 'ws_2')")
    run = fixtures_payloads._folded(b, incremental.RUNS, some, incremental.fold_runs)
    assert len(staged) == 2  # the second and third collection
    got = incremental.run_stats(run).select("job_id", "total_runs", "failed_runs")
    known = silver.silver_job_runs(silver.latest_runs(silver.seen_by(some, AS_OF)), as_of=AS_OF)
    want = gold.job_run_stats(known).select("job_id", "total_runs", "failed_runs")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_late_runs_are_stored_without_a_shuffle(spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "latest_runs", lambda df: pytest.fail("reduced before it is read"))
    source = str(tmp_path / "in")
    part = Bronze(spark, tiny).runs.filter("run_id % 50 = 0")
    part.write.parquet(source)
    stream = spark.readStream.schema(part.schema).parquet(source)
    runs.advance(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    monkeypatch.undo()
    assert runs.final_runs(spark, str(tmp_path / "out")).count() == part.select("run_id").distinct().count()
