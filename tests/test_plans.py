"""Shape of the physical plans: no cross joins, early trimming, pushed filters."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from meterline.fixtures import AS_OF, estate
from meterline.operators import audit, silver
from meterline.plans import kpis
from meterline.plans.registry import REPORTS
from meterline.sources import layers


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# These write files while they are built.
EAGER = ("src_", "stream_", "lake_", "incremental_", "table_log_", "gold_jobs_colocated", "sink_")
# Projections of a report that is itself planned below.
VARIANTS = {
    "q_exec_report", "q_recommendation_status", "q_roi_analysis", "q_new_resources",
    "q_regressions", "q_validated_statuses", "q_score_history", "q_list_baselines",
    "kpi_maturity_latest", "latest_baseline", "create_baseline",
}


@pytest.mark.parametrize("key", sorted(k for k in REPORTS if not k.startswith(EAGER) and k not in VARIANTS))
def test_no_nested_loops_and_no_python(spark, tiny, key):
    plan = plan_of(REPORTS[key].build(estate(spark, tiny)))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_top_n_is_trimmed_before_the_shuffle(spark, tiny):
    plan = plan_of(kpis.kpi_inefficient_jobs(estate(spark, tiny).gold_jobs))
    assert "Partial" in plan.split("WindowGroupLimit", 1)[1] or plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("key", ["quick_wins", "q_quick_wins", "q_checklist_by_category"])
def test_rules_that_are_not_asked_for_are_not_planned(spark, tiny, key):
    assert "lineitem" not in plan_of(REPORTS[key].build(estate(spark, tiny)))


@pytest.mark.parametrize("key", ["runs_lookback", "failure_patterns", "run_cost_per_job", "pipeline_costs"])
def test_lookback_is_below_the_shuffle(spark, tiny, key):
    plan = plan_of(REPORTS[key].build(estate(spark, tiny)))
    scan = re.search(r"FileScan parquet [^\n]*lineitem", plan)
    above = plan[: scan.start()].rsplit("Exchange", 1)[1]
    assert re.search(r"Filter [^\n]*>= 9\d{11}", above)


@pytest.mark.parametrize("key", ["total_roi", "prioritized_backlog", "q_backlog"])
def test_facts_are_read_once(spark, tiny, key):
    plan = plan_of(REPORTS[key].build(estate(spark, tiny)))
    scans = re.findall(r"FileScan parquet [^\n]*lineitem", plan)
    assert len(scans) == 1


def test_only_needed_columns_are_read(spark, tiny):
    e = estate(spark, tiny)
    plan = plan_of(e.daily)
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "o_orderpriority" not in schema and "o_totalprice" in schema


def test_lookback_prunes_month_folders(spark, tiny, tmp_path):
    e = estate(spark, tiny)
    some = e.runs.filter(F.col("workspace_name").isin("ws_1", "ws_2"))
    layers.replace(some, "silver.compute_job_runs", str(tmp_path), as_of=AS_OF)
    stored = layers.read(spark, "silver.compute_job_runs", str(tmp_path))
    recent = silver.runs_since(stored, 30, as_of=AS_OF)
    plan = plan_of(recent)
    assert "PartitionFilters: [isnotnull(start_month" in plan
    assert "GreaterThanOrEqual(start_time" in plan
    want = silver.runs_since(some, 30, as_of=AS_OF).count()
    assert recent.count() == want > 0
    # The same holds inside an audit.
    issues = audit.audit_workflows(e.gold_jobs, stored, as_of=AS_OF)
    assert "start_month" in plan_of(issues)
