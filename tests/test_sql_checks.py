"""Registered queries against their SQL. All keys with METERLINE_FULL=1, else one per family."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import difference, duck
from meterline.plans.registry import REPORTS

FAMILIES = [
    "silver_clusters",
    "silver_job_runs",
    "silver_tables",
    "gold_clusters",
    "gold_jobs",
    "gold_tables",
    "gold_billing",
    "tag_allocation",
    "pipeline_costs",
    "cost_by_product",
    "cost_trend_score",
    "maturity_scores",
    "benchmarks",
    "roi_confidence",
    "recommendations",
    "audit_compute",
    "audit_workflows",
    "recommendation_status",
    "new_resources",
    "failure_patterns",
    "stage_performance",
    "prioritized_backlog",
    "quick_wins",
    "kpi_inefficient_jobs",
    "executive_report",
    "stream_job_runs",
    "stream_daily_cost",
    "sink_append_evolved",
    "sink_replace",
    "q_critical_issues",
]


def _keys():
    sql = entry.oracle_sql()
    return sorted(set(sql) & set(REPORTS)) if os.environ.get("METERLINE_FULL") else FAMILIES


@pytest.fixture(scope="module")
def con(tiny):
    return duck(tiny)


@pytest.mark.parametrize("key", _keys())
def test_equals_sql(spark, tiny, con, key):
    df = entry.queries()[key](spark, tiny)
    assert difference(df, con, entry.oracle_sql()[key]) is None


def test_every_key_has_sql():
    assert set(REPORTS) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert "failure_rate" in df.columns
    assert df.limit(1).count() == 1
