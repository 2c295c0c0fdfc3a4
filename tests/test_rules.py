"""Thresholds just below, at and just above; null, zero and empty inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import columns as C
from meterline.operators import (
    allocation,
    audit,
    automation,
    baselines,
    benchmarks,
    cost,
    gold,
    observability,
    reports,
    rules,
    savings,
    scores,
    silver,
)
from meterline.schemas import TABLES

HOUR, DAY = 3_600_000, 86_400_000
NOW = 1_000 * DAY


def frame(spark, table, rows):
    """Rows given as dicts; columns left out are null."""
    schema = TABLES[table].schema
    names = schema.fieldNames()
    for r in rows:
        assert set(r) <= set(names), set(r) - set(names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def clusters(spark, *rows):
    base = dict(workspace_name="w", cloud="aws", cluster_id="c", cluster_name="n", state="RUNNING",
                num_workers=4, cluster_source="API", start_time=NOW - 10 * HOUR)
    df = frame(spark, "bronze.compute_clusters", [{**base, **r} for r in rows])
    return silver.silver_clusters(df, as_of=NOW)


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize(
    "idle,score,is_idle",
    [(0.99, 1.0, False), (1.0, 0.7, False), (3.99, 0.7, False), (4.0, 0.4, False),
     (4.01, 0.4, True), (7.99, 0.4, True), (8.0, 0.1, True), (None, 0.5, False)],
)
def test_utilization_bands(spark, idle, score, is_idle):
    seen = None if idle is None else NOW - int(idle * HOUR)
    row = gold.cluster_flags(clusters(spark, dict(last_activity_time=seen))).first()
    assert (row.utilization_score, row.is_idle) == (score, is_idle)


@pytest.mark.parametrize("workers,idle,want", [(10, 3, False), (11, 2, False), (11, 2.01, True), (None, 9, False)])
def test_overprovisioned(spark, workers, idle, want):
    df = clusters(spark, dict(num_workers=workers, last_activity_time=NOW - int(idle * HOUR)))
    assert gold.cluster_flags(df).first().is_overprovisioned is want


def test_missing_epochs_are_unknown_not_1970(spark):
    row = clusters(spark, dict(terminated_time=0, last_activity_time=0)).first()
    assert row.uptime_hours is None and row.idle_hours is None
    row = clusters(spark, dict(start_time=0, last_activity_time=NOW)).first()
    assert row.idle_hours is None


@pytest.mark.parametrize(
    "text,want",
    [(None, False), ("", False), (" ", False), ("null", False), ("None", False), ("{}", False),
     ("[]", False), ('{"a": 1}', True)],
)
def test_presence(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.is_present(F.col("t"))).first()[0] is want


@pytest.mark.parametrize(
    "text,n", [(None, 0), ("[]", 0), ("['dt']", 1), ('["dt","region"]', 2), ("['dt', 'region']", 2), ("", 0)]
)
def test_partition_columns(spark, text, n):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.listed_names(F.col("t"))).first()[0] == n


def test_serverless_and_state_flags(spark):
    df = clusters(spark, dict(cluster_source=None), dict(cluster_source="UI", state=None))
    assert column(df, "is_serverless") == [True, False]
    assert column(df, "is_running") == [True, False]


def tables(spark, **over):
    from datetime import datetime, timedelta, timezone

    now = datetime.fromtimestamp(NOW / 1000, tz=timezone.utc)
    days = {k: over.pop(k, None) for k in ("modified", "accessed")}
    row = dict(workspace_name="w", full_table_name="d.t", table_name="t", table_type="delta",
               size_in_bytes=1024**3, num_files=4, partition_columns="['dt']")
    for key, name in (("modified", "last_modified"), ("accessed", "last_access")):
        if days[key] is not None:
            row[name] = now - timedelta(days=days[key])
    df = frame(spark, "bronze.storage_tables", [{**row, **over}])
    return gold.gold_tables(silver.silver_tables(df, as_of=NOW))


@pytest.mark.parametrize(
    "modified,accessed,cold,gone,tier",
    [(0, 30, False, False, "hot"), (0, 31, False, False, "warm"), (0, 90, False, False, "warm"),
     (0, 91, True, False, "cold"), (0, 180, True, False, "cold"), (0, 181, True, True, "cold"),
     (91, None, True, False, "cold"), (181, None, True, True, "cold"), (90, None, False, False, "hot"),
     (None, None, False, False, "hot")],
)
def test_table_ages(spark, modified, accessed, cold, gone, tier):
    r = tables(spark, modified=modified, accessed=accessed).first()
    assert (r.is_cold_data, r.is_abandoned, r.storage_tier) == (cold, gone, tier)


@pytest.mark.parametrize(
    "mb,files,small", [(127.99, 1, True), (128, 1, False), (5000, 0, True), (None, 3, False)]
)
def test_small_files(spark, mb, files, small):
    size = None if mb is None else int(mb * 1024**2)
    assert tables(spark, size_in_bytes=size, num_files=files).first().has_small_files is small


@pytest.mark.parametrize(
    "gb,parts,age,files,want",
    [(1, "['d']", 181, 1, "high"), (101, "['d']", 0, 10_000, "high"), (100, "['d']", 0, 10_000, "low"),
     (11, "['d']", 91, 1, "medium"), (10, "['d']", 91, 1, "low"), (51, "[]", 0, 1, "medium"),
     (50, "[]", 0, 1, "low")],
)
def test_priority(spark, gb, parts, age, files, want):
    r = tables(spark, size_in_bytes=gb * 1024**3, partition_columns=parts, accessed=age, num_files=files)
    assert r.first().optimization_priority == want


@pytest.mark.parametrize(
    "ok,total,score", [(95, 100, 1.0), (94, 100, 0.7), (80, 100, 0.7), (79, 100, 0.4), (60, 100, 0.4), (59, 100, 0.1)]
)
def test_efficiency_bands(spark, ok, total, score):
    df = spark.createDataFrame([(total, ok, total - ok)], "total_runs long, successful_runs long, failed_runs long")
    assert gold.with_rates(df).first().efficiency_score == score


@pytest.mark.parametrize(
    "now,base,score",
    [(89.9, 100.0, 1.0), (90.0, 100.0, 0.7), (99.9, 100.0, 0.7), (100.0, 100.0, 0.5), (109.9, 100.0, 0.5),
     (110.0, 100.0, 0.3), (5.0, 0.0, 0.5), (5.0, None, 0.5), (0.0, 0.0, 0.5)],
)
def test_cost_bands(spark, now, base, score):
    df = spark.createDataFrame([(now, base)], "current_monthly_cost double, baseline_monthly_cost double")
    assert df.select(scores.costs_score()).first()[0] == score


def daily(spark, values, ws="w"):
    from datetime import date, timedelta

    rows = [(ws, date(2024, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "workspace_name string, date_parsed date, daily_cost_usd double")


@pytest.mark.parametrize(
    "values,score",
    [([5], 0.5), ([5, 9], 0.5), ([10] * 7, 0.5), ([10] * 5 + [8] * 7, 1.0), ([10] * 5 + [9.5] * 7, 0.7),
     ([0] * 5 + [9] * 7, 0.5), ([10] * 5 + [12] * 7, 0.3)],
)
def test_cost_trend(spark, values, score):
    assert scores.cost_trend_score(daily(spark, values)).first().cost_trend_score == score


def test_actual_cost_uses_thirty_newest_days(spark):
    r = scores.actual_monthly_cost(daily(spark, [1000] * 5 + [2] * 30)).first()
    assert (r.days_counted, r.actual_monthly_cost) == (30, 60.0)


def estimate(spark, value):
    rows = [] if value is None else [("w", "aws", "c", float(value), float(value), True, 1)]
    return spark.createDataFrame(
        rows,
        "workspace_name string, cloud string, cluster_id string, estimated_monthly_cost double, "
        "estimated_dbu_cost double, is_running boolean, num_workers int",
    )


@pytest.mark.parametrize(
    "est,act,status,sure",
    [(104.9, 100.0, "reconciled", "high"), (105.0, 100.0, "close", "medium"), (114.9, 100.0, "close", "medium"),
     (115.0, 100.0, "needs_review", "low"), (100.0, 0.0, "estimated_only", "medium"),
     (100.0, None, "estimated_only", "medium"), (None, 100.0, "no_data", "low")],
)
def test_reconciliation(spark, est, act, status, sure):
    told = spark.createDataFrame([("w", act)], "workspace_name string, actual_cost double")
    r = benchmarks.reconcile_billing(estimate(spark, est), as_of=NOW, actuals=told).first()
    assert (r.reconciliation_status, r.confidence) == (status, sure)


def test_told_actuals_win_over_billing(spark):
    told = spark.createDataFrame(
        [("w", 100.0, "2024-05-01")], "workspace_name string, actual_cost double, actual_cost_date string"
    )
    r = benchmarks.reconcile_billing(estimate(spark, 100), daily(spark, [7] * 30), as_of=NOW, actuals=told).first()
    assert (r.actual_cost, r.reconciliation_date, r.variance) == (100.0, "2024-05-01", 0.0)


@pytest.mark.parametrize(
    "sure,pct,saved,want,level",
    [("high", 2.0, 5000.0, 0.88, "high"), ("high", 0.0, 10001.0, 1.0, "high"), ("medium", None, 99.0, 0.6, "medium"),
     ("low", 80.0, 5000.0, 0.3, "low"), ("low", 80.0, 50.0, 0.3, "low"), ("medium", None, 100.0, 0.7, "medium")],
)
def test_roi_confidence(spark, sure, pct, saved, want, level):
    rec = spark.createDataFrame(
        [("w", "x", sure, pct)],
        "workspace_name string, reconciliation_status string, confidence string, variance_percentage double",
    )
    gain = spark.createDataFrame([("w", saved)], "workspace_name string, estimated_savings double")
    r = benchmarks.roi_confidence(rec, gain).first()
    assert (r.roi_confidence, r.confidence_level) == (want, level)


@pytest.mark.parametrize("value,level", [(50.0, "excellent"), (50.1, "good"), (100.0, "good"), (200.0, "average"), (200.1, "poor"), (None, "no_data")])
def test_levels_where_less_is_better(spark, value, level):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(benchmarks.level_of(F.col("v"), DEFAULT.bench_cost_per_tb, True)).first()[0] == level


def test_benchmark_without_data_leaves_metric_out(spark):
    flags = gold.cluster_flags(clusters(spark, dict(last_activity_time=NOW)))
    none_jobs = spark.createDataFrame([], "workspace_name string, success_rate double, efficiency_score double, has_schedule boolean")
    none_storage = spark.createDataFrame([], "workspace_name string, total_size_tb double, cold_size_tb double")
    r = benchmarks.benchmarks(flags, none_jobs, none_storage, estimate(spark, None), as_of=NOW).first()
    assert (r.cost_per_tb, r.cost_per_tb_level, r.overall_score, r.overall_level) == (None, "no_data", 4.0, "excellent")


def test_dbu_cost_cases(spark):
    df = clusters(
        spark,
        dict(cluster_id="up", cluster_source="UI", state="TERMINATED", terminated_time=NOW - 8 * HOUR),
        dict(cluster_id="run", cluster_source="JOB", cloud="mars"),
        dict(cluster_id="off", state="TERMINATED", num_workers=0),
        dict(cluster_id="zero", state="TERMINATED", terminated_time=NOW - 10 * HOUR),
    )
    got = {r.cluster_id: r for r in cost.dbu_cost(df, as_of=NOW).collect()}
    assert got["up"].estimated_dbu_cost == pytest.approx(2 * 5 * 0.55)
    assert got["up"].estimated_monthly_cost == pytest.approx(30 * 5 * 0.55)
    assert got["run"].estimated_dbu_cost == pytest.approx(10 * 5 * 0.15)
    assert got["run"].estimated_monthly_cost == pytest.approx(10 * 5 * 0.15 * 30)
    assert (got["off"].dbu_per_hour, got["off"].estimated_dbu_cost) == (0.15, 0.0)
    assert got["zero"].estimated_monthly_cost == 0.0


def test_own_rate_card(spark):
    card = spark.createDataFrame(
        [("azure", "compute", 1.0), ("aws", "compute", 2.0)], "cloud string, cluster_type string, dbu_rate double"
    )
    df = clusters(spark, dict(cluster_id="a"), dict(cluster_id="b", cloud="gcp"))
    got = {r.cluster_id: r.dbu_rate for r in cost.dbu_cost(df, as_of=NOW, rate_card=card).collect()}
    assert got == {"a": 2.0, "b": 1.0}


def test_zero_totals_for_workspace_without_clusters(spark):
    names = spark.createDataFrame([("w",), ("empty",)], "workspace_name string")
    got = {r.workspace_name: r for r in cost.workspace_dbu_cost(estimate(spark, 3), names).collect()}
    assert got["empty"].total_estimated_monthly_cost == 0 and got["empty"].clusters_count == 0
    assert got["w"].clusters_count == 1


def test_fx_rates(spark):
    rows = [dict(workspace_name="w", date="2024-02-03", cost=10.0, currency=c) for c in ("USD", "EUR", "BRL")]
    rows.append(dict(workspace_name="w", date="not a date", cost=1.0, currency="USD"))
    fx = spark.createDataFrame([("EUR", 1.1)], "currency string, rate double")
    got = silver.silver_billing(frame(spark, "bronze.billing_costs", rows), as_of=NOW, fx=fx)
    assert sorted((r.currency, r.cost_usd, r.month) for r in got.collect() if r.month) == [
        ("BRL", 10.0, 2), ("EUR", 11.0, 2), ("USD", 10.0, 2)
    ]
    assert got.filter("date_parsed is null").count() == 1


@pytest.mark.parametrize(
    "text,center,owner",
    [("{'cost_center': 'x', 'Owner': 'y'}", "x", "y"), ('{"CostCenter": "z"}', "z", ""), ("broken", "", ""),
     (None, "", ""), ('{"cost_center": "", "CostCenter": "q"}', "q", "")],
)
def test_tags(spark, text, center, owner):
    df = spark.createDataFrame([(text,)], "t string").select(C.tags_struct(F.col("t")).alias("g"))
    r = df.first().g
    assert (r.cost_center, r.owner) == (center, owner)


@pytest.mark.parametrize(
    "url,cloud,wid",
    [("https://adb-1.azuredatabricks.net", "azure", "adb-1"), ("https://x.cloud.databricks.com", "aws", "x"),
     ("https://y.gcp.databricks.com", "gcp", "y"), ("https://example.org", None, None), (None, None, None)],
)
def test_urls(spark, url, cloud, wid):
    df = spark.createDataFrame([(url,)], "u string")
    r = df.select(C.cloud_from_url(F.col("u")).alias("c"), C.workspace_id_from_url(F.col("u")).alias("w")).first()
    assert (r.c, r.w) == (cloud, wid)


@pytest.mark.parametrize(
    "name,pipe,product", [("a_b-c", "a", "a_b"), ("plain", "plain", "default"), ("x-y", "x-y", "x"), ("_z", "", "default")]
)
def test_names(spark, name, pipe, product):
    df = spark.createDataFrame([(name,)], "n string")
    r = df.select(allocation.pipeline_name(F.col("n")), allocation.product_name(F.col("n"))).first()
    assert tuple(r) == (pipe, product)


@pytest.mark.parametrize("hours,tier", [(0.49, "fast"), (0.5, "standard"), (4.0, "standard"), (4.01, "slow")])
def test_sla(spark, hours, tier):
    df = spark.createDataFrame([(hours,)], "h double")
    assert df.select(allocation.sla_tier(F.col("h"))).first()[0] == tier


def test_cluster_id_prefix_is_not_a_match(spark):
    runs = spark.createDataFrame(
        [("w", 1, '{"cluster_id": "c-12"}', 1.0)],
        "workspace_name string, job_id long, cluster_instance string, duration_hours double",
    )
    est = spark.createDataFrame(
        [("w", "c-1", 5.0), ("w", "c-12", 7.0)], "workspace_name string, cluster_id string, estimated_dbu_cost double"
    )
    assert allocation.run_cost_per_job(runs, est).first().total_dbu_cost == 7.0


def test_backlog_and_quick_win_edges(spark):
    flags = gold.cluster_flags(
        clusters(
            spark,
            dict(cluster_id="win", num_workers=2, last_activity_time=NOW - 5 * HOUR, autoscale='{"a": 1}'),
            dict(cluster_id="edge", num_workers=1, last_activity_time=NOW - int(6.5 * HOUR), autoscale='{"a": 1}'),
            dict(cluster_id="fix", num_workers=6, autoscale="{}"),
        )
    )
    jobs = spark.createDataFrame(
        [("w", 7, "j", 0.5, 10, 4, 2.0)],
        "workspace_name string, job_id long, job_name string, failure_rate double, total_runs long, "
        "failed_runs long, avg_duration_hours double",
    )
    issues = audit.audit_compute(flags, jobs, as_of=NOW)
    kinds = sorted((r.issue_type, r.resource_id, r.severity) for r in issues.collect())
    assert kinds == [
        ("high_failure_job", "7", "high"), ("idle_cluster", "edge", "high"), ("idle_cluster", "win", "high"),
        ("missing_autoscaling", "fix", "medium"),
    ]
    backlog = {r.resource_id: r.estimated_savings_usd_month for r in reports.prioritized_backlog(issues).collect()}
    assert backlog == {"win": 150.0, "edge": 97.5, "7": pytest.approx(4 * 2 * 2 * 0.8)}
    assert column(reports.quick_wins(issues), "resource_id") == ["win"]
    assert reports.quick_wins(issues).first().title == "Cluster n ocioso"


def test_texts(spark):
    flags = gold.cluster_flags(clusters(spark, dict(last_activity_time=NOW - 5 * HOUR)))
    gone = tables(spark, modified=200)
    jobs = spark.createDataFrame(
        [("w", 7, "j", 0.5)], "workspace_name string, job_id long, job_name string, failure_rate double"
    )
    got = {r.rule_id: r for r in rules.recommendations(flags, gone, jobs, as_of=NOW).collect()}
    assert got["idle_cluster"].description == "Cluster c está ocioso há 5.0 horas"
    assert got["abandoned_table"].description == "Tabela d.t não é acessada há 200 dias"
    assert got["abandoned_table"].estimated_savings == "1.00 GB"
    assert got["failing_job"].description == "Job 7 tem 50.0% de falhas"
    issue = audit.audit_storage(gone, as_of=NOW).first()
    assert issue.description == "Tabela abandonada: 200 dias sem acesso, 1.00 GB"
    action = automation.automation_actions(flags, as_of=NOW).first()
    assert action.alert_message == "Cluster n está ocioso há 5.0 horas. Considere desligar."
    assert action.requires_approval and not action.can_execute


@pytest.mark.parametrize("idle,can", [(8.0, False), (8.01, True)])
def test_auto_execution(spark, idle, can):
    flags = gold.cluster_flags(clusters(spark, dict(last_activity_time=NOW - int(idle * HOUR))))
    r = automation.automation_actions(flags, as_of=NOW, level="auto").first()
    assert (r.can_execute, r.requires_approval) == (can, False)


def test_savings_options(spark):
    flags = gold.cluster_flags(clusters(spark, dict(num_workers=10, last_activity_time=NOW - 2 * HOUR)))
    got = {r.action: r.estimated_monthly_savings for r in savings.savings_clusters(flags).collect()}
    assert got == {"terminate_idle": 300.0, "enable_autoscaling": pytest.approx(1440.0), "resize_cluster": 1080.0}
    none = gold.cluster_flags(clusters(spark, dict(num_workers=0)))
    got = {r.action: r.estimated_monthly_savings for r in savings.savings_clusters(none).collect()}
    assert got == {"terminate_idle": 0.0, "enable_autoscaling": 0.0, "resize_cluster": -360.0}


@pytest.mark.parametrize("n,severity", [(5, "low"), (6, "medium"), (10, "medium"), (11, "high")])
def test_failure_pattern_severity(spark, n, severity):
    text = "x" * 100
    rows = [("w", NOW - HOUR, True, text + str(i)) for i in range(n)]
    rows += [("w", NOW - HOUR, True, "{}"), ("w", NOW - 31 * DAY, True, text)]
    df = spark.createDataFrame(rows, "workspace_name string, start_time long, is_failed boolean, error string")
    (r,) = observability.failure_patterns(df, as_of=NOW).collect()
    assert (r.error_pattern, r.occurrence_count, r.severity) == (text, n, severity)


def test_stage_shares_without_time(spark):
    df = spark.createDataFrame(
        [("w", 0, 0, 0), ("v", 30, 10, 60)],
        "workspace_name string, setup_duration long, execution_duration long, cleanup_duration long",
    )
    got = {r.workspace_name: (r.setup_percentage, r.bottleneck) for r in observability.stage_performance(df, as_of=NOW).collect()}
    assert got == {"w": (0.0, "execution"), "v": (30.0, "setup")}


def test_named_baseline_pairs(spark):
    from datetime import date

    rows = [("b1", "w", date(2024, 1, 1), 0.4, 0.0), ("b2", "w", date(2024, 2, 1), 0.6, 50.0), ("b3", "w", date(2024, 3, 1), 0.7, 40.0)]
    base = spark.createDataFrame(
        rows, "baseline_id string, workspace_name string, baseline_date date, maturity_score double, estimated_monthly_cost double"
    )
    pairs = spark.createDataFrame(
        [("w", "b1", "b2"), ("w", "b2", "b3"), ("w", "b3", "b1")],
        "workspace_name string, baseline_1_id string, baseline_2_id string",
    )
    got = {(r.baseline_1_id, r.baseline_2_id): r.cost_reduction_percentage for r in baselines.compare_baselines(base, pairs).collect()}
    assert got == {("b1", "b2"): 0.0, ("b2", "b3"): 20.0}
    ends = baselines.compare_baselines(base).first()
    assert (ends.baseline_1_id, ends.baseline_2_id) == ("b1", "b3")


def test_empty_inventories_score(spark):
    none = frame(spark, "silver.compute_clusters", [])
    jobs = gold.gold_jobs(
        frame(spark, "silver.compute_jobs", [dict(workspace_name="w", job_id=1, has_schedule=True)]),
        gold.job_run_stats(frame(spark, "silver.compute_job_runs", [])),
    )
    r = scores.maturity_scores(
        clusters=none, jobs=jobs, tables=frame(spark, "silver.storage_tables", []), as_of=NOW
    ).first()
    assert (r.compute_score, r.storage_score, r.governance_score, r.observability_score, r.costs_score) == (0, 0, 0, 0, 0.5)
    assert r.pipelines_score == 0.3 and r.maturity_level == "Básico"


def test_stated_percentages_follow_the_shares(spark):
    flags = gold.cluster_flags(clusters(spark, dict(num_workers=10)))
    cfg = EngineConfig(autoscaling_saved=0.25, resize_factor=0.6)
    got = {r.action: r.reduction_percentage for r in savings.savings_clusters(flags, cfg=cfg).collect()}
    assert got == {"terminate_idle": 100.0, "enable_autoscaling": 25.0, "resize_cluster": 40.0}
