"""Every registered report: how to build it and which columns it shows.

A column spec is ``name`` or ``name~`` (double rounded to 4 digits) or
``name~6``. Texts that print a formatted number are left out: printing differs
between engines; unit tests cover them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from meterline import fixtures_payloads as files
from meterline.fixtures import BASELINE, Estate
from meterline.operators import (
    allocation,
    audit,
    automation,
    baselines,
    benchmarks,
    cost,
    gold,
    history,
    observability,
    partials,
    reports,
    savings,
    scores,
    silver,
)
from meterline.functions import columns as C
from meterline.plans import kpis


@dataclass(frozen=True)
class Report:
    build: Callable[[Estate], DataFrame]
    columns: str


def shown(df: DataFrame, columns: str) -> DataFrame:
    """Project and round as the column spec says."""
    out = []
    for spec in columns.split():
        name, mark, digits = spec.partition("~")
        # Adding zero turns a rounded -0.0 into 0.0.
        value = F.round(name, int(digits or 4)) + F.lit(0.0) if mark else F.col(name)
        out.append(value.alias(name))
    return df.select(*out)


_CLUSTER_FLAGS = (
    "workspace_name cluster_id cluster_name state num_workers memory_gb~ uptime_hours~ idle_hours~ "
    "is_idle is_overprovisioned utilization_score~ has_autoscaling"
)
_JOB_STATS = (
    "total_runs successful_runs failed_runs avg_duration_hours~8 max_duration_hours~8 "
    "min_duration_hours~ total_duration_hours~ success_rate~ failure_rate~ efficiency_score~"
)
_ISSUE = (
    "workspace_name issue_type category resource_id resource_name table_name severity "
    "recommended_action idle_hours~ num_workers size_gb~ failed_runs avg_duration_hours~8"
)
_SAVING = (
    "current_monthly_cost~ estimated_monthly_cost~ estimated_monthly_savings~ "
    "estimated_annual_savings~ reduction_percentage~ confidence payback_months~"
)
_REC = "workspace_name rule_id resource_id category priority title impact complexity action"
_MATURITY = (
    "workspace_name maturity_score~8 maturity_level compute_score~8 storage_score~8 "
    "governance_score~8 pipelines_score~8 observability_score~8 costs_score~8"
)
_PIPE = (
    "workspace_name resource_id resource_name pipeline_name product_name sla_tier "
    "estimated_monthly_cost~ estimated_dbu_cost~ cost_per_run~ total_runs_monthly "
    "avg_duration_hours~8"
)

_EST = (
    "workspace_name cluster_id cluster_name cluster_type num_workers uptime_hours~ dbu_rate~ "
    "dbu_per_hour~ estimated_dbu_cost~ estimated_monthly_cost~"
)
_BASE = (
    "workspace_name baseline_date cloud framework_version maturity_score~8 maturity_level "
    "compute_score~8 storage_score~8 governance_score~8 pipelines_score~8 observability_score~8 "
    "costs_score~8 estimated_monthly_cost~ estimated_annual_cost~ total_clusters total_jobs "
    "total_tables total_storage_tb~"
)


def _both_baselines(e: Estate) -> DataFrame:
    return e.together.before.baseline.unionByName(e.together.baseline)


def _both_maturities(e: Estate) -> DataFrame:
    return e.together.before.maturity.unionByName(e.together.maturity)


def _state(e: Estate, name: str, rows: DataFrame) -> DataFrame:
    """What an assessment history said at the baseline."""
    return history.state_at({name: rows}, as_of=BASELINE)[name]


def _urls(e: Estate) -> DataFrame:
    url = F.col("workspace_url")
    return (
        e.bronze.clusters.groupBy("workspace_name", "workspace_url")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(
            "workspace_name",
            C.cloud_from_url(url).alias("cloud"),
            C.workspace_id_from_url(url).alias("workspace_id"),
            "n_rows",
        )
    )


def _roi_confidence(e: Estate) -> DataFrame:
    saved = e.roi.select(
        "workspace_name", F.col("estimated_monthly_savings").alias("estimated_savings")
    )
    return benchmarks.roi_confidence(e.reconciliation, saved, cfg=e.cfg)


_ROI = (
    "current_monthly_cost", "estimated_monthly_cost", "estimated_monthly_savings",
    "estimated_annual_savings", "reduction_percentage", "confidence", "margin_of_error",
)


def _flat_report(report: DataFrame) -> DataFrame:
    """All fields of the nested report; each array is one text of its rows in order."""

    def listed(name: str, *fields: str):
        row = F.transform(name, lambda x: F.concat_ws("|", *[x[f] for f in fields]))
        return F.array_join(row, ";")

    return report.select(
        "workspace_name",
        "report_date",
        "baseline_date",
        "executive_summary.*",
        "new_resources.*",
        listed(
            "recommendations_status", "recommendation_title", "category", "priority", "status"
        ).alias("statuses"),
        listed("critical_issues", "issue_type", "resource_id", "severity", "recommended_action").alias("critical"),
        *[F.col(f"roi_analysis.{c}").alias(f"roi_{c}") for c in _ROI],
        "maturity_breakdown.*",
    )


_BILL = "workspace_name cloud date resource_id service cost~6 currency"

def _at_both(e: Estate, versions: DataFrame, key: str, derive) -> DataFrame:
    """Silver at the baseline and now from version intervals; whether a resource came since."""
    new = history.appeared_since(versions, key, baseline=BASELINE).withColumn("is_new", F.lit(True))
    out = None
    for s, at in ((0, BASELINE), (2, e.as_of)):
        one = derive(history.valid_at(versions, as_of=at), at).withColumn("s", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.join(new, ["workspace_name", key], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


REPORTS: dict[str, Report] = {
    # ---- sources and streams
    "src_clusters": Report(
        lambda e: files.src_clusters(e.bronze),
        "workspace_name cloud cluster_id cluster_name state spark_version num_workers "
        "autotermination_minutes cluster_source start_time terminated_time last_activity_time "
        "cluster_memory_mb~ max_workers tag_owner is_pinned init_scripts collect_ms",
    ),
    "src_jobs": Report(
        lambda e: files.src_jobs(e.bronze),
        "workspace_name cloud job_id job_name job_type max_concurrent_runs existing_cluster_id "
        "cron tag_owner collect_ms",
    ),
    "src_job_runs": Report(
        lambda e: files.src_job_runs(e.bronze),
        "workspace_name cloud job_id run_id run_name state result_state start_time end_time "
        "setup_duration execution_duration cleanup_duration used_cluster error_code",
    ),
    "src_tables": Report(
        lambda e: files.src_tables(e.bronze),
        "workspace_name cloud metastore_type catalog schema table_name full_table_name "
        "table_type num_files size_in_bytes n_partition_columns last_modified_ms last_access_ms "
        "collect_ms",
    ),
    "lake_inventory": Report(
        lambda e: files.lake_inventory(e.bronze), "table_name has_files has_bytes"
    ),
    "src_billing_azure": Report(
        lambda e: files.src_billing_azure(e.bronze),
        "workspace_name cloud date resource_id resource_type resource_group cost~6 currency",
    ),
    "src_billing_aws": Report(lambda e: files.src_billing_aws(e.bronze), _BILL),
    "src_billing_gcp": Report(lambda e: files.src_billing_gcp(e.bronze), _BILL),
    "src_billing": Report(lambda e: files.src_billing(e.bronze), f"{_BILL} resource_type"),
    "stream_job_runs": Report(
        lambda e: files.stream_job_runs(e.bronze),
        "workspace_name job_id run_id result_state execution_duration setup_duration "
        "cleanup_duration duration_hours~ is_success is_failed is_cancelled has_error",
    ),
    "stream_runs_watermarked": Report(
        lambda e: files.stream_runs_watermarked(e.bronze),
        "workspace_name job_id run_id result_state execution_duration setup_duration "
        "cleanup_duration duration_hours~ is_success is_failed is_cancelled has_error",
    ),
    "stream_daily_windows": Report(
        lambda e: files.stream_daily_windows(e.bronze), "workspace_name date_parsed daily_cost_usd~6"
    ),
    "incremental_job_stats": Report(
        lambda e: files.folded_run_stats(e.bronze), f"workspace_name job_id {_JOB_STATS}"
    ),
    "incremental_daily_cost": Report(
        lambda e: files.folded_daily_cost(e.bronze), "workspace_name date_parsed daily_cost_usd~6"
    ),
    "schema_sketch": Report(
        lambda e: partials.over_workspaces(partials.schema_sketches(e.tables)),
        "total_tables total_size_tb~ total_schemas",
    ),
    "table_log_inventory": Report(
        lambda e: files.table_log_inventory(e.bronze),
        "table_name table_type num_files size_in_bytes partition_columns version last_modified_ms last_commit_ms",
    ),
    "billing_fx_asof": Report(
        lambda e: e.billing_at_rates,
        "workspace_name date_parsed resource_id service currency cost~8 cost_usd~8",
    ),
    "snapshot_intervals": Report(
        lambda e: e.job_versions.withColumns(
            {"from_ms": F.unix_millis("valid_from"), "to_ms": F.unix_millis("valid_to")}
        ),
        "workspace_name job_id job_name existing_cluster_id schedule from_ms to_ms",
    ),
    "interval_jobs": Report(
        lambda e: _at_both(e, e.job_versions, "job_id", lambda df, at: silver.silver_jobs(df, as_of=at)),
        "s workspace_name job_id job_name existing_cluster_id has_schedule is_new",
    ),
    "interval_tables": Report(
        lambda e: _at_both(e, e.table_versions, "full_table_name", lambda df, at: silver.silver_tables(df, as_of=at)),
        "s workspace_name full_table_name size_in_bytes num_files days_since_modified days_since_accessed is_new",
    ),
    "sink_append_evolved": Report(
        lambda e: files.sink_append_evolved(e.bronze),
        "workspace_name job_id tags collect_ms priority~ retries~ has_retries detail_a detail_b",
    ),
    "sink_replace": Report(
        lambda e: files.sink_replace(e.bronze), "workspace_name job_id job_name has_schedule collect_ms"
    ),
    "gold_jobs_colocated": Report(
        lambda e: files.gold_jobs_colocated(e.jobs, e.runs),
        f"workspace_name job_id job_name uses_existing_cluster has_schedule {_JOB_STATS}",
    ),
    "stream_daily_cost": Report(
        lambda e: files.stream_daily_cost(e.bronze), "workspace_name date_parsed daily_cost_usd~6"
    ),
    # ---- silver
    "silver_clusters": Report(
        lambda e: e.clusters,
        "workspace_name cloud cluster_id cluster_name state num_workers is_running is_terminated "
        "has_autoscaling is_serverless uptime_hours~ idle_hours~ memory_gb~ "
        "estimated_cost_per_hour~",
    ),
    "silver_jobs": Report(
        lambda e: e.jobs, "workspace_name cloud job_id job_name uses_existing_cluster has_schedule"
    ),
    "silver_job_runs": Report(
        lambda e: e.runs,
        "workspace_name cloud job_id run_id result_state execution_duration setup_duration "
        "cleanup_duration duration_seconds~ duration_hours~ is_success is_failed is_cancelled "
        "has_error",
    ),
    "silver_tables": Report(
        lambda e: e.tables,
        "workspace_name metastore_type schema full_table_name table_type num_files size_gb~ "
        "size_tb~6 avg_file_size_mb~ days_since_modified days_since_accessed is_partitioned "
        "is_delta has_small_files is_cold_data is_abandoned",
    ),
    "silver_billing": Report(
        lambda e: e.billing,
        "workspace_name cloud date_parsed year month day resource_id service cost~6 currency "
        "cost_usd~6",
    ),
    "baseline_state": Report(
        lambda e: history.state_at(
            {
                "clusters": gold.cluster_flags(
                    silver.silver_clusters(e.bronze.clusters, as_of=F.col("collect_timestamp")),
                    cfg=e.cfg,
                )
            },
            as_of=BASELINE,
        )["clusters"],
        _CLUSTER_FLAGS,
    ),
    "state_tables": Report(
        lambda e: _state(e, "tables", silver.silver_tables(e.bronze.tables, as_of=F.col("collect_timestamp"))),
        "workspace_name full_table_name size_gb~ days_since_modified days_since_accessed "
        "is_cold_data is_abandoned",
    ),
    "state_jobs": Report(
        lambda e: _state(e, "jobs", silver.silver_jobs(e.bronze.jobs, as_of=F.col("collect_timestamp"))),
        "workspace_name job_id job_name has_schedule uses_existing_cluster",
    ),
    "state_recommendations": Report(
        lambda e: _state(
            e, "recommendations", e.before.recommendations.unionByName(e.recommendations)
        ),
        _REC,
    ),
    "state_maturity": Report(
        lambda e: _state(e, "maturity", _both_maturities(e)), _MATURITY
    ),
    "latest_snapshot": Report(
        lambda e: silver.latest_snapshot(e.bronze.clusters, ["cluster_id"], e.as_of),
        "workspace_name cluster_id cluster_name state num_workers",
    ),
    "runs_lookback": Report(
        lambda e: e.recent(7),
        "workspace_name job_id run_id result_state duration_hours~",
    ),
    "cloud_from_url": Report(_urls, "workspace_name cloud n_rows"),
    "workspace_id_from_url": Report(_urls, "workspace_name workspace_id n_rows"),
    # ---- gold
    "gold_clusters": Report(lambda e: e.gold_clusters, f"{_CLUSTER_FLAGS} rank_by_uptime"),
    "rank_by_uptime": Report(
        lambda e: e.gold_clusters, "workspace_name cluster_id uptime_hours~ rank_by_uptime"
    ),
    "job_run_stats": Report(lambda e: e.run_stats, f"workspace_name job_id {_JOB_STATS}"),
    "gold_jobs": Report(
        lambda e: e.gold_jobs,
        f"workspace_name job_id job_name uses_existing_cluster has_schedule {_JOB_STATS}",
    ),
    "gold_tables": Report(
        lambda e: e.gold_tables,
        "workspace_name full_table_name size_gb~ is_cold_data is_abandoned has_small_files "
        "storage_tier optimization_priority estimated_savings_gb~",
    ),
    "gold_storage_workspace": Report(
        lambda e: e.storage,
        "workspace_name total_tables total_size_tb~ cold_size_tb~ abandoned_size_tb~ "
        "small_files_size_tb~ total_schemas avg_file_size_mb~ cold_data_percentage~ "
        "abandoned_data_percentage~",
    ),
    "daily_cost": Report(lambda e: e.daily, "workspace_name date_parsed daily_cost_usd~6"),
    "monthly_cost": Report(
        lambda e: gold.monthly_cost(e.daily),
        "workspace_name year month monthly_cost_usd~6 avg_daily_cost_usd~9",
    ),
    "gold_billing": Report(
        lambda e: e.gold_billing,
        "workspace_name date_parsed year month daily_cost_usd~6 monthly_cost_usd~6 "
        "avg_daily_cost_usd~9",
    ),
    # ---- cost and allocation
    "dbu_cost": Report(lambda e: e.estimates, f"cloud is_running {_EST}"),
    "workspace_dbu_cost": Report(
        lambda e: cost.workspace_dbu_cost(e.estimates),
        "workspace_name total_estimated_dbu_cost~ total_estimated_monthly_cost~ clusters_count "
        "running_clusters total_workers",
    ),
    "cost_per_tb": Report(
        lambda e: cost.cost_per_tb(e.estimates, e.storage),
        "workspace_name monthly_cost~ total_size_tb~ cost_per_tb~",
    ),
    "tag_allocation": Report(
        lambda e: e.allocation.withColumn("tag_owner", F.col("tags.owner")),
        "workspace_name resource_type resource_id resource_name cost_center business_unit "
        "data_domain estimated_monthly_cost~ estimated_dbu_cost~ allocation_method tag_owner",
    ),
    "tag_coverage": Report(
        lambda e: scores.tag_coverage(e.clusters, e.jobs),
        "workspace_name cluster_tag_coverage~ job_tag_coverage~",
    ),
    "cost_by_domain": Report(
        lambda e: allocation.cost_by_domain(e.allocation),
        "workspace_name dimension dimension_value total_monthly_cost~ total_dbu_cost~",
    ),
    "pipeline_names": Report(
        lambda e: e.jobs.select(
            "workspace_name",
            "job_id",
            allocation.pipeline_name(F.col("job_name")).alias("pipeline_name"),
            allocation.product_name(F.col("job_name")).alias("product_name"),
        ),
        "workspace_name job_id pipeline_name product_name",
    ),
    "run_cost_per_job": Report(
        lambda e: allocation.run_cost_per_job(
            e.recent(e.cfg.lookback_days), e.estimates, cfg=e.cfg
        ),
        "workspace_name job_id total_dbu_cost~ avg_dbu_cost_per_run~ total_runs "
        "avg_duration_hours~8",
    ),
    "pipeline_costs": Report(lambda e: e.pipelines, _PIPE),
    "cost_by_product": Report(
        lambda e: allocation.cost_by_product(e.pipelines),
        "workspace_name dimension dimension_value total_monthly_cost~ resource_count",
    ),
    # ---- scores
    "score_compute": Report(
        lambda e: scores.score_compute(e.flags, e.gold_jobs), "workspace_name compute_score~8"
    ),
    "score_storage": Report(
        lambda e: scores.score_storage(e.tables), "workspace_name storage_score~8"
    ),
    "score_governance": Report(
        lambda e: scores.score_governance(e.tables), "workspace_name governance_score~8"
    ),
    "score_pipelines": Report(
        lambda e: scores.score_pipelines(e.gold_jobs), "workspace_name pipelines_score~8"
    ),
    "score_observability": Report(
        lambda e: scores.score_observability(e.clusters, e.jobs),
        "workspace_name observability_score~8",
    ),
    "score_costs": Report(
        lambda e: scores.score_costs(e.estimates, e.before.cost_baseline, cfg=e.cfg),
        "workspace_name costs_score~8",
    ),
    "cost_trend_score": Report(
        lambda e: scores.cost_trend_score(e.daily, cfg=e.cfg),
        "workspace_name days recent_avg~ older_avg~ cost_trend_score~",
    ),
    "actual_monthly_cost": Report(
        lambda e: scores.actual_monthly_cost(e.daily, cfg=e.cfg),
        "workspace_name days_counted avg_daily_cost~ actual_monthly_cost~",
    ),
    "maturity_scores": Report(lambda e: e.maturity, _MATURITY),
    "create_baseline": Report(lambda e: e.baseline, _BASE),
    "latest_baseline": Report(
        lambda e: baselines.latest_baseline(_both_baselines(e)),
        "workspace_name baseline_date maturity_score~8 estimated_monthly_cost~ total_clusters "
        "total_jobs",
    ),
    "compare_baselines": Report(
        lambda e: baselines.compare_baselines(_both_baselines(e)),
        "workspace_name baseline_1_date baseline_1_score~ baseline_1_cost~ baseline_2_date "
        "baseline_2_score~ baseline_2_cost~ score_improvement~ cost_reduction~ "
        "cost_reduction_percentage~",
    ),
    "benchmarks": Report(
        lambda e: e.benchmarks,
        "workspace_name cost_per_tb~ cost_per_tb_level cluster_utilization~ utilization_level "
        "job_success_rate~ success_rate_level cold_data_percentage~ cold_data_level "
        "overall_score~ overall_level",
    ),
    "reconcile_billing": Report(
        lambda e: e.reconciliation,
        "workspace_name estimated_monthly_cost~ actual_cost~ variance~ variance_percentage~ "
        "reconciliation_status confidence recommendation",
    ),
    "roi_confidence": Report(
        _roi_confidence,
        "workspace_name estimated_savings~ roi_confidence~ confidence_level "
        "reconciliation_status variance_percentage~ recommendation",
    ),
    # ---- rules, audits, history
    "recommendations": Report(lambda e: e.recommendations, _REC),
    "audit_storage": Report(
        lambda e: audit.audit_storage(e.gold_tables, as_of=e.as_of, cfg=e.cfg), _ISSUE
    ),
    "audit_compute": Report(
        lambda e: audit.audit_compute(e.flags, e.gold_jobs, as_of=e.as_of, cfg=e.cfg), _ISSUE
    ),
    "audit_workflows": Report(
        lambda e: audit.audit_workflows(
            e.jobs, e.recent(e.cfg.long_runs_days), as_of=e.as_of, cfg=e.cfg
        ),
        _ISSUE
    ),
    "recommendation_status": Report(
        lambda e: e.statuses,
        "workspace_name rule_id resource_id recommendation_title category priority status",
    ),
    "new_clusters": Report(
        lambda e: history.new_since(e.bronze.clusters, "cluster_id", baseline=BASELINE),
        "workspace_name cluster_id",
    ),
    "new_tables": Report(
        lambda e: history.new_since(e.bronze.tables, "full_table_name", baseline=BASELINE),
        "workspace_name full_table_name",
    ),
    "new_jobs": Report(
        lambda e: history.new_since(e.bronze.jobs, "job_id", baseline=BASELINE),
        "workspace_name job_id",
    ),
    "new_resources": Report(
        lambda e: e.new_resources, "workspace_name new_clusters new_tables new_jobs"
    ),
    "table_version_count": Report(
        lambda e: history.table_version_count(e.bronze.tables),
        "workspace_name full_table_name version_count",
    ),
    "failure_patterns": Report(
        lambda e: observability.failure_patterns(
            e.recent(e.cfg.lookback_days), as_of=e.as_of, cfg=e.cfg
        ),
        "workspace_name error_pattern occurrence_count severity recommendation",
    ),
    "stage_performance": Report(
        lambda e: observability.stage_performance(e.runs, as_of=e.as_of),
        "workspace_name setup_percentage~ execution_percentage~ cleanup_percentage~ bottleneck",
    ),
    "failure_waste": Report(
        lambda e: observability.failure_waste(e.gold_jobs, as_of=e.as_of, cfg=e.cfg),
        "workspace_name job_id job_name failure_rate~ waste_cost_monthly~ performance_impact "
        "cost_impact",
    ),
    "automation_actions": Report(
        lambda e: automation.automation_actions(e.flags, as_of=e.as_of, level="auto", cfg=e.cfg),
        "workspace_name resource_type resource_id resource_name action_type automation_level "
        "estimated_savings~ risk_level requires_approval can_execute action_command "
        "rollback_command executed",
    ),
    "automation_alerts": Report(
        lambda e: automation.automation_alerts(e.flags, as_of=e.as_of, cfg=e.cfg),
        "workspace_name alert_type severity title resource_id resource_name action_available "
        "action_command estimated_savings~ risk_level requires_approval",
    ),
    # ---- savings and reports
    "savings_clusters": Report(
        lambda e: savings.savings_clusters(e.flags, cfg=e.cfg),
        f"workspace_name cluster_id action {_SAVING}",
    ),
    "savings_tables": Report(
        lambda e: savings.savings_tables(e.gold_tables, cfg=e.cfg),
        f"workspace_name full_table_name action {_SAVING} performance_improvement",
    ),
    "savings_jobs": Report(
        lambda e: savings.savings_jobs(e.gold_jobs, cfg=e.cfg),
        "workspace_name job_id action " + _SAVING.replace("~", "~7"),
    ),
    "total_roi": Report(
        lambda e: e.roi,
        "workspace_name current_monthly_cost~ estimated_monthly_cost~ estimated_monthly_savings~ "
        "estimated_annual_savings~ reduction_percentage~ confidence margin_of_error",
    ),
    "technical_checklist": Report(
        lambda e: reports.technical_checklist(e.issues),
        "workspace_name category issue_type resource_name severity recommended_action status",
    ),
    "prioritized_backlog": Report(
        lambda e: reports.prioritized_backlog(e.issues_of(reports.BACKLOG_KINDS), cfg=e.cfg),
        "workspace_name priority category issue_type resource_id action "
        "estimated_savings_usd_month~ estimated_savings_usd_year~ complexity effort_hours~",
    ),
    "quick_wins": Report(
        lambda e: reports.quick_wins(e.issues_of(reports.QUICK_WIN_KINDS), cfg=e.cfg),
        "workspace_name alert_type category resource_id title action "
        "estimated_savings_usd_month~ estimated_savings_usd_year~ effort_hours~ complexity "
        "urgency",
    ),
    "executive_report": Report(
        lambda e: _flat_report(e.report),
        "workspace_name report_date baseline_date current_maturity_score~8 "
        "current_maturity_level total_issues high_priority_issues medium_priority_issues "
        "recommendations_implemented recommendations_not_implemented regressions_detected "
        "estimated_monthly_savings~ estimated_annual_savings~ reduction_percentage~ new_clusters "
        "new_tables new_jobs statuses critical roi_current_monthly_cost~ "
        "roi_estimated_monthly_cost~ roi_estimated_monthly_savings~ "
        "roi_estimated_annual_savings~ roi_reduction_percentage~ roi_confidence "
        "roi_margin_of_error compute_score~8 storage_score~8 governance_score~8 "
        "pipelines_score~8 observability_score~8 costs_score~8",
    ),
    # ---- published queries
    "kpi_top_clusters": Report(
        lambda e: kpis.kpi_top_clusters(e.flags),
        "workspace_name cluster_name cluster_id num_workers memory_gb~ uptime_hours~ idle_hours~ "
        "utilization_score~ is_idle is_overprovisioned",
    ),
    "kpi_inefficient_jobs": Report(
        lambda e: kpis.kpi_inefficient_jobs(e.gold_jobs),
        "workspace_name job_name job_id total_runs successful_runs failed_runs success_rate~ "
        "failure_rate~ avg_duration_hours~8 efficiency_score~",
    ),
    "kpi_archive_candidates": Report(
        lambda e: kpis.kpi_archive_candidates(e.gold_tables),
        "workspace_name full_table_name size_gb~ size_tb~6 days_since_accessed "
        "days_since_modified is_cold_data is_abandoned storage_tier optimization_priority "
        "estimated_savings_gb~",
    ),
    "kpi_storage_summary": Report(
        lambda e: kpis.kpi_storage_summary(e.storage),
        "workspace_name total_tables total_size_tb~ cold_size_tb~ abandoned_size_tb~ "
        "small_files_size_tb~ cold_data_percentage~ abandoned_data_percentage~ avg_file_size_mb~",
    ),
    "kpi_daily_costs": Report(
        lambda e: kpis.kpi_daily_costs(e.gold_billing, as_of=e.as_of),
        "workspace_name date_parsed daily_cost_usd~6 monthly_cost_usd~6 avg_daily_cost_usd~9",
    ),
    "kpi_maturity_latest": Report(
        lambda e: kpis.kpi_maturity_latest(_both_maturities(e)), _MATURITY
    ),
    "kpi_recommendations": Report(lambda e: kpis.kpi_recommendations(e.recommendations), _REC),
    "q_list_baselines": Report(
        lambda e: kpis.q_list_baselines(_both_baselines(e)),
        "workspace_name baseline_date maturity_score~8 maturity_level estimated_monthly_cost~ "
        "total_clusters total_jobs framework_version",
    ),
    "q_dbu_by_cluster": Report(lambda e: kpis.q_dbu_by_cluster(e.estimates), _EST),
    "q_dbu_summary": Report(
        lambda e: kpis.q_dbu_summary(e.estimates),
        "workspace_name total_clusters total_monthly_cost~ total_dbu_cost~ avg_dbu_per_hour~",
    ),
    "q_allocation_domain": Report(
        lambda e: kpis.q_allocation_domain(e.allocation),
        "workspace_name cost_center business_unit data_domain resource_count "
        "total_monthly_cost~ total_dbu_cost~",
    ),
    "q_unallocated": Report(
        lambda e: kpis.q_unallocated(e.allocation),
        "workspace_name resource_type resource_id resource_name estimated_monthly_cost~",
    ),
    "q_reconciliation_latest": Report(
        lambda e: kpis.q_reconciliation_latest(e.reconciliation),
        "workspace_name estimated_monthly_cost~ actual_cost~ variance~ variance_percentage~ "
        "reconciliation_status confidence recommendation",
    ),
    "q_roi_confidence_label": Report(
        lambda e: kpis.q_roi_confidence_label(e.reconciliation),
        "workspace_name estimated_monthly_cost~ actual_cost~ variance_percentage~ confidence "
        "roi_recommendation",
    ),
    "q_pending_actions": Report(
        lambda e: kpis.q_pending_actions(
            automation.automation_actions(e.flags, as_of=e.as_of, cfg=e.cfg)
        ),
        "workspace_name resource_id resource_name action_type estimated_savings~ risk_level "
        "requires_approval action_command",
    ),
    "q_cost_by_product": Report(
        lambda e: kpis.q_cost_by_product(e.pipelines),
        "workspace_name product_name pipeline_count total_monthly_cost~ avg_cost_per_run~ "
        "total_runs",
    ),
    "q_cost_by_sla": Report(
        lambda e: kpis.q_cost_by_sla(e.pipelines),
        "workspace_name sla_tier pipeline_count total_monthly_cost~ avg_duration~8",
    ),
    "q_benchmark_latest": Report(
        lambda e: kpis.q_benchmark_latest(e.benchmarks),
        "workspace_name benchmark_date cost_per_tb~ cost_per_tb_level cluster_utilization~ "
        "utilization_level job_success_rate~ success_rate_level cold_data_percentage~ "
        "cold_data_level overall_score~ overall_level",
    ),
    "q_benchmark_label": Report(
        lambda e: kpis.q_benchmark_label(e.benchmarks),
        "workspace_name meu_custo_por_tb~ cost_per_tb_level interpretacao",
    ),
    "q_top_pipelines": Report(
        lambda e: kpis.q_top_pipelines(e.pipelines),
        "workspace_name resource_id pipeline_name product_name sla_tier estimated_monthly_cost~ "
        "cost_per_run~ total_runs_monthly avg_duration_hours~8",
    ),
    "q_exec_report": Report(
        lambda e: kpis.q_exec_report(e.report_of("maturity", "issues", "daily")),
        "workspace_name report_date current_maturity_score~8 current_maturity_level total_issues "
        "high_priority_issues estimated_monthly_savings~ estimated_annual_savings~ "
        "reduction_percentage~",
    ),
    "q_recommendation_status": Report(
        lambda e: kpis.q_recommendation_status(e.report_of("statuses")),
        "workspace_name recommendation_title category priority status",
    ),
    "q_quick_wins": Report(
        lambda e: kpis.q_quick_wins(reports.quick_wins(e.issues_of(reports.QUICK_WIN_KINDS), cfg=e.cfg)),
        "workspace_name title category action estimated_savings_usd_month~ "
        "estimated_savings_usd_year~ effort_hours~ complexity",
    ),
    "q_backlog": Report(
        lambda e: kpis.q_backlog(reports.backlog_items(e.issues_of(reports.BACKLOG_KINDS), cfg=e.cfg)),
        "workspace_name priority category action estimated_savings_usd_month~ "
        "estimated_savings_usd_year~ complexity effort_hours~",
    ),
    "q_checklist_by_category": Report(
        lambda e: kpis.q_checklist_by_category(
            reports.technical_checklist(e.issues_of(reports.STORAGE_KINDS)), "storage"
        ),
        "workspace_name category severity issue_type resource_name recommended_action status",
    ),
    "q_roi_analysis": Report(
        lambda e: kpis.q_roi_analysis(e.report_of("issues", "daily")),
        "workspace_name current_monthly_cost~ estimated_monthly_cost~ estimated_monthly_savings~ "
        "estimated_annual_savings~ reduction_percentage~ confidence margin_of_error",
    ),
    "q_new_resources": Report(
        lambda e: kpis.q_new_resources(e.report_of("new_resources")),
        "workspace_name new_clusters new_tables new_jobs report_date",
    ),
    "q_critical_issues": Report(
        lambda e: kpis.q_critical_issues(e.report_of("issues")),
        "workspace_name issue_type resource_id resource_name severity recommended_action",
    ),
    "q_regressions": Report(
        lambda e: kpis.q_regressions(e.report_of("statuses")),
        "workspace_name recommendation_title category priority",
    ),
    "q_validated_statuses": Report(
        lambda e: kpis.q_validated_statuses(e.report_of("statuses")),
        "workspace_name recommendation_title status",
    ),
    "q_score_history": Report(
        lambda e: kpis.q_score_history(_both_maturities(e)).withColumn(
            "scored_on", F.col("process_timestamp").cast("date")
        ),
        "workspace_name scored_on maturity_score~8 maturity_level compute_score~8 storage_score~8",
    ),
    "q_job_schedule_type": Report(
        lambda e: kpis.q_job_schedule_type(e.jobs),
        "workspace_name job_id job_name tipo_execucao",
    ),
    "q_job_run_minutes": Report(
        lambda e: kpis.q_job_run_minutes(e.recent(30), as_of=e.as_of),
        "workspace_name job_id total_runs successful_runs avg_duration_minutes~8",
    ),
    "q_large_tables": Report(
        lambda e: kpis.q_large_tables(e.tables),
        "workspace_name full_table_name size_in_bytes size_gb~ num_files days_since_accessed",
    ),
    "q_daily_cost_currency": Report(
        lambda e: kpis.q_daily_cost_currency(e.billing, as_of=e.as_of),
        "workspace_name date currency daily_cost~6",
    ),
    "q_cluster_status": Report(
        lambda e: kpis.q_cluster_status(e.clusters),
        "workspace_name cluster_id cluster_name num_workers memory_gb~ uptime_hours~ idle_hours~ "
        "status",
    ),
    "q_cluster_class": Report(
        lambda e: kpis.q_cluster_class(e.flags),
        "workspace_name cluster_id cluster_name num_workers uptime_hours~ utilization_score~ "
        "classificacao",
    ),
    "q_table_status": Report(
        lambda e: kpis.q_table_status(e.tables),
        "workspace_name full_table_name size_tb~6 num_files avg_file_size_mb~ status "
        "days_since_accessed",
    ),
    "q_table_action": Report(
        lambda e: kpis.q_table_action(e.gold_tables),
        "workspace_name full_table_name size_tb~6 storage_tier optimization_priority "
        "estimated_savings_gb~ acao",
    ),
    "q_job_status": Report(
        lambda e: kpis.q_job_status(e.gold_jobs),
        "workspace_name job_id job_name total_runs success_rate~ failure_rate~ "
        "avg_duration_hours~8 status",
    ),
    "q_cold_risk": Report(
        lambda e: kpis.q_cold_risk(e.storage),
        "workspace_name total_tables total_size_tb~ cold_data_percentage~ "
        "abandoned_data_percentage~ risco_dados_frios",
    ),
    "q_idle_clusters": Report(
        lambda e: kpis.q_idle_clusters(e.flags),
        "workspace_name cluster_id cluster_name is_idle idle_hours~ uptime_hours~ "
        "utilization_score~",
    ),
    "q_high_recs": Report(lambda e: kpis.q_high_recs(e.recommendations), _REC),
}
