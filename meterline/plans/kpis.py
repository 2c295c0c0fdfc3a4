"""The published report queries as functions.

Each takes layer frames and returns the report for every workspace, or for one
when ``workspace`` is given (that filter reaches the partition folders). A
``LIMIT n`` of the published query is ``n`` rows per workspace; an ``ORDER BY``
is kept, led by the workspace and closed by a unique key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from meterline.functions import columns as C, texts, timeutil as T
from meterline.functions.frames import latest, top_n

WS = "workspace_name"


def _of(df: DataFrame, workspace: str | None) -> DataFrame:
    return df if workspace is None else df.filter(F.col(WS) == workspace)


def _best(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return top_n(df, n, [WS], list(order)).orderBy(WS, *order)


def _label(c: Column, names: Mapping[str, str], otherwise: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for key, text in names.items():
        out = out.when(c == key, F.lit(text))
    return out.otherwise(F.lit(otherwise))


# ---------------------------------------------------------------- indicators


def kpi_top_clusters(gold_clusters: DataFrame, workspace: str | None = None) -> DataFrame:
    rows = _of(gold_clusters, workspace).select(
        WS, "cluster_name", "cluster_id", "num_workers", "memory_gb", "uptime_hours",
        "idle_hours", "utilization_score", "is_idle", "is_overprovisioned",
    )
    return _best(
        rows, 10, F.col("uptime_hours").desc_nulls_last(), F.col("memory_gb").desc_nulls_last(),
        F.col("cluster_id"),
    )


def kpi_inefficient_jobs(gold_jobs: DataFrame, workspace: str | None = None) -> DataFrame:
    rows = _of(gold_jobs, workspace).filter(F.col("total_runs") > 10).select(
        WS, "job_name", "job_id", "total_runs", "successful_runs", "failed_runs",
        "success_rate", "failure_rate", "avg_duration_hours", "efficiency_score",
    )
    return _best(
        rows, 20, F.col("failure_rate").desc(), F.col("avg_duration_hours").desc(), F.col("job_id")
    )


def kpi_archive_candidates(gold_tables: DataFrame, workspace: str | None = None) -> DataFrame:
    rows = _of(gold_tables, workspace).filter(F.col("is_abandoned") | F.col("is_cold_data")).select(
        WS, "full_table_name", "size_gb", "size_tb", "days_since_accessed",
        "days_since_modified", "is_cold_data", "is_abandoned", "storage_tier",
        "optimization_priority", "estimated_savings_gb",
    )
    return _best(rows, 50, F.col("size_gb").desc(), F.col("full_table_name"))


def kpi_storage_summary(summary: DataFrame, workspace: str | None = None) -> DataFrame:
    return _of(summary, workspace).select(
        WS, "total_tables", "total_size_tb", "cold_size_tb", "abandoned_size_tb",
        "small_files_size_tb", "cold_data_percentage", "abandoned_data_percentage",
        "avg_file_size_mb",
    )


def kpi_daily_costs(
    gold_billing: DataFrame, *, as_of: T.AsOf, workspace: str | None = None
) -> DataFrame:
    since = F.date_sub(T.as_of_ts(as_of).cast("date"), 30)
    return (
        _of(gold_billing, workspace)
        .filter(F.col("date_parsed") >= since)
        .select(WS, "date_parsed", "daily_cost_usd", "monthly_cost_usd", "avg_daily_cost_usd")
        .orderBy(WS, F.col("date_parsed").desc())
    )


_SCORES = (
    "maturity_score", "maturity_level", "compute_score", "storage_score", "governance_score",
    "pipelines_score", "observability_score", "costs_score", "process_timestamp",
)


def kpi_maturity_latest(maturity: DataFrame, workspace: str | None = None) -> DataFrame:
    newest = latest(_of(maturity, workspace), [WS], [F.col("process_timestamp").desc()])
    return newest.select(WS, *_SCORES)


def q_score_history(maturity: DataFrame, workspace: str | None = None) -> DataFrame:
    return (
        _of(maturity, workspace)
        .select(WS, "process_timestamp", "maturity_score", "maturity_level", "compute_score",
                "storage_score")
        .orderBy(WS, F.col("process_timestamp").desc())
    )


_REC = (
    "rule_id", "resource_id", "category", "priority", "title", "description", "impact",
    "complexity", "action", "estimated_savings",
)


def kpi_recommendations(recs: DataFrame, workspace: str | None = None) -> DataFrame:
    return (
        _of(recs, workspace)
        .select(WS, *_REC)
        .orderBy(WS, C.priority_order(F.col("priority")), "category", "rule_id", "resource_id")
    )


def q_high_recs(recs: DataFrame, workspace: str | None = None) -> DataFrame:
    category = F.col("category")
    order = (
        F.when(category == "compute", 1).when(category == "storage", 2)
        .when(category == "pipelines", 3).otherwise(4)
    )
    rows = _of(recs, workspace).filter(F.col("priority") == "high").select(WS, *_REC)
    return _best(rows, 10, order, F.col("rule_id"), F.col("resource_id"))


# ---------------------------------------------------------------- baselines and cost


def q_list_baselines(baselines: DataFrame, workspace: str | None = None) -> DataFrame:
    return (
        _of(baselines, workspace)
        .select(WS, "baseline_id", "baseline_date", "maturity_score", "maturity_level",
                "estimated_monthly_cost", "total_clusters", "total_jobs", "framework_version")
        .orderBy(WS, F.col("baseline_date").desc(), "baseline_id")
    )


def q_dbu_by_cluster(estimates: DataFrame, workspace: str | None = None) -> DataFrame:
    return (
        _of(estimates, workspace)
        .select(WS, "cluster_id", "cluster_name", "cluster_type", "num_workers", "uptime_hours",
                "dbu_rate", "dbu_per_hour", "estimated_dbu_cost", "estimated_monthly_cost")
        .orderBy(WS, F.col("estimated_monthly_cost").desc(), "cluster_id")
    )


def q_dbu_summary(estimates: DataFrame, workspace: str | None = None) -> DataFrame:
    return _of(estimates, workspace).groupBy(WS).agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.sum("estimated_monthly_cost").alias("total_monthly_cost"),
        F.sum("estimated_dbu_cost").alias("total_dbu_cost"),
        F.avg("dbu_per_hour").alias("avg_dbu_per_hour"),
    )


def q_allocation_domain(allocation: DataFrame, workspace: str | None = None) -> DataFrame:
    dims = ("cost_center", "business_unit", "data_domain")
    return (
        _of(allocation, workspace)
        .groupBy(WS, *dims)
        .agg(
            F.count(F.lit(1)).alias("resource_count"),
            F.sum("estimated_monthly_cost").alias("total_monthly_cost"),
            F.sum("estimated_dbu_cost").alias("total_dbu_cost"),
        )
        .orderBy(WS, F.col("total_monthly_cost").desc(), *dims)
    )


def q_unallocated(allocation: DataFrame, workspace: str | None = None) -> DataFrame:
    return (
        _of(allocation, workspace)
        .filter(F.col("cost_center").isin(C.UNALLOCATED, ""))
        .select(WS, "resource_type", "resource_id", "resource_name", "estimated_monthly_cost")
        .orderBy(WS, F.col("estimated_monthly_cost").desc(), "resource_type", "resource_id")
    )


def q_reconciliation_latest(reconciliation: DataFrame, workspace: str | None = None) -> DataFrame:
    newest = latest(
        _of(reconciliation, workspace), [WS], [F.col("process_timestamp").desc()]
    )
    return newest.select(
        WS, "reconciliation_date", "estimated_monthly_cost", "actual_cost", "variance",
        "variance_percentage", "reconciliation_status", "confidence", "recommendation",
    )


def q_roi_confidence_label(reconciliation: DataFrame, workspace: str | None = None) -> DataFrame:
    newest = q_reconciliation_latest(reconciliation, workspace)
    return newest.select(
        WS, "estimated_monthly_cost", "actual_cost", "variance_percentage", "confidence",
        _label(F.col("confidence"), texts.ROI_ADVICE, texts.ROI_ADVICE_OTHER).alias(
            "roi_recommendation"
        ),
    )


def q_pending_actions(actions: DataFrame, workspace: str | None = None) -> DataFrame:
    return (
        _of(actions, workspace)
        .filter(~F.col("executed"))
        .select(WS, "resource_id", "resource_name", "action_type", "estimated_savings",
                "risk_level", "requires_approval", "action_command")
        .orderBy(WS, F.col("estimated_savings").desc(), "resource_id")
    )


def q_cost_by_product(pipelines: DataFrame, workspace: str | None = None) -> DataFrame:
    return (
        _of(pipelines, workspace)
        .groupBy(WS, "product_name")
        .agg(
            F.count(F.lit(1)).alias("pipeline_count"),
            F.sum("estimated_monthly_cost").alias("total_monthly_cost"),
            F.avg("cost_per_run").alias("avg_cost_per_run"),
            F.sum("total_runs_monthly").alias("total_runs"),
        )
        .orderBy(WS, F.col("total_monthly_cost").desc(), "product_name")
    )


def q_cost_by_sla(pipelines: DataFrame, workspace: str | None = None) -> DataFrame:
    return (
        _of(pipelines, workspace)
        .groupBy(WS, "sla_tier")
        .agg(
            F.count(F.lit(1)).alias("pipeline_count"),
            F.sum("estimated_monthly_cost").alias("total_monthly_cost"),
            F.avg("avg_duration_hours").alias("avg_duration"),
        )
        .orderBy(WS, F.col("total_monthly_cost").desc(), "sla_tier")
    )


def q_top_pipelines(pipelines: DataFrame, workspace: str | None = None) -> DataFrame:
    rows = _of(pipelines, workspace).select(
        WS, "resource_id", "pipeline_name", "product_name", "sla_tier", "estimated_monthly_cost",
        "cost_per_run", "total_runs_monthly", "avg_duration_hours",
    )
    return _best(rows, 20, F.col("estimated_monthly_cost").desc(), F.col("resource_id"))


def q_benchmark_latest(benchmarks: DataFrame, workspace: str | None = None) -> DataFrame:
    newest = latest(_of(benchmarks, workspace), [WS], [F.col("process_timestamp").desc()])
    return newest.select(
        WS, "benchmark_date", "cost_per_tb", "cost_per_tb_level", "cluster_utilization",
        "utilization_level", "job_success_rate", "success_rate_level", "cold_data_percentage",
        "cold_data_level", "overall_score", "overall_level",
    )


def q_benchmark_label(benchmarks: DataFrame, workspace: str | None = None) -> DataFrame:
    return q_benchmark_latest(benchmarks, workspace).select(
        WS,
        F.col("cost_per_tb").alias("meu_custo_por_tb"),
        "cost_per_tb_level",
        _label(F.col("cost_per_tb_level"), texts.PERCENTILES, texts.PERCENTILE_OTHER).alias(
            "interpretacao"
        ),
    )


# ---------------------------------------------------------------- re-audit reports


def _newest_report(reports: DataFrame, workspace: str | None) -> DataFrame:
    return latest(_of(reports, workspace), [WS], [F.col("report_date").desc()])


def q_exec_report(reports: DataFrame, workspace: str | None = None) -> DataFrame:
    fields = (
        "current_maturity_score", "current_maturity_level", "total_issues",
        "high_priority_issues", "estimated_monthly_savings", "estimated_annual_savings",
        "reduction_percentage",
    )
    return _newest_report(reports, workspace).select(
        WS, "report_date", *[f"executive_summary.{f}" for f in fields]
    )


def _statuses(reports: DataFrame, workspace: str | None) -> DataFrame:
    rec = _of(reports, workspace).select(WS, F.explode("recommendations_status").alias("rec"))
    return rec.select(
        WS, "rec.recommendation_title", "rec.category", "rec.priority", "rec.status",
        "rec.validation_timestamp",
    )


def q_recommendation_status(reports: DataFrame, workspace: str | None = None) -> DataFrame:
    return _statuses(reports, workspace).orderBy(
        WS, C.priority_order(F.col("priority")), F.col("validation_timestamp").desc(),
        "recommendation_title",
    )


def q_regressions(reports: DataFrame, workspace: str | None = None) -> DataFrame:
    rows = _statuses(reports, workspace).filter(F.col("status") == texts.REGRESSION)
    return rows.select(WS, "recommendation_title", "category", "priority")


def q_validated_statuses(reports: DataFrame, workspace: str | None = None) -> DataFrame:
    kept = F.col("status").isin(texts.IMPLEMENTED, texts.REGRESSION)
    return _statuses(reports, workspace).filter(kept).select(
        WS, "recommendation_title", "status", "validation_timestamp"
    )


def q_quick_wins(wins: DataFrame, workspace: str | None = None) -> DataFrame:
    return (
        _of(wins, workspace)
        .select(WS, "title", "category", "description", "action", "estimated_savings_usd_month",
                "estimated_savings_usd_year", "effort_hours", "complexity")
        .orderBy(WS, F.col("estimated_savings_usd_month").desc(), "title")
    )


def q_backlog(backlog: DataFrame, workspace: str | None = None) -> DataFrame:
    return (
        _of(backlog, workspace)
        .select(WS, "priority", "category", "issue", "action", "estimated_savings_usd_month",
                "estimated_savings_usd_year", "complexity", "effort_hours")
        .orderBy(WS, "priority", F.col("estimated_savings_usd_month").desc(), "issue")
    )


def q_checklist_by_category(
    checklist: DataFrame, category: str | None = None, workspace: str | None = None
) -> DataFrame:
    rows = _of(checklist, workspace)
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    return rows.select(
        WS, "category", "severity", "issue_type", "resource_name", "description",
        "recommended_action", "estimated_impact", "status",
    ).orderBy(WS, "category", C.priority_order(F.col("severity")), "issue_type", "resource_name")


def q_roi_analysis(reports: DataFrame, workspace: str | None = None) -> DataFrame:
    fields = (
        "current_monthly_cost", "estimated_monthly_cost", "estimated_monthly_savings",
        "estimated_annual_savings", "reduction_percentage", "confidence", "margin_of_error",
    )
    return _newest_report(reports, workspace).select(WS, *[f"roi_analysis.{f}" for f in fields])


def q_new_resources(reports: DataFrame, workspace: str | None = None) -> DataFrame:
    return _newest_report(reports, workspace).select(
        WS, "new_resources.new_clusters", "new_resources.new_tables", "new_resources.new_jobs",
        "report_date",
    )


def q_critical_issues(reports: DataFrame, workspace: str | None = None) -> DataFrame:
    issue = _of(reports, workspace).select(
        WS, "report_date", F.posexplode("critical_issues").alias("pos", "issue")
    )
    listed = _best(issue, 20, F.col("report_date").desc(), F.col("pos"))
    return listed.select(
        WS, "issue.issue_type", "issue.resource_id", "issue.resource_name", "issue.severity",
        "issue.description", "issue.recommended_action", "issue.estimated_impact",
    )


# ---------------------------------------------------------------- labelled samples


def q_job_schedule_type(bronze_jobs: DataFrame, workspace: str | None = None) -> DataFrame:
    kind = F.when(C.is_present(F.col("schedule")), texts.SCHEDULED).otherwise(texts.MANUAL)
    return _of(bronze_jobs, workspace).select(
        WS, "job_id", "job_name", kind.alias("tipo_execucao")
    )


def q_job_run_minutes(
    runs: DataFrame, *, as_of: T.AsOf, workspace: str | None = None
) -> DataFrame:
    since = T.as_of_ms(as_of) - F.lit(30 * T.MS_PER_DAY).cast("bigint")
    return (
        _of(runs, workspace)
        .filter(F.col("start_time") >= since)
        .groupBy(WS, "job_id")
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if(F.col("result_state") == "SUCCESS").alias("successful_runs"),
            F.avg(F.col("execution_duration") / 60000).alias("avg_duration_minutes"),
        )
    )


def q_large_tables(silver_tables: DataFrame, workspace: str | None = None) -> DataFrame:
    rows = _of(silver_tables, workspace).filter(F.col("size_in_bytes") > 1024**3).select(
        WS, "full_table_name", "size_in_bytes", "size_gb", "num_files", "days_since_accessed"
    )
    return _best(rows, 20, F.col("size_in_bytes").desc(), F.col("full_table_name"))


def q_daily_cost_currency(
    billing: DataFrame, *, as_of: T.AsOf, workspace: str | None = None
) -> DataFrame:
    since = F.date_sub(T.as_of_ts(as_of).cast("date"), 30)
    return (
        _of(billing, workspace)
        .filter(F.col("date").try_cast("date") >= since)
        .groupBy(WS, "date", "currency")
        .agg(F.sum("cost").alias("daily_cost"))
        .orderBy(WS, F.col("date").desc(), "currency")
    )


def q_cluster_status(silver_clusters: DataFrame, workspace: str | None = None) -> DataFrame:
    idle = F.col("idle_hours")
    return (
        _of(silver_clusters, workspace)
        .filter("is_running")
        .select(WS, "cluster_id", "cluster_name", "num_workers", "memory_gb", "uptime_hours",
                "idle_hours",
                C.above(idle, texts.CLUSTER_STATUS, texts.CLUSTER_ACTIVE).alias("status"))
        .orderBy(WS, idle.desc_nulls_last(), "cluster_id")
    )


def q_cluster_class(gold_clusters: DataFrame, workspace: str | None = None) -> DataFrame:
    score = F.col("utilization_score")
    rows = _of(gold_clusters, workspace).select(
        WS, "cluster_id", "cluster_name", "num_workers", "uptime_hours", "utilization_score",
        C.at_least(score, texts.CLUSTER_CLASSES, texts.CLUSTER_WORST).alias("classificacao"),
    )
    return _best(rows, 10, score, F.col("cluster_id"))


def q_table_status(silver_tables: DataFrame, workspace: str | None = None) -> DataFrame:
    gone, cold = F.col("is_abandoned"), F.col("is_cold_data")
    status = (
        F.when(gone, texts.TABLE_GONE).when(cold, texts.TABLE_COLD).otherwise(texts.TABLE_ACTIVE)
    )
    return (
        _of(silver_tables, workspace)
        .filter(gone | cold)
        .select(WS, "full_table_name", "size_tb", "num_files", "avg_file_size_mb",
                status.alias("status"), "days_since_accessed")
        .orderBy(WS, F.col("size_tb").desc(), "full_table_name")
    )


def q_table_action(gold_tables: DataFrame, workspace: str | None = None) -> DataFrame:
    priority = F.col("optimization_priority")
    return (
        _of(gold_tables, workspace)
        .filter(priority.isin("high", "medium"))
        .select(WS, "full_table_name", "size_tb", "storage_tier", "optimization_priority",
                "estimated_savings_gb",
                _label(priority, texts.TABLE_ACTIONS, texts.TABLE_WATCH).alias("acao"))
        .orderBy(WS, F.col("estimated_savings_gb").desc(), "full_table_name")
    )


def q_job_status(gold_jobs: DataFrame, workspace: str | None = None) -> DataFrame:
    rate = F.col("failure_rate")
    return (
        _of(gold_jobs, workspace)
        .filter(F.col("total_runs") > 10)
        .select(WS, "job_id", "job_name", "total_runs", "success_rate", "failure_rate",
                "avg_duration_hours", C.above(rate, texts.JOB_STATUS, texts.JOB_OK).alias("status"))
        .orderBy(WS, rate.desc(), "job_id")
    )


def q_cold_risk(summary: DataFrame, workspace: str | None = None) -> DataFrame:
    cold = F.col("cold_data_percentage")
    return (
        _of(summary, workspace)
        .select(WS, "total_tables", "total_size_tb", "cold_data_percentage",
                "abandoned_data_percentage",
                C.above(cold, texts.COLD_RISK, texts.COLD_LOW).alias("risco_dados_frios"))
        .orderBy(cold.desc(), WS)
    )


def q_idle_clusters(flags: DataFrame, workspace: str | None = None) -> DataFrame:
    rows = _of(flags, workspace).filter("is_idle").select(
        WS, "cluster_id", "cluster_name", "is_idle", "idle_hours", "uptime_hours",
        "utilization_score",
    )
    return _best(rows, 5, F.col("idle_hours").desc(), F.col("cluster_id"))
