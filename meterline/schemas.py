"""Declared schemas of every layer table, and where each one lives.

Column names and types are fixed values: they are the data contract.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_COMPUTE_CLUSTERS = """
workspace_name string, workspace_url string, cloud string, cluster_id string, cluster_name string,
state string, spark_version string, node_type_id string, driver_node_type_id string,
num_workers int, autotermination_minutes int, enable_elastic_disk boolean, cluster_source string,
spark_conf string, aws_attributes string, azure_attributes string, gcp_attributes string,
start_time bigint, terminated_time bigint, last_state_loss_time bigint, last_activity_time bigint,
cluster_memory_mb double, cluster_cores double, default_tags string, creator_user_name string,
custom_tags string, cluster_log_conf string, spark_env_vars string, autoscale string,
is_pinned boolean, is_high_availability boolean, init_scripts string,
enable_local_disk_encryption boolean, data_security_mode string, runtime_engine string,
photon boolean, single_user_name string, collect_timestamp timestamp
"""

_COMPUTE_JOBS = """
workspace_name string, workspace_url string, cloud string, job_id bigint, job_name string,
job_type string, timeout_seconds int, max_concurrent_runs int, schedule string,
notebook_task string, spark_python_task string, spark_jar_task string, spark_submit_task string,
new_cluster string, existing_cluster_id string, libraries string, email_notifications string,
webhook_notifications string, tags string, format string, collect_timestamp timestamp
"""

_COMPUTE_JOB_RUNS = """
workspace_name string, workspace_url string, cloud string, job_id bigint, run_id bigint,
run_name string, state string, result_state string, start_time bigint, end_time bigint,
setup_duration bigint, execution_duration bigint, cleanup_duration bigint, trigger string,
cluster_instance string, cluster_spec string, overriding_parameters string, tasks string,
error string, collect_timestamp timestamp
"""

_STORAGE_TABLES = """
workspace_name string, workspace_url string, cloud string, metastore_type string, catalog string,
schema string, table_name string, full_table_name string, table_type string, location string,
provider string, num_files int, size_in_bytes bigint, partition_columns string,
last_modified timestamp, last_access timestamp, collect_timestamp timestamp
"""

_BILLING_COSTS = """
workspace_name string, workspace_url string, cloud string, date string, resource_id string,
resource_type string, resource_group string, service string, cost double, currency string,
collect_timestamp timestamp
"""

# Silver keeps every bronze column and adds these.
_SILVER_ADDS = {
    "compute_clusters": """is_running boolean, is_terminated boolean, has_autoscaling boolean,
        is_serverless boolean, uptime_hours double, idle_hours double, memory_gb double,
        estimated_cost_per_hour double, process_timestamp timestamp""",
    "compute_jobs": """uses_existing_cluster boolean, has_schedule boolean,
        process_timestamp timestamp""",
    "compute_job_runs": """duration_seconds double, duration_hours double, is_success boolean,
        is_failed boolean, is_cancelled boolean, has_error boolean, start_month date,
        process_timestamp timestamp""",
    "storage_tables": """size_gb double, size_tb double, avg_file_size_mb double,
        days_since_modified int, days_since_accessed int, is_partitioned boolean,
        is_delta boolean, has_small_files boolean, is_cold_data boolean, is_abandoned boolean,
        process_timestamp timestamp""",
    "billing_costs": """cost_usd double, date_parsed date, year int, month int, day int,
        process_timestamp timestamp""",
}

_GOLD = {
    "compute_clusters_summary": """workspace_name string, cluster_id string, cluster_name string,
        state string, num_workers int, memory_gb double, uptime_hours double, idle_hours double,
        is_idle boolean, is_overprovisioned boolean, utilization_score double,
        has_autoscaling boolean, rank_by_uptime int, process_timestamp timestamp""",
    "compute_jobs_summary": """workspace_name string, job_id bigint, job_name string,
        job_type string, uses_existing_cluster boolean, has_schedule boolean, total_runs bigint,
        successful_runs bigint, failed_runs bigint, avg_duration_hours double,
        max_duration_hours double, min_duration_hours double, total_duration_hours double,
        success_rate double, failure_rate double, efficiency_score double,
        process_timestamp timestamp""",
    "storage_tables_summary": """workspace_name string, catalog string, schema string,
        table_name string, full_table_name string, table_type string, size_gb double,
        size_tb double, num_files int, avg_file_size_mb double, days_since_modified int,
        days_since_accessed int, is_partitioned boolean, is_delta boolean,
        has_small_files boolean, is_cold_data boolean, is_abandoned boolean, storage_tier string,
        optimization_priority string, estimated_savings_gb double, process_timestamp timestamp""",
    "storage_workspace_summary": """workspace_name string, total_tables bigint,
        total_size_tb double, cold_size_tb double, abandoned_size_tb double,
        small_files_size_tb double, total_schemas bigint, avg_file_size_mb double,
        cold_data_percentage double, abandoned_data_percentage double,
        process_timestamp timestamp""",
    "billing_costs_summary": """workspace_name string, date_parsed date, year int, month int,
        daily_cost_usd double, monthly_cost_usd double, avg_daily_cost_usd double,
        process_timestamp timestamp""",
    "maturity_scores": """workspace_name string, maturity_score double, maturity_level string,
        compute_score double, storage_score double, governance_score double,
        pipelines_score double, observability_score double, costs_score double,
        process_timestamp timestamp""",
    "recommendations": """workspace_name string, rule_id string, resource_id string,
        category string, priority string, title string, description string, impact string,
        complexity string, action string, estimated_savings string,
        process_timestamp timestamp""",
    "assessment_baselines": """baseline_id string, workspace_name string, baseline_date date,
        cloud string, framework_version string, maturity_score double, maturity_level string,
        compute_score double, storage_score double, governance_score double,
        pipelines_score double, observability_score double, costs_score double,
        estimated_monthly_cost double, estimated_annual_cost double, total_clusters int,
        total_jobs int, total_tables bigint, total_storage_tb double,
        context struct<num_workspaces:int,primary_use_case:string,team_size:int,notes:string>,
        process_timestamp timestamp""",
    "cost_allocation": """workspace_name string, resource_type string, resource_id string,
        resource_name string, cost_center string, business_unit string, data_domain string,
        estimated_monthly_cost double, estimated_dbu_cost double, allocation_method string,
        tags struct<cost_center:string,business_unit:string,data_domain:string,project:string,owner:string>,
        process_timestamp timestamp""",
    "costs_dbu_estimates": """workspace_name string, cloud string, cluster_id string,
        cluster_name string, cluster_type string, num_workers int, is_running boolean,
        uptime_hours double, dbu_rate double, dbu_per_hour double, estimated_dbu_cost double,
        estimated_monthly_cost double, process_timestamp timestamp""",
    "cost_allocation_pipelines": """workspace_name string, resource_type string,
        resource_id string, resource_name string, pipeline_name string, product_name string,
        sla_tier string, estimated_monthly_cost double, estimated_dbu_cost double,
        cost_per_run double, total_runs_monthly bigint, avg_duration_hours double,
        allocation_method string, process_timestamp timestamp""",
    "billing_reconciliation": """workspace_name string, reconciliation_date string,
        estimated_monthly_cost double, actual_cost double, variance double,
        variance_percentage double, reconciliation_status string, confidence string,
        recommendation string, process_timestamp timestamp""",
    "automation_actions": """workspace_name string, resource_type string, resource_id string,
        resource_name string, action_type string, automation_level string, condition string,
        estimated_savings double, risk_level string, requires_approval boolean,
        can_execute boolean, action_command string, rollback_command string,
        alert_message string, executed boolean, executed_at timestamp, generated_at timestamp""",
    "observability_enhanced": """workspace_name string, analysis_type string, metric_name string,
        metric_value double, benchmark_level string, recommendation string,
        analysis_date timestamp""",
    "benchmarks": """workspace_name string, benchmark_date string, cost_per_tb double,
        cost_per_tb_level string, cluster_utilization double, utilization_level string,
        job_success_rate double, success_rate_level string, cold_data_percentage double,
        cold_data_level string, overall_score double, overall_level string,
        process_timestamp timestamp""",
    "rule_conditions": """workspace_name string, rule_id string, resource_id string,
        snapshot_timestamp timestamp, measure double""",
    "audit_issues": """workspace_name string, issue_type string, category string,
        resource_id string, resource_name string, table_name string, severity string,
        description string, recommended_action string, estimated_impact string,
        idle_hours double, num_workers int, size_gb double, failed_runs bigint,
        avg_duration_hours double, validation_timestamp timestamp""",
    "executive_reports": """workspace_name string, report_date string, baseline_date string,
        executive_summary struct<current_maturity_score:double,current_maturity_level:string,
            total_issues:int,high_priority_issues:int,medium_priority_issues:int,
            recommendations_implemented:int,recommendations_not_implemented:int,
            regressions_detected:int,estimated_monthly_savings:double,
            estimated_annual_savings:double,reduction_percentage:double>,
        new_resources struct<new_clusters:int,new_tables:int,new_jobs:int>,
        recommendations_status array<struct<workspace_name:string,recommendation_title:string,
            category:string,priority:string,status:string,baseline_date:string,
            validation_timestamp:timestamp>>,
        critical_issues array<struct<workspace_name:string,issue_type:string,table_name:string,
            resource_id:string,resource_name:string,severity:string,description:string,
            recommended_action:string,estimated_impact:string,validation_timestamp:timestamp>>,
        roi_analysis struct<workspace_name:string,current_monthly_cost:double,
            estimated_monthly_cost:double,estimated_monthly_savings:double,
            estimated_annual_savings:double,reduction_percentage:double,confidence:string,
            margin_of_error:string,calculation_timestamp:timestamp>,
        maturity_breakdown struct<compute_score:double,storage_score:double,
            governance_score:double,pipelines_score:double,observability_score:double,
            costs_score:double>""",
    "technical_checklist": """workspace_name string, category string, issue_type string,
        resource_name string, severity string, description string, recommended_action string,
        estimated_impact string, status string, validation_timestamp timestamp""",
    "prioritized_backlog": """workspace_name string, priority int, category string,
        issue string, action string, estimated_savings_usd_month double,
        estimated_savings_usd_year double, complexity string, effort_hours double""",
    "quick_wins": """workspace_name string, alert_type string, category string, title string,
        description string, action string, estimated_savings_usd_month double,
        estimated_savings_usd_year double, effort_hours double, complexity string,
        urgency string""",
}


def struct_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(" ".join(ddl.split()))  # type: ignore[return-value]


@dataclass(frozen=True)
class Table:
    """Where a logical table lives and how it is laid out."""

    layer: str
    name: str
    ddl: str
    partition_by: tuple[str, ...]
    sort_by: tuple[str, ...] = ()
    append: bool = False  # history tables grow; the others hold current state

    @property
    def logical(self) -> str:
        return f"{self.layer}.{self.name}"

    @property
    def view(self) -> str:
        return f"{self.layer}_{self.name}"

    @property
    def schema(self) -> T.StructType:
        return struct_of(self.ddl)

    def path(self, warehouse: str) -> str:
        return f"{warehouse.rstrip('/')}/{self.layer}/{self.name}"


# Folders: the workspace everywhere (its cloud follows from it), months for the two
# big facts, and a day level above them for history tables (added by the writer). Finer
# folders, by category or product, would hold a handful of rows each.
_BY_WORKSPACE = ("workspace_name",)

# bronze table -> (columns, order inside files)
_BRONZE = {
    "compute_clusters": (_COMPUTE_CLUSTERS, ("cluster_id",)),
    "compute_jobs": (_COMPUTE_JOBS, ("job_id",)),
    "compute_job_runs": (_COMPUTE_JOB_RUNS, ("start_time",)),
    "storage_tables": (_STORAGE_TABLES, ("full_table_name",)),
    "billing_costs": (_BILLING_COSTS, ("date",)),
}

_SILVER_PARTITIONS = {
    "compute_job_runs": ("workspace_name", "start_month"),
    "billing_costs": ("workspace_name", "year", "month"),
}

# Mergeable partial results, by the months whose rows they sum up.
_PARTIALS = {
    "job_run_months": (
        """workspace_name string, job_id bigint, start_month date, total_runs bigint,
        successful_runs bigint, failed_runs bigint, timed_runs bigint, sum_duration_hours double,
        max_duration_hours double, min_duration_hours double""",
        ("start_month",),
    ),
    "daily_costs": (
        """workspace_name string, date_parsed date, year int, month int, daily_cost_usd double""",
        ("year", "month"),
    ),
    "folded_days": (
        """table_name string, snapshot_date date, n_files bigint, n_bytes bigint,
        process_timestamp timestamp""",
        ("table_name",),
    ),
}

# Gold tables that keep one set of rows per assessment.
_GOLD_HISTORY = {
    "maturity_scores",
    "recommendations",
    "assessment_baselines",
    "billing_reconciliation",
    "benchmarks",
    "rule_conditions",
    "executive_reports",
    "cost_allocation",
    "cost_allocation_pipelines",
    "automation_actions",
}


def _catalog() -> dict[str, Table]:
    tables: list[Table] = []
    for name, (ddl, order) in _BRONZE.items():
        tables.append(Table("bronze", name, ddl, _BY_WORKSPACE, order, append=True))
        parts = _SILVER_PARTITIONS.get(name, _BY_WORKSPACE)
        tables.append(Table("silver", name, f"{ddl}, {_SILVER_ADDS[name]}", parts, order))
    for name, ddl in _GOLD.items():
        tables.append(Table("gold", name, ddl, _BY_WORKSPACE, (), name in _GOLD_HISTORY))
    for name, (ddl, parts) in _PARTIALS.items():
        tables.append(Table("gold", name, ddl, parts))
    return {t.logical: t for t in tables}


TABLES: dict[str, Table] = _catalog()
