"""The SQL behind each registered key: a CTE name or a query over the layer CTEs."""


def _top(source: str, n: int, order: str, where: str = "true") -> str:
    """First ``n`` rows of each workspace."""
    return (
        f"select * from (select *, row_number() over (partition by workspace_name order by {order}) as top_rn "
        f"from {source} where {where}) t where top_rn <= {n}"
    )


BODIES: dict[str, str] = {
    "src_clusters": """
select workspace_name, cloud, cluster_id, cluster_name, state, '' as spark_version, cast(num_workers as integer) as num_workers, cast(0 as integer) as autotermination_minutes, cluster_source,
  nullif(start_time, 0) as start_time, nullif(terminated_time, 0) as terminated_time, nullif(last_activity_time, 0) as last_activity_time, cluster_memory_mb,
  nullif(regexp_extract(coalesce(autoscale, ''), '"max_workers": ([0-9]+)', 1), '') as max_workers, nullif(regexp_extract(custom_tags, '"owner": "([^"]*)"', 1), '') as tag_owner,
  false as is_pinned, '[]' as init_scripts, collect_ms
from fx_clusters""",
    "src_jobs": """
select workspace_name, cloud, job_id, job_name, '' as job_type, cast(1 as integer) as max_concurrent_runs, existing_cluster_id,
  nullif(regexp_extract(coalesce(schedule, ''), '"cron": "([^"]*)"', 1), '') as cron, nullif(regexp_extract(coalesce(tags, ''), '"owner": "([^"]*)"', 1), '') as tag_owner, collect_ms
from fx_jobs""",
    "src_job_runs": """
select workspace_name, cloud, job_id, run_id, '' as run_name, '' as state, result_state, start_ms as start_time, cast(null as bigint) as end_time, setup_duration, execution_duration,
  cast(cleanup_duration as bigint) as cleanup_duration, regexp_extract(cluster_instance, '"cluster_id": "([^"]*)"', 1) as used_cluster, nullif(regexp_extract(error, '"code": "([^"]*)"', 1), '') as error_code
from fx_runs where start_ms >= 996624000000 - 30 * 86400000::bigint""",
    "src_tables": """
select workspace_name, cloud, metastore_type, case when metastore_type = 'unity_catalog' then 'main' end as catalog, db as schema, table_name,
  case when metastore_type = 'unity_catalog' then concat('main.', full_table_name) else full_table_name end as full_table_name, table_type, cast(num_files as integer) as num_files, size_in_bytes,
  cast(case partition_columns when '[]' then 0 when '[''dt'']' then 1 else 2 end as integer) as n_partition_columns, last_modified_ms, last_access_ms, collect_ms
from fx_tables""",
    "lake_inventory": """
select concat(cloud, '_costs') as table_name, true as has_files, true as has_bytes from fx_billing group by cloud""",
    "src_billing_azure": """
select workspace_name, cloud, cast(cost_date as varchar) as date, resource_id, 'cluster' as resource_type, 'rg' as resource_group, cost, currency from fx_billing where cloud = 'azure'""",
    "src_billing_aws": "select *, cast(cost_date as varchar) as date from fx_billing where cloud = 'aws'",
    "src_billing_gcp": """
select *, cast(cost_date as varchar) as date from fx_billing
where cloud = 'gcp' and date_trunc('month', cost_date) between date '2001-08-01' - 1000 and date '2001-08-01'""",
    "src_billing": """
select workspace_name, cloud, cast(cost_date as varchar) as date, resource_id, case when cloud <> 'azure' then service end as service, cost, currency,
  case when cloud = 'azure' then 'cluster' end as resource_type
from fx_billing where cloud <> 'gcp' or date_trunc('month', cost_date) between date '2001-08-01' - 1000 and date '2001-08-01'""",
    "stream_job_runs": "runs_2",
    "stream_daily_cost": "daily_2",
    "gold_jobs_colocated": "gjobs_2",
    "sink_append_evolved": """
select workspace_name, job_id, case when s > 0 then tags end as tags, collect_ms,
  case when s = 2 then (job_id % 100) / 8e0 when s = 1 and job_id % 2 = 1 then job_id * 5e9 else cast(job_id % 100 as double) end as priority,
  case when s = 2 then null when s = 1 and job_id % 2 = 1 then (job_id % 100) / 4e0 else cast(job_id % 100 as double) end as retries, true as has_retries,
  job_id % 100 as detail_a, case when s = 2 or (s = 1 and job_id % 2 = 1) then job_name end as detail_b
from fx_jobs""",
    "sink_replace": """
select workspace_name, job_id, job_name, (schedule is not null and trim(schedule) not in ('', 'null', 'None', '{}', '[]')) as has_schedule, collect_ms
from fx_jobs where case when cast(substr(workspace_name, 4) as integer) % 2 = 0 then s = 2 and workspace_name <> 'ws_4' else s = 0 end""",
    "table_log_inventory": """
with f as (
  select regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') as table_name, p_partkey, p_size % 10 as v, p_partkey % 7 <> 0 as kept, p_partkey % 21 = 0 as back from part)
select table_name, 'delta' as table_type, cast(count(*) filter (where kept or back) as integer) as num_files,
  cast(coalesce(sum(case when back then p_partkey * 500 when kept then p_partkey * 1000 end), 0) as bigint) as size_in_bytes,
  case when cast(right(table_name, 1) as integer) % 2 = 0 then '["dt","region"]' else '["dt"]' end as partition_columns, cast(13 as bigint) as version,
  996624000000 + 86400000::bigint * (max(case when back then v + 4 when kept then v end) - 30) as last_modified_ms, 996624000000 - 17 * 86400000::bigint as last_commit_ms
from f group by table_name""",
    "billing_fx_asof": """
with rates as (
  select 'EUR' as currency, d as valid_from, 1 + (dayofyear(d) % 40) / 100e0 as rate
  from (select distinct cast(o_orderdate as date) as d from orders) t where day(d) in (1, 11, 21))
select b.workspace_name, b.date_parsed, b.resource_id, b.service, b.currency, b.cost, case when b.currency = 'USD' then b.cost else b.cost * coalesce(r.rate, 1e0) end as cost_usd
from billing_2 b asof left join rates r on b.currency = r.currency and b.date_parsed >= r.valid_from""",
    "snapshot_intervals": """
select workspace_name, job_id, job_name, existing_cluster_id, schedule, min(collect_ms) as from_ms, case max(s) when 0 then 994032000000 when 1 then 996624000000 end as to_ms
from (select *, s - row_number() over (partition by workspace_name, job_id, job_name, schedule, existing_cluster_id, tags order by s) as island from fx_jobs) t
group by workspace_name, job_id, job_name, existing_cluster_id, schedule, tags, island""",
    "interval_jobs": """
with seen as (select workspace_name, job_id, min(s) > 0 as is_new from fx_jobs group by all)
select j.s, j.workspace_name, j.job_id, j.job_name, j.existing_cluster_id, j.has_schedule, n.is_new
from (select 0 as s, * from jobs_0 union all select 2, * from jobs_2) j join seen n on j.workspace_name = n.workspace_name and j.job_id = n.job_id""",
    "interval_tables": """
with seen as (select workspace_name, full_table_name, min(s) > 0 as is_new from fx_tables group by all)
select t.s, t.workspace_name, t.full_table_name, t.size_in_bytes, t.num_files, t.days_since_modified, t.days_since_accessed, n.is_new
from (select 0 as s, * from tables_0 union all select 2, * from tables_2) t join seen n on t.workspace_name = n.workspace_name and t.full_table_name = n.full_table_name""",
    "incremental_job_stats": "stats_2",
    "incremental_daily_cost": "daily_2",
    "schema_sketch": """
select count(*) as total_tables, sum(size_tb) as total_size_tb, count(distinct schema) as total_schemas from tables_2""",
    "stream_runs_watermarked": "runs_2",
    "stream_daily_windows": "daily_2",
    "silver_clusters": "clusters_2",
    "silver_jobs": "jobs_2",
    "silver_job_runs": "runs_2",
    "silver_tables": "tables_2",
    "silver_billing": "billing_2",
    "latest_snapshot": "clusters_2",
    "baseline_state": "flags_0",
    "state_tables": "tables_0",
    "state_jobs": "jobs_0",
    "state_recommendations": "recs_0",
    "state_maturity": "maturity_0",
    "runs_lookback": "select * from runs_2 where start_ms >= 996624000000 - 7 * 86400000::bigint",
    "cloud_from_url": """
select workspace_name, case when contains(workspace_url, 'azuredatabricks.net') or contains(workspace_url, 'adb-') then 'azure'
  when contains(workspace_url, 'gcp.databricks.com') then 'gcp' when contains(workspace_url, 'cloud.databricks.com') then 'aws' end as cloud, count(*) as n_rows
from fx_clusters group by all""",
    "workspace_id_from_url": """
select workspace_name, split_part(replace(workspace_url, 'https://', ''), '.', 1) as workspace_id, count(*) as n_rows from fx_clusters group by all""",
    "gold_clusters": "ranked_2",
    "rank_by_uptime": "ranked_2",
    "job_run_stats": "stats_2",
    "gold_jobs": "gjobs_2",
    "gold_tables": "gtables_2",
    "gold_storage_workspace": "storage_2",
    "daily_cost": "daily_2",
    "monthly_cost": "monthly_2",
    "gold_billing": "gbilling_2",
    "dbu_cost": "est_2",
    "workspace_dbu_cost": "wscost_2",
    "cost_per_tb": "cpt_2",
    "tag_allocation": "alloc_2",
    "tag_coverage": "select workspace_name, nct / cast(nullif(nc, 0) as double) as cluster_tag_coverage, njt / cast(nullif(nj, 0) as double) as job_tag_coverage from tags_2",
    "cost_by_domain": """
select workspace_name, 'cost_center' as dimension, cost_center as dimension_value, sum(estimated_monthly_cost) as total_monthly_cost, sum(estimated_dbu_cost) as total_dbu_cost from alloc_2 group by all
union all select workspace_name, 'business_unit', business_unit, sum(estimated_monthly_cost), sum(estimated_dbu_cost) from alloc_2 group by all
union all select workspace_name, 'data_domain', data_domain, sum(estimated_monthly_cost), sum(estimated_dbu_cost) from alloc_2 group by all""",
    "pipeline_names": "select workspace_name, cast(resource_id as bigint) as job_id, pipeline_name, product_name from pipes_2",
    "run_cost_per_job": "jobcost_2",
    "pipeline_costs": "pipes_2",
    "cost_by_product": """
select workspace_name, 'product_name' as dimension, product_name as dimension_value, sum(estimated_monthly_cost) as total_monthly_cost, count(*) as resource_count from pipes_2 group by all
union all select workspace_name, 'pipeline_name', pipeline_name, sum(estimated_monthly_cost), count(*) from pipes_2 group by all
union all select workspace_name, 'sla_tier', sla_tier, sum(estimated_monthly_cost), count(*) from pipes_2 group by all""",
    "score_compute": "s_compute_2",
    "score_storage": "s_storage_2",
    "score_governance": "s_governance_2",
    "score_pipelines": "s_pipelines_2",
    "score_observability": "s_observability_2",
    "score_costs": "s_costs_2",
    "cost_trend_score": "trend_2",
    "actual_monthly_cost": "recent_2",
    "maturity_scores": "maturity_2",
    "create_baseline": "baseline_2",
    "latest_baseline": "baseline_2",
    "compare_baselines": """
select a.workspace_name, a.baseline_date as baseline_1_date, a.maturity_score as baseline_1_score, a.estimated_monthly_cost as baseline_1_cost,
  b.baseline_date as baseline_2_date, b.maturity_score as baseline_2_score, b.estimated_monthly_cost as baseline_2_cost,
  b.maturity_score - a.maturity_score as score_improvement, a.estimated_monthly_cost - b.estimated_monthly_cost as cost_reduction,
  case when a.estimated_monthly_cost > 0 then (a.estimated_monthly_cost - b.estimated_monthly_cost) / a.estimated_monthly_cost * 100 else 0e0 end as cost_reduction_percentage
from baseline_0 a join baseline_2 b on a.workspace_name = b.workspace_name and a.baseline_date < b.baseline_date""",
    "benchmarks": "bench_2",
    "reconcile_billing": "recon_2",
    "roi_confidence": """
select *, case when c >= 0.8e0 then 'high' when c >= 0.6e0 then 'medium' else 'low' end as confidence_level, round(c, 2) as roi_confidence,
  case when c >= 0.8e0 then 'ROI confiável' else 'Revisar estimativas antes de apresentar ROI' end as recommendation
from (
  select workspace_name, estimated_savings, reconciliation_status, variance_percentage,
    round(case when estimated_savings > 10000 then least(base + 0.1e0, 1e0) when estimated_savings < 100 then greatest(base - 0.1e0, 0.3e0) else base end, 12) as c
  from (
    select r.workspace_name, r.estimated_monthly_savings as estimated_savings, coalesce(q.reconciliation_status, 'no_data') as reconciliation_status, q.variance_percentage,
      case when coalesce(q.variance_percentage, 0) <> 0
        then greatest(case q.confidence when 'high' then 0.9e0 when 'medium' then 0.7e0 else 0.5e0 end - least(q.variance_percentage / 100, 0.3e0), 0.3e0)
        else case q.confidence when 'high' then 0.9e0 when 'medium' then 0.7e0 else 0.5e0 end end as base
    from roi_2 r left join recon_2 q on r.workspace_name = q.workspace_name) a) b""",
    "recommendations": "recs_2",
    "audit_storage": "a_storage_2",
    "audit_compute": "a_compute_2",
    "audit_workflows": "a_workflows_2",
    "recommendation_status": "fate",
    "new_clusters": "new_c",
    "new_tables": "new_t",
    "new_jobs": "new_j",
    "new_resources": "newres",
    "table_version_count": "select workspace_name, full_table_name, count(*) as version_count from fx_tables group by all",
    "failure_patterns": _top(
        """(select workspace_name, substr(error, 1, 100) as error_pattern, count(*) as occurrence_count,
  case when count(*) > 10 then 'high' when count(*) > 5 then 'medium' else 'low' end as severity, 'Investigar causa raiz e implementar correção' as recommendation
from runs_2 where is_failed and has_error and start_ms >= 996624000000 - 30 * 86400000::bigint group by workspace_name, substr(error, 1, 100)) f""",
        10,
        "occurrence_count desc, error_pattern",
    ),
    "stage_performance": """
select workspace_name, 100 * a / (a + b + c) as setup_percentage, 100 * b / (a + b + c) as execution_percentage, 100 * c / (a + b + c) as cleanup_percentage,
  case when a > b then 'setup' else 'execution' end as bottleneck
from (select workspace_name, avg(setup_duration) as a, avg(execution_duration) as b, avg(cleanup_duration) as c from runs_2 group by workspace_name) t""",
    "failure_waste": """
select workspace_name, job_id, job_name, failure_rate, failed_runs * 2e0 as waste_cost_monthly, case when failure_rate > 0.3e0 then 'high' else 'medium' end as performance_impact,
  case when failed_runs * 2 > 100 then 'high' when failed_runs * 2 > 50 then 'medium' else 'low' end as cost_impact
from gjobs_2 where failure_rate > 0.1e0""",
    "automation_actions": """
select workspace_name, 'cluster' as resource_type, cluster_id as resource_id, cluster_name as resource_name, 'terminate_idle' as action_type, 'auto' as automation_level,
  idle_hours * 0.5e0 as estimated_savings, 'low' as risk_level, false as requires_approval, idle_hours > 8 as can_execute,
  concat('databricks clusters delete --cluster-id ', cluster_id) as action_command, concat('databricks clusters start --cluster-id ', cluster_id) as rollback_command, false as executed
from flags_2 where idle_hours > 4""",
    "automation_alerts": """
select workspace_name, 'automation_opportunity' as alert_type, 'medium' as severity, 'Oportunidade de Automação: terminate_idle' as title, cluster_id as resource_id, cluster_name as resource_name,
  true as action_available, concat('databricks clusters delete --cluster-id ', cluster_id) as action_command, idle_hours * 0.5e0 as estimated_savings, 'low' as risk_level, true as requires_approval
from flags_2 where idle_hours > 4""",
    "savings_clusters": """
select *, estimated_monthly_savings * 12 as estimated_annual_savings, 0e0 as payback_months
from (
  select workspace_name, cluster_id, 'terminate_idle' as action, coalesce(idle_hours, 0) * num_workers * 15e0 as current_monthly_cost, cast(null as double) as estimated_monthly_cost,
    coalesce(idle_hours, 0) * num_workers * 15e0 as estimated_monthly_savings, 100e0 as reduction_percentage, 'high' as confidence from flags_2
  union all select workspace_name, cluster_id, 'enable_autoscaling', num_workers * 360e0, num_workers * 216e0, num_workers * 144e0, 40e0, 'medium' from flags_2
  union all select workspace_name, cluster_id, 'resize_cluster', num_workers * 360e0, greatest(1, trunc(num_workers * 0.7e0)) * 360e0,
    num_workers * 360e0 - greatest(1, trunc(num_workers * 0.7e0)) * 360e0, 30e0, 'medium' from flags_2) t""",
    "savings_tables": """
select *, estimated_monthly_savings * 12 as estimated_annual_savings, 0e0 as payback_months
from (
  select workspace_name, full_table_name, 'archive_abandoned' as action, size_gb * 0.023e0 as current_monthly_cost, size_gb * 0.023e0 * 0.3e0 as estimated_monthly_cost,
    size_gb * 0.023e0 * 0.7e0 as estimated_monthly_savings, 70e0 as reduction_percentage, 'high' as confidence, cast(null as varchar) as performance_improvement from tables_2
  union all select workspace_name, full_table_name, 'delete_abandoned', size_gb * 0.023e0, 0e0, size_gb * 0.023e0, 100e0, 'high', null from tables_2
  union all select workspace_name, full_table_name, 'optimize_small_files', size_gb * 0.023e0, size_gb * 0.9e0 * 0.023e0, size_gb * 0.1e0 * 0.023e0, 10e0, 'medium', '30-50% em queries' from tables_2) t""",
    "savings_jobs": """
select *, estimated_monthly_savings * 12 as estimated_annual_savings, 0e0 as payback_months
from (
  select workspace_name, job_id, 'fix_failures' as action, coalesce(failed_runs * avg_duration_hours, 0) * 2e0 as current_monthly_cost, coalesce(failed_runs * avg_duration_hours, 0) * 0.4e0 as estimated_monthly_cost,
    coalesce(failed_runs * avg_duration_hours, 0) * 1.6e0 as estimated_monthly_savings, 80e0 as reduction_percentage, 'high' as confidence from gjobs_2
  union all select workspace_name, job_id, 'optimize_long_runs', coalesce(total_runs * avg_duration_hours, 0) * 2e0, coalesce(total_runs * avg_duration_hours, 0) * 1.4e0,
    coalesce(total_runs * avg_duration_hours, 0) * 0.6e0, 30e0, 'medium' from gjobs_2) t""",
    "total_roi": "roi_2",
    "technical_checklist": "select workspace_name, category, issue_type, coalesce(resource_name, table_name, resource_id) as resource_name, severity, recommended_action, 'pending' as status from issues_2",
    "prioritized_backlog": "backlog_2",
    "quick_wins": "select *, m as estimated_savings_usd_month from wins_2",
    "kpi_top_clusters": _top("flags_2", 10, "uptime_hours desc nulls last, memory_gb desc nulls last, cluster_id"),
    "kpi_inefficient_jobs": _top("gjobs_2", 20, "failure_rate desc, avg_duration_hours desc, job_id", "total_runs > 10"),
    "kpi_archive_candidates": _top("gtables_2", 50, "size_gb desc, full_table_name", "is_abandoned or is_cold_data"),
    "kpi_storage_summary": "storage_2",
    "kpi_daily_costs": "select * from gbilling_2 where date_parsed >= date '2001-07-02'",
    "kpi_maturity_latest": "maturity_2",
    "kpi_recommendations": "recs_2",
    "q_list_baselines": "select * from baseline_0 union all select * from baseline_2",
    "q_dbu_by_cluster": "est_2",
    "q_dbu_summary": """
select workspace_name, count(*) as total_clusters, sum(estimated_monthly_cost) as total_monthly_cost, sum(estimated_dbu_cost) as total_dbu_cost, avg(dbu_per_hour) as avg_dbu_per_hour
from est_2 group by workspace_name""",
    "q_allocation_domain": """
select workspace_name, cost_center, business_unit, data_domain, count(*) as resource_count, sum(estimated_monthly_cost) as total_monthly_cost, sum(estimated_dbu_cost) as total_dbu_cost
from alloc_2 group by all""",
    "q_unallocated": "select * from alloc_2 where cost_center in ('unallocated', '')",
    "q_reconciliation_latest": "recon_2",
    "q_roi_confidence_label": """
select *, case confidence when 'high' then 'ROI confiável para apresentação executiva' when 'medium' then 'ROI aceitável, revisar antes de apresentar'
  else 'ROI requer validação adicional' end as roi_recommendation from recon_2""",
    "q_pending_actions": """
select workspace_name, cluster_id as resource_id, cluster_name as resource_name, 'terminate_idle' as action_type, idle_hours * 0.5e0 as estimated_savings, 'low' as risk_level, true as requires_approval,
  concat('databricks clusters delete --cluster-id ', cluster_id) as action_command
from flags_2 where idle_hours > 4""",
    "q_cost_by_product": """
select workspace_name, product_name, count(*) as pipeline_count, sum(estimated_monthly_cost) as total_monthly_cost, avg(cost_per_run) as avg_cost_per_run, cast(sum(total_runs_monthly) as bigint) as total_runs
from pipes_2 group by all""",
    "q_cost_by_sla": """
select workspace_name, sla_tier, count(*) as pipeline_count, sum(estimated_monthly_cost) as total_monthly_cost, avg(avg_duration_hours) as avg_duration from pipes_2 group by all""",
    "q_benchmark_latest": "select *, '2001-08-01T00:00:00' as benchmark_date from bench_2",
    "q_benchmark_label": """
select workspace_name, cost_per_tb as meu_custo_por_tb, cost_per_tb_level, case cost_per_tb_level when 'excellent' then 'Top 10% da indústria' when 'good' then 'Top 25% da indústria'
  when 'average' then 'Mediana da indústria' else 'Abaixo da mediana' end as interpretacao from bench_2""",
    "q_top_pipelines": _top("pipes_2", 20, "estimated_monthly_cost desc, resource_id"),
    "executive_report": """
select n.*, coalesce(x.new_clusters, 0) as new_clusters, coalesce(x.new_tables, 0) as new_tables, coalesce(x.new_jobs, 0) as new_jobs,
  coalesce(s.text, '') as statuses, coalesce(c.text, '') as critical,
  r.current_monthly_cost as roi_current_monthly_cost, r.estimated_monthly_cost as roi_estimated_monthly_cost, r.estimated_monthly_savings as roi_estimated_monthly_savings,
  r.estimated_annual_savings as roi_estimated_annual_savings, r.reduction_percentage as roi_reduction_percentage, r.confidence as roi_confidence, r.margin_of_error as roi_margin_of_error,
  m.compute_score, m.storage_score, m.governance_score, m.pipelines_score, m.observability_score, m.costs_score
from report n left join newres x using (workspace_name) left join roi_2 r using (workspace_name) left join maturity_2 m using (workspace_name)
left join (select workspace_name, string_agg(concat_ws('|', recommendation_title, category, priority, status), ';' order by rule_id, resource_id) as text from fate group by workspace_name) s using (workspace_name)
left join (select workspace_name, string_agg(concat_ws('|', issue_type, resource_id, severity, recommended_action), ';' order by issue_type, resource_id) as text
  from (select *, row_number() over (partition by workspace_name order by issue_type, resource_id) as rn from issues_2 where severity = 'high') h where rn <= 10 group by workspace_name) c using (workspace_name)""",
    "q_exec_report": "report",
    "q_recommendation_status": "fate",
    "q_quick_wins": "select *, m as estimated_savings_usd_month from wins_2",
    "q_backlog": "backlog_2",
    "q_checklist_by_category": """
select workspace_name, category, severity, issue_type, coalesce(resource_name, table_name, resource_id) as resource_name, recommended_action, 'pending' as status
from issues_2 where category = 'storage'""",
    "q_roi_analysis": """
select n.workspace_name, r.current_monthly_cost, r.estimated_monthly_cost, r.estimated_monthly_savings, r.estimated_annual_savings, r.reduction_percentage, r.confidence, r.margin_of_error
from report_names n left join roi_2 r using (workspace_name)""",
    "q_new_resources": """
select n.workspace_name, coalesce(r.new_clusters, 0) as new_clusters, coalesce(r.new_tables, 0) as new_tables, coalesce(r.new_jobs, 0) as new_jobs, '2001-08-01T00:00:00' as report_date
from report_names n left join newres r using (workspace_name)""",
    "q_critical_issues": _top("issues_2", 10, "issue_type, resource_id", "severity = 'high'"),
    "q_regressions": "select * from fate where status = 'regressão'",
    "q_validated_statuses": "select * from fate where status in ('implementada', 'regressão')",
    "q_score_history": """
select workspace_name, date '2001-06-02' as scored_on, maturity_score, maturity_level, compute_score, storage_score from maturity_0
union all select workspace_name, date '2001-08-01', maturity_score, maturity_level, compute_score, storage_score from maturity_2""",
    "q_job_schedule_type": """
select workspace_name, job_id, job_name, case when schedule is not null and trim(schedule) not in ('', 'null', 'None', '{}', '[]') then 'Agendado' else 'Manual' end as tipo_execucao from jobs_2""",
    "q_job_run_minutes": """
select workspace_name, job_id, count(*) as total_runs, count(*) filter (where result_state = 'SUCCESS') as successful_runs, avg(execution_duration / 60000e0) as avg_duration_minutes
from runs_2 where start_ms >= 996624000000 - 30 * 86400000::bigint group by workspace_name, job_id""",
    "q_large_tables": _top("tables_2", 20, "size_in_bytes desc, full_table_name", "size_in_bytes > 1073741824"),
    "q_daily_cost_currency": """
select workspace_name, cast(date_parsed as varchar) as date, currency, sum(cost) as daily_cost from billing_2 where date_parsed >= date '2001-07-02' group by all""",
    "q_cluster_status": "select *, case when idle_hours > 4 then 'Ocioso' when idle_hours > 2 then 'Subutilizado' else 'Ativo' end as status from clusters_2 where is_running",
    "q_cluster_class": _top(
        """(select *, case when utilization_score >= 0.8e0 then 'Otimizado' when utilization_score >= 0.6e0 then 'Bom' when utilization_score >= 0.4e0 then 'Regular' else 'Ruim' end as classificacao from flags_2) c""",
        10,
        "utilization_score, cluster_id",
    ),
    "q_table_status": """
select *, case when is_abandoned then 'Abandonada' when is_cold_data then 'Fria' else 'Ativa' end as status from tables_2 where is_abandoned or is_cold_data""",
    "q_table_action": """
select *, case optimization_priority when 'high' then 'Ação Imediata' when 'medium' then 'Planejar Ação' else 'Monitorar' end as acao from gtables_2 where optimization_priority in ('high', 'medium')""",
    "q_job_status": """
select *, case when failure_rate > 0.2e0 then 'Crítico' when failure_rate > 0.1e0 then 'Atenção' else 'OK' end as status from gjobs_2 where total_runs > 10""",
    "q_cold_risk": "select *, case when cold_data_percentage > 30 then 'Alto' when cold_data_percentage > 15 then 'Médio' else 'Baixo' end as risco_dados_frios from storage_2",
    "q_idle_clusters": _top("flags_2", 5, "idle_hours desc, cluster_id", "is_idle"),
    "q_high_recs": _top(
        "recs_2", 10, "case category when 'compute' then 1 when 'storage' then 2 when 'pipelines' then 3 else 4 end, rule_id, resource_id", "priority = 'high'"
    ),
}
