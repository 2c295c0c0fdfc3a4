"""Layer CTEs. ``@S`` is the snapshot number an assessment stands at, ``@NOW`` its instant.

Numbers are written ``0.5e0`` because a bare ``0.5`` is a DECIMAL.
"""

LAYERS = {
    # ------------------------------------------------------------ silver
    "clusters_@S": """
select workspace_name, workspace_url, cloud, cluster_id, cluster_name, state, cast(num_workers as integer) as num_workers, cluster_source, custom_tags,
  state = 'RUNNING' as is_running, state = 'TERMINATED' as is_terminated,
  (autoscale is not null and trim(autoscale) not in ('', 'null', 'None', '{}', '[]')) as has_autoscaling,
  cluster_source <> 'UI' as is_serverless, nullif(start_time, 0) as started,
  (nullif(terminated_time, 0) - nullif(start_time, 0)) / 3600000e0 as uptime_hours,
  case when nullif(start_time, 0) is not null then (@NOW - nullif(last_activity_time, 0)) / 3600000e0 end as idle_hours,
  cluster_memory_mb / 1024 as memory_gb, cast(0 as double) as estimated_cost_per_hour
from (select *, rank() over (partition by workspace_name order by s desc) as rn from fx_clusters where s <= @S) t
where rn = 1
""",
    "jobs_@S": """
select workspace_name, cloud, job_id, job_name, existing_cluster_id, tags, existing_cluster_id <> '' as uses_existing_cluster,
  (schedule is not null and trim(schedule) not in ('', 'null', 'None', '{}', '[]')) as has_schedule, schedule
from (select *, rank() over (partition by workspace_name order by s desc) as rn from fx_jobs where s <= @S) t
where rn = 1
""",
    "runs_@S": """
select workspace_name, cloud, job_id, run_id, result_state, start_ms, execution_duration, setup_duration, cast(cleanup_duration as bigint) as cleanup_duration, cluster_instance, error,
  execution_duration / 1000e0 as duration_seconds, execution_duration / 3600000e0 as duration_hours,
  result_state = 'SUCCESS' as is_success, result_state = 'FAILED' as is_failed, result_state = 'CANCELLED' as is_cancelled,
  (error is not null and trim(error) not in ('', 'null', 'None', '{}', '[]')) as has_error
from (select *, row_number() over (partition by workspace_name, run_id order by collect_ms desc) as rn
      from fx_runs where collect_ms <= @NOW) t
where rn = 1
""",
    "tables_@S": """
select *, coalesce(days_since_accessed, days_since_modified) > 90 as is_cold_data, coalesce(days_since_accessed, days_since_modified) > 180 as is_abandoned,
  avg_file_size_mb < 128 as has_small_files
from (
  select workspace_name, cloud, metastore_type, db as schema, table_name, full_table_name, table_type, cast(num_files as integer) as num_files, size_in_bytes,
    size_in_bytes / 1073741824e0 as size_gb, size_in_bytes / 1099511627776e0 as size_tb,
    case when num_files > 0 then size_in_bytes / cast(num_files as double) / 1048576e0 else 0e0 end as avg_file_size_mb,
    cast((@NOW - last_modified_ms) // 86400000 as integer) as days_since_modified,
    cast((@NOW - last_access_ms) // 86400000 as integer) as days_since_accessed,
    partition_columns <> '[]' as is_partitioned, table_type = 'delta' as is_delta
  from (select *, rank() over (partition by workspace_name order by s desc) as rn from fx_tables where s <= @S) t
  where rn = 1) u
""",
    "billing_@S": """
select workspace_name, cloud, cost_date as date_parsed, cast(year(cost_date) as integer) as year, cast(month(cost_date) as integer) as month,
  cast(day(cost_date) as integer) as day, resource_id, service, cost, currency, cost as cost_usd
from (select *, max(collect_ms) over (partition by workspace_name, cloud, cost_date) as newest from fx_billing where collect_ms <= @NOW) t
where collect_ms = newest
""",
    # ------------------------------------------------------------ gold
    "flags_@S": """
select workspace_name, cluster_id, cluster_name, state, num_workers, memory_gb, uptime_hours, idle_hours, has_autoscaling,
  coalesce(idle_hours > 4, false) as is_idle, coalesce(num_workers > 10 and idle_hours > 2, false) as is_overprovisioned,
  case when idle_hours is null then 0.5e0 when idle_hours < 1 then 1e0 when idle_hours < 4 then 0.7e0 when idle_hours < 8 then 0.4e0 else 0.1e0 end as utilization_score
from clusters_@S
""",
    "ranked_@S": """
select *, cast(rank() over (partition by workspace_name order by uptime_hours desc nulls last) as integer) as rank_by_uptime from flags_@S
""",
    "stats_@S": """
select *, successful_runs / cast(total_runs as double) as success_rate, failed_runs / cast(total_runs as double) as failure_rate,
  case when successful_runs / cast(total_runs as double) >= 0.95e0 then 1e0 when successful_runs / cast(total_runs as double) >= 0.8e0 then 0.7e0
       when successful_runs / cast(total_runs as double) >= 0.6e0 then 0.4e0 else 0.1e0 end as efficiency_score
from (select workspace_name, job_id, count(*) as total_runs, count(*) filter (where is_success) as successful_runs, count(*) filter (where is_failed) as failed_runs,
        avg(duration_hours) as avg_duration_hours, max(duration_hours) as max_duration_hours, min(duration_hours) as min_duration_hours, sum(duration_hours) as total_duration_hours
      from runs_@S group by workspace_name, job_id) t
""",
    "gjobs_@S": """
select j.workspace_name, j.job_id, j.job_name, j.uses_existing_cluster, j.has_schedule, r.total_runs, r.successful_runs, r.failed_runs,
  r.avg_duration_hours, r.max_duration_hours, r.min_duration_hours, r.total_duration_hours, r.success_rate, r.failure_rate, r.efficiency_score
from jobs_@S j left join stats_@S r on j.workspace_name = r.workspace_name and j.job_id = r.job_id
""",
    "gtables_@S": """
select *, case when is_cold_data then 'cold' when days_since_accessed > 30 then 'warm' else 'hot' end as storage_tier,
  case when is_abandoned then 'high' when has_small_files and size_gb > 100 then 'high' when is_cold_data and size_gb > 10 then 'medium'
       when not is_partitioned and size_gb > 50 then 'medium' else 'low' end as optimization_priority,
  case when is_abandoned then size_gb when is_cold_data then size_gb * 0.5e0 else 0e0 end as estimated_savings_gb
from tables_@S
""",
    "storage_@S": """
select *, case when total_size_tb > 0 then cold_size_tb / total_size_tb * 100 else 0e0 end as cold_data_percentage,
  case when total_size_tb > 0 then abandoned_size_tb / total_size_tb * 100 else 0e0 end as abandoned_data_percentage
from (select workspace_name, count(*) as total_tables, sum(size_tb) as total_size_tb,
        sum(case when is_cold_data then size_tb else 0e0 end) as cold_size_tb, sum(case when is_abandoned then size_tb else 0e0 end) as abandoned_size_tb,
        sum(case when has_small_files then size_tb else 0e0 end) as small_files_size_tb, count(distinct schema) as total_schemas, avg(avg_file_size_mb) as avg_file_size_mb
      from tables_@S group by workspace_name) t
""",
    "daily_@S": "select workspace_name, date_parsed, sum(cost_usd) as daily_cost_usd from billing_@S group by workspace_name, date_parsed",
    "monthly_@S": """
select workspace_name, cast(year(date_parsed) as integer) as year, cast(month(date_parsed) as integer) as month,
  sum(daily_cost_usd) as monthly_cost_usd, avg(daily_cost_usd) as avg_daily_cost_usd
from daily_@S group by all
""",
    "gbilling_@S": """
select d.workspace_name, d.date_parsed, m.year, m.month, d.daily_cost_usd, m.monthly_cost_usd, m.avg_daily_cost_usd
from daily_@S d left join monthly_@S m on d.workspace_name = m.workspace_name and year(d.date_parsed) = m.year and month(d.date_parsed) = m.month
""",
    # ------------------------------------------------------------ cost and allocation
    "est_@S": """
select *, estimated_dbu_cost * 30 / case when uptime_hours > 0 then uptime_hours else 1e0 end as estimated_monthly_cost
from (
  select *, case when uptime_hours is not null then uptime_hours * dbu_per_hour
                 when is_running then coalesce((@NOW - started) / 3600000e0 * dbu_per_hour, 0e0) else 0e0 end as estimated_dbu_cost
  from (
    select *, case when num_workers > 0 then (num_workers + 1) * dbu_rate else dbu_rate end as dbu_per_hour
    from (
      select workspace_name, cloud, cluster_id, cluster_name, num_workers, is_running, uptime_hours, started,
        case cluster_source when 'UI' then 'all_purpose' when 'JOB' then 'jobs' else 'compute' end as cluster_type,
        case cluster_source when 'UI' then 0.55e0 else 0.15e0 end as dbu_rate
      from clusters_@S) a) b) c
""",
    "wscost_@S": """
select workspace_name, round(sum(estimated_dbu_cost), 2) as total_estimated_dbu_cost, round(sum(estimated_monthly_cost), 2) as total_estimated_monthly_cost,
  count(*) as clusters_count, count(*) filter (where is_running) as running_clusters, cast(sum(num_workers) as bigint) as total_workers
from est_@S group by workspace_name
""",
    "cpt_@S": """
select coalesce(e.workspace_name, s.workspace_name) as workspace_name, e.monthly_cost, s.total_size_tb,
  case when e.monthly_cost <> 0 and s.total_size_tb <> 0 then e.monthly_cost / s.total_size_tb end as cost_per_tb
from (select workspace_name, sum(estimated_monthly_cost) as monthly_cost from est_@S group by workspace_name) e
full join storage_@S s on e.workspace_name = s.workspace_name
""",
    "alloc_@S": """
select workspace_name, resource_type, resource_id, resource_name, case when cc = '' then 'unallocated' else cc end as cost_center,
  case when bu = '' then 'unallocated' else bu end as business_unit, case when dd = '' then 'unallocated' else dd end as data_domain,
  estimated_monthly_cost, estimated_dbu_cost, case when cc <> '' then 'tags' else 'default' end as allocation_method, owner as tag_owner
from (
  select workspace_name, resource_type, resource_id, resource_name, estimated_monthly_cost, estimated_dbu_cost,
    coalesce(nullif(regexp_extract(raw, '"cost_center": "([^"]*)"', 1), ''), nullif(regexp_extract(raw, '"CostCenter": "([^"]*)"', 1), ''), '') as cc,
    coalesce(nullif(regexp_extract(raw, '"business_unit": "([^"]*)"', 1), ''), nullif(regexp_extract(raw, '"BusinessUnit": "([^"]*)"', 1), ''), '') as bu,
    coalesce(nullif(regexp_extract(raw, '"data_domain": "([^"]*)"', 1), ''), nullif(regexp_extract(raw, '"DataDomain": "([^"]*)"', 1), ''), '') as dd,
    coalesce(nullif(regexp_extract(raw, '"owner": "([^"]*)"', 1), ''), nullif(regexp_extract(raw, '"Owner": "([^"]*)"', 1), ''), '') as owner
  from (
    select c.workspace_name, 'cluster' as resource_type, c.cluster_id as resource_id, c.cluster_name as resource_name,
      coalesce(e.estimated_monthly_cost, 0e0) as estimated_monthly_cost, coalesce(e.estimated_dbu_cost, 0e0) as estimated_dbu_cost, coalesce(c.custom_tags, '') as raw
    from clusters_@S c left join est_@S e on c.workspace_name = e.workspace_name and c.cluster_id = e.cluster_id
    union all
    select workspace_name, 'job', cast(job_id as varchar), job_name, 0e0, 0e0, coalesce(tags, '') from jobs_@S) a) b
""",
    "jobcost_@S": """
select r.workspace_name, r.job_id, sum(e.estimated_dbu_cost) as total_dbu_cost, avg(e.estimated_dbu_cost) as avg_dbu_cost_per_run, count(*) as total_runs,
  avg(r.duration_hours) as avg_duration_hours
from (select *, regexp_extract(cluster_instance, '"cluster_id": "([^"]*)"', 1) as cid from runs_@S where start_ms >= @NOW - 30 * 86400000::bigint) r
left join est_@S e on r.workspace_name = e.workspace_name and r.cid = e.cluster_id
group by r.workspace_name, r.job_id
""",
    "pipes_@S": """
select j.workspace_name, cast(j.job_id as varchar) as resource_id, j.job_name as resource_name, split_part(j.job_name, '_', 1) as pipeline_name,
  case when contains(j.job_name, '-') then split_part(j.job_name, '-', 1) else 'default' end as product_name,
  case when coalesce(c.avg_duration_hours, 0) < 0.5e0 then 'fast' when coalesce(c.avg_duration_hours, 0) > 4 then 'slow' else 'standard' end as sla_tier,
  coalesce(c.total_dbu_cost, 0e0) * 30 as estimated_monthly_cost, coalesce(c.total_dbu_cost, 0e0) as estimated_dbu_cost,
  coalesce(c.avg_dbu_cost_per_run, 0e0) as cost_per_run, coalesce(c.total_runs, 0) as total_runs_monthly, coalesce(c.avg_duration_hours, 0e0) as avg_duration_hours
from jobs_@S j left join jobcost_@S c on j.workspace_name = c.workspace_name and j.job_id = c.job_id
""",
    # ------------------------------------------------------------ scores
    "mclusters_@S": """
select workspace_name, count(*) as n, avg(utilization_score) as util, count(*) filter (where is_idle) / cast(count(*) as double) as idle_ratio,
  count(*) filter (where has_autoscaling) / cast(count(*) as double) as auto_ratio
from flags_@S group by workspace_name
""",
    "mjobs_@S": """
select workspace_name, count(*) as n, avg(success_rate) as success, avg(efficiency_score) as eff, count(*) filter (where has_schedule) / cast(count(*) as double) as sched_ratio
from gjobs_@S group by workspace_name
""",
    "s_compute_@S": """
select coalesce(c.workspace_name, j.workspace_name) as workspace_name,
  case when c.n is null then 0e0 else least(greatest(c.util * (1 - c.idle_ratio * 0.5e0) * 0.5e0 + c.auto_ratio * 0.3e0 * 0.2e0
    + (coalesce(j.success, 0) * 0.4e0 + coalesce(j.eff, 0) * 0.3e0) * 0.3e0, 0e0), 1e0) end as compute_score
from mclusters_@S c full join mjobs_@S j on c.workspace_name = j.workspace_name
""",
    "s_storage_@S": """
select workspace_name, count(*) filter (where is_partitioned) / cast(count(*) as double) * 0.4e0 + (1 - count(*) filter (where has_small_files) / cast(count(*) as double)) * 0.3e0
  + (1 - count(*) filter (where is_abandoned) / cast(count(*) as double)) * 0.3e0 as storage_score
from tables_@S group by workspace_name
""",
    "s_governance_@S": """
select workspace_name, case when count(*) filter (where metastore_type = 'unity_catalog') > 0 then 0.5e0 else 0e0 end as governance_score
from tables_@S group by workspace_name
""",
    "s_pipelines_@S": """
select workspace_name, least(greatest(sched_ratio * 0.3e0 + coalesce(success, 0) * 0.4e0 + coalesce(eff, 0) * 0.3e0, 0e0), 1e0) as pipelines_score from mjobs_@S
""",
    "tags_@S": """
select workspace_name, sum(c) as nc, sum(ct) as nct, sum(j) as nj, sum(jt) as njt
from (
  select workspace_name, 1 as c, case when custom_tags is not null and trim(custom_tags) not in ('', 'null', 'None', '{}', '[]') then 1 else 0 end as ct, 0 as j, 0 as jt from clusters_@S
  union all
  select workspace_name, 0, 0, 1, case when tags is not null and trim(tags) not in ('', 'null', 'None', '{}', '[]') then 1 else 0 end from jobs_@S) t
group by workspace_name
""",
    "s_observability_@S": """
select workspace_name, case when nc = 0 then 0e0 else nct / cast(nc as double) * 0.5e0 + case when nj = 0 then 0e0 else njt / cast(nj as double) * 0.5e0 end end as observability_score from tags_@S
""",
    "s_costs_2": """
select workspace_name, case when change is null then 0.5e0 when change < -0.1e0 then 1e0 when change < 0 then 0.7e0 when change < 0.1e0 then 0.5e0 else 0.3e0 end as costs_score
from (
  select coalesce(n.workspace_name, b.workspace_name) as workspace_name,
    round((n.m - coalesce(nullif(b.m, 0), n.m)) / nullif(coalesce(nullif(b.m, 0), n.m), 0), 12) as change
  from (select workspace_name, sum(estimated_monthly_cost) as m from est_2 group by workspace_name) n
  full join (select workspace_name, total_estimated_monthly_cost as m from wscost_0) b on n.workspace_name = b.workspace_name) t
""",
    # At the first assessment there is no earlier baseline: no change.
    "s_costs_0": "select distinct workspace_name, 0.5e0 as costs_score from est_0",
    "names_@S": """
select distinct workspace_name from (select workspace_name from clusters_@S union all select workspace_name from jobs_@S union all select workspace_name from tables_@S) t
""",
    "maturity_@S": """
select workspace_name, round(m, 4) as maturity_score,
  case when m >= 0.8e0 then 'Otimizado' when m >= 0.6e0 then 'Avançado' when m >= 0.4e0 then 'Intermediário' else 'Básico' end as maturity_level,
  round(compute_score, 4) as compute_score, round(storage_score, 4) as storage_score, round(governance_score, 4) as governance_score,
  round(pipelines_score, 4) as pipelines_score, round(observability_score, 4) as observability_score, round(costs_score, 4) as costs_score
from (
  select *, round(compute_score * 0.25e0 + storage_score * 0.25e0 + governance_score * 0.2e0 + pipelines_score * 0.15e0 + observability_score * 0.1e0 + costs_score * 0.05e0, 12) as m
  from (
    select n.workspace_name, coalesce(compute_score, 0e0) as compute_score, coalesce(storage_score, 0e0) as storage_score, coalesce(governance_score, 0e0) as governance_score,
      coalesce(pipelines_score, 0.5e0) as pipelines_score, coalesce(observability_score, 0e0) as observability_score, coalesce(costs_score, 0.5e0) as costs_score
    from names_@S n left join s_compute_@S using (workspace_name) left join s_storage_@S using (workspace_name) left join s_governance_@S using (workspace_name)
    left join s_pipelines_@S using (workspace_name) left join s_observability_@S using (workspace_name) left join s_costs_@S using (workspace_name)) a) b
""",
    "recent_@S": """
select workspace_name, count(*) as days_counted, avg(daily_cost_usd) as avg_daily_cost, avg(daily_cost_usd) * 30 as actual_monthly_cost
from (select *, row_number() over (partition by workspace_name order by date_parsed desc) as rn from daily_@S) t where rn <= 30 group by workspace_name
""",
    "trend_@S": """
select workspace_name, days, recent_avg, older_avg,
  case when days < 2 or older_avg = 0 then 0.5e0 when round((recent_avg - older_avg) / older_avg, 12) < -0.1e0 then 1e0 when round((recent_avg - older_avg) / older_avg, 12) < 0 then 0.7e0
       when round((recent_avg - older_avg) / older_avg, 12) < 0.1e0 then 0.5e0 else 0.3e0 end as cost_trend_score
from (
  select workspace_name, count(*) as days, avg(case when rn <= 7 then daily_cost_usd end) as recent_avg,
    coalesce(avg(case when rn > 7 then daily_cost_usd end), avg(case when rn <= 7 then daily_cost_usd end)) as older_avg
  from (select *, row_number() over (partition by workspace_name order by date_parsed desc) as rn from daily_@S) t group by workspace_name) u
""",
    "baseline_@S": """
select n.workspace_name, cast(make_timestamp(@NOW * 1000::bigint) as date) as baseline_date, cl.cloud, '1.0.0' as framework_version,
  m.maturity_score, m.maturity_level, m.compute_score, m.storage_score, m.governance_score, m.pipelines_score, m.observability_score, m.costs_score,
  coalesce(w.total_estimated_monthly_cost, 0e0) as estimated_monthly_cost, coalesce(w.total_estimated_monthly_cost, 0e0) * 12 as estimated_annual_cost,
  cast(coalesce(c.n, 0) as integer) as total_clusters, cast(coalesce(j.n, 0) as integer) as total_jobs, coalesce(s.total_tables, 0) as total_tables,
  coalesce(s.total_size_tb, 0e0) as total_storage_tb
from names_@S n left join maturity_@S m using (workspace_name) left join wscost_@S w using (workspace_name) left join mclusters_@S c using (workspace_name)
left join (select workspace_name, count(*) as n from jobs_@S group by workspace_name) j using (workspace_name) left join storage_@S s using (workspace_name)
left join (select workspace_name, max(cloud) as cloud from est_@S group by workspace_name) cl using (workspace_name)
""",
    "bench_@S": """
select workspace_name, round(cost_per_tb, 2) as cost_per_tb, l1 as cost_per_tb_level, round(util, 2) as cluster_utilization, l2 as utilization_level,
  round(success, 2) as job_success_rate, l3 as success_rate_level, round(cold * 100, 2) as cold_data_percentage, l4 as cold_data_level,
  round(pts, 2) as overall_score, case when pts is null then 'no_data' when pts >= 3.5e0 then 'excellent' when pts >= 2.5e0 then 'good' when pts >= 1.5e0 then 'average' else 'poor' end as overall_level
from (
  select *, (p1 + p2 + p3 + p4) / nullif(cast((l1 <> 'no_data')::int + (l2 <> 'no_data')::int + (l3 <> 'no_data')::int + (l4 <> 'no_data')::int as double), 0) as pts
  from (
    select *, case l1 when 'excellent' then 4 when 'good' then 3 when 'average' then 2 when 'poor' then 1 else 0 end as p1,
      case l2 when 'excellent' then 4 when 'good' then 3 when 'average' then 2 when 'poor' then 1 else 0 end as p2,
      case l3 when 'excellent' then 4 when 'good' then 3 when 'average' then 2 when 'poor' then 1 else 0 end as p3,
      case l4 when 'excellent' then 4 when 'good' then 3 when 'average' then 2 when 'poor' then 1 else 0 end as p4
    from (
      select n.workspace_name, t.cost_per_tb, c.util, j.success, s.cold_size_tb / nullif(s.total_size_tb, 0) as cold,
        case when t.cost_per_tb is null then 'no_data' when round(t.cost_per_tb, 12) <= 50 then 'excellent' when round(t.cost_per_tb, 12) <= 100 then 'good' when round(t.cost_per_tb, 12) <= 200 then 'average' else 'poor' end as l1,
        case when c.util is null then 'no_data' when round(c.util, 12) >= 0.8e0 then 'excellent' when round(c.util, 12) >= 0.6e0 then 'good' when round(c.util, 12) >= 0.4e0 then 'average' else 'poor' end as l2,
        case when j.success is null then 'no_data' when round(j.success, 12) >= 0.98e0 then 'excellent' when round(j.success, 12) >= 0.95e0 then 'good' when round(j.success, 12) >= 0.9e0 then 'average' else 'poor' end as l3,
        case when s.cold_size_tb / nullif(s.total_size_tb, 0) is null then 'no_data' when round(s.cold_size_tb / nullif(s.total_size_tb, 0), 12) <= 0.1e0 then 'excellent'
             when round(s.cold_size_tb / nullif(s.total_size_tb, 0), 12) <= 0.2e0 then 'good' when round(s.cold_size_tb / nullif(s.total_size_tb, 0), 12) <= 0.3e0 then 'average' else 'poor' end as l4
      from names_@S n left join cpt_@S t using (workspace_name) left join mclusters_@S c using (workspace_name) left join mjobs_@S j using (workspace_name)
      left join storage_@S s using (workspace_name)) a) b) c
""",
    "recon_@S": """
select workspace_name, round(est, 2) as estimated_monthly_cost, case when both_known then round(act, 2) end as actual_cost,
  case when both_known then round(abs(est - act), 2) end as variance, case when both_known then round(pct, 2) end as variance_percentage,
  case when est is null then 'no_data' when not both_known then 'estimated_only' when pct < 5 then 'reconciled' when pct < 15 then 'close' else 'needs_review' end as reconciliation_status,
  case when est is null then 'low' when not both_known then 'medium' when pct < 5 then 'high' when pct < 15 then 'medium' else 'low' end as confidence,
  case when est is null then null when not both_known then 'Integrar billing real para maior precisão' when pct < 5 then 'Billing real integrado'
       else 'Revisar estimativas ou integrar billing real' end as recommendation
from (
  select *, est is not null and act is not null as both_known, case when act > 0 then round(abs(est - act) / act * 100, 12) else 0e0 end as pct
  from (
    select coalesce(e.workspace_name, r.workspace_name) as workspace_name, e.est, nullif(r.actual_monthly_cost, 0) as act
    from (select workspace_name, sum(estimated_monthly_cost) as est from est_@S group by workspace_name) e full join recent_@S r on e.workspace_name = r.workspace_name) a) b
""",
    # ------------------------------------------------------------ rules and audits
    "recs_@S": """
select * from (
  select *, row_number() over (partition by workspace_name, rule_id order by score desc, resource_id) as rn
  from (
    select workspace_name, 'idle_cluster' as rule_id, cluster_id as resource_id, idle_hours as score, 'compute' as category, 'high' as priority,
      concat('Cluster ', cluster_name, ' está ocioso') as title, 'Alto' as impact, 'Baixa' as complexity, 'Considerar desligar ou reduzir tamanho do cluster' as action
    from flags_@S where is_idle
    union all
    select workspace_name, 'abandoned_table', full_table_name, size_gb, 'storage', 'high', concat('Tabela ', table_name, ' abandonada'), 'Alto', 'Média', 'Arquivar ou excluir tabela'
    from tables_@S where is_abandoned
    union all
    select workspace_name, 'small_files', full_table_name, size_gb, 'storage', 'medium', concat('Tabela ', table_name, ' com muitos arquivos pequenos'), 'Médio', 'Baixa', 'Executar OPTIMIZE e Z-ORDER'
    from tables_@S where has_small_files and size_gb > 100
    union all
    select workspace_name, 'failing_job', cast(job_id as varchar), failure_rate, 'pipelines', 'high', concat('Job ', job_name, ' com alta taxa de falha'), 'Alto', 'Alta', 'Investigar e corrigir causas de falha'
    from gjobs_@S where failure_rate > 0.2e0) a) b
where rn <= 10
""",
    "a_storage_@S": """
select workspace_name, 'missing_optimize' as issue_type, 'storage' as category, full_table_name as resource_id, cast(null as varchar) as resource_name, full_table_name as table_name,
  case when size_gb > 100 then 'high' else 'medium' end as severity, 'Executar OPTIMIZE ZORDER BY (colunas de join)' as recommended_action,
  cast(null as double) as idle_hours, cast(null as integer) as num_workers, size_gb, cast(null as bigint) as failed_runs, cast(null as double) as avg_duration_hours
from tables_@S where is_delta and has_small_files and size_gb > 10
union all
select workspace_name, 'abandoned_table', 'storage', full_table_name, null, full_table_name, 'high', 'Arquivar ou excluir tabela', null, null, size_gb, null, null
from tables_@S where is_abandoned
""",
    "a_compute_@S": """
select workspace_name, 'idle_cluster' as issue_type, 'compute' as category, cluster_id as resource_id, cluster_name as resource_name, cast(null as varchar) as table_name, 'high' as severity,
  'Desligar cluster ou configurar autotermination' as recommended_action, idle_hours, num_workers, cast(null as double) as size_gb, cast(null as bigint) as failed_runs, cast(null as double) as avg_duration_hours
from flags_@S where idle_hours > 4
union all
select workspace_name, 'missing_autoscaling', 'compute', cluster_id, cluster_name, null, 'medium', 'Configurar autoscaling baseado em carga', idle_hours, num_workers, null, null, null
from flags_@S where not has_autoscaling and num_workers > 5
union all
select workspace_name, 'high_failure_job', 'compute', cast(job_id as varchar), job_name, null, 'high', 'Investigar logs, corrigir erros, implementar retry inteligente', null, null, null, failed_runs, avg_duration_hours
from gjobs_@S where failure_rate > 0.2e0
""",
    "a_workflows_@S": """
select workspace_name, 'job_without_schedule' as issue_type, 'pipelines' as category, cast(job_id as varchar) as resource_id, job_name as resource_name, cast(null as varchar) as table_name, 'medium' as severity,
  'Definir schedule apropriado ou considerar remoção' as recommended_action, cast(null as double) as idle_hours, cast(null as integer) as num_workers, cast(null as double) as size_gb,
  cast(null as bigint) as failed_runs, cast(null as double) as avg_duration_hours
from gjobs_@S where not has_schedule
union all
select workspace_name, 'long_running_job', 'pipelines', cast(run_id as varchar), null, null, 'medium', 'Otimizar query, particionar dados, revisar lógica', null, null, null, null, duration_hours
from (select *, row_number() over (partition by workspace_name order by duration_hours desc, run_id) as rn from runs_@S where start_ms >= @NOW - 30 * 86400000::bigint and duration_hours > 4) t
where rn <= 20
""",
    "issues_@S": "select * from a_storage_@S union all select * from a_compute_@S union all select * from a_workflows_@S",
    # What held at each snapshot: every inventory row judged at its own time, runs as far as they had started.
    "held": """
select workspace_name, 'idle_cluster' as rule_id, cluster_id as resource_id, s, (collect_ms - last_activity_time) / 3600000e0 * greatest(num_workers, 1) as measure from fx_clusters where start_time <> 0 and last_activity_time <> 0 and (collect_ms - last_activity_time) / 3600000e0 > 4
union all
select workspace_name, 'missing_autoscaling', cluster_id, s, cast(num_workers as double) from fx_clusters where autoscale is null or trim(autoscale) in ('', 'null', 'None', '{}', '[]')
union all
select workspace_name, 'abandoned_table', full_table_name, s, size_in_bytes / 1073741824e0 from fx_tables where (collect_ms - coalesce(last_access_ms, last_modified_ms)) // 86400000 > 180
union all
select workspace_name, 'small_files', full_table_name, s, cast(num_files as double) from fx_tables
where (num_files = 0 or size_in_bytes / cast(num_files as double) / 1048576e0 < 128) and size_in_bytes / 1073741824e0 > 100
union all
select j.workspace_name, 'failing_job', cast(j.job_id as varchar), j.s, count(*) filter (where r.is_failed) / cast(count(*) as double)
from fx_jobs j join runs_2 r on j.workspace_name = r.workspace_name and j.job_id = r.job_id and r.start_ms <= j.collect_ms
group by j.workspace_name, j.job_id, j.s having count(*) filter (where r.is_failed) / cast(count(*) as double) > 0.2e0
""",
    "fate": """
select b.workspace_name, b.rule_id, b.resource_id, b.title as recommendation_title, b.category, b.priority,
  case when h2.s is null then 'implementada' when h1.s is null then 'regressão'
    when h0.measure > 0 and round(h2.measure / h0.measure, 12) <= 0.75e0 then 'parcial' else 'não_implementada' end as status
from recs_0 b
left join held h0 on h0.s = 0 and b.workspace_name = h0.workspace_name and b.rule_id = h0.rule_id and b.resource_id = h0.resource_id
left join held h1 on h1.s = 1 and b.workspace_name = h1.workspace_name and b.rule_id = h1.rule_id and b.resource_id = h1.resource_id
left join held h2 on h2.s = 2 and b.workspace_name = h2.workspace_name and b.rule_id = h2.rule_id and b.resource_id = h2.resource_id
""",
    "new_c": """
select distinct workspace_name, cluster_id from fx_clusters c
where not exists (select 1 from fx_clusters b where b.s = 0 and b.workspace_name = c.workspace_name and b.cluster_id = c.cluster_id)
""",
    "new_t": """
select distinct workspace_name, full_table_name from fx_tables c
where not exists (select 1 from fx_tables b where b.s = 0 and b.workspace_name = c.workspace_name and b.full_table_name = c.full_table_name)
""",
    "new_j": """
select distinct workspace_name, job_id from fx_jobs c
where not exists (select 1 from fx_jobs b where b.s = 0 and b.workspace_name = c.workspace_name and b.job_id = c.job_id)
""",
    "newres": """
select n.workspace_name, cast((select count(*) from new_c x where x.workspace_name = n.workspace_name) as integer) as new_clusters,
  cast((select count(*) from new_t x where x.workspace_name = n.workspace_name) as integer) as new_tables,
  cast((select count(*) from new_j x where x.workspace_name = n.workspace_name) as integer) as new_jobs
from (select workspace_name from fx_clusters union select workspace_name from fx_tables union select workspace_name from fx_jobs) n
""",
    # ------------------------------------------------------------ savings and reports
    "roi_@S": """
select workspace_name, round(cost, 2) as current_monthly_cost, round(cost - gain, 2) as estimated_monthly_cost, round(gain, 2) as estimated_monthly_savings,
  round(gain * 12, 2) as estimated_annual_savings, round(case when cost > 0 then gain / cost * 100 else 0e0 end, 2) as reduction_percentage, 'medium' as confidence, '±15%' as margin_of_error
from (
  select coalesce(i.workspace_name, r.workspace_name) as workspace_name, coalesce(r.actual_monthly_cost, 0e0) as cost, coalesce(i.gain, 0e0) as gain
  from (select workspace_name, sum(case category when 'compute' then coalesce(idle_hours, 0) * coalesce(num_workers, 0) * 0.5e0 * 30 when 'storage' then size_gb * 0.023e0 * 0.7e0 else 0e0 end) as gain
        from issues_@S where severity = 'high' group by workspace_name) i
  full join recent_@S r on i.workspace_name = r.workspace_name) t
""",
    "backlog_@S": """
select workspace_name, 1 as priority, category, issue_type, resource_id, recommended_action as action, m as estimated_savings_usd_month, m * 12 as estimated_savings_usd_year,
  case when issue_type = 'abandoned_table' then 'medium' else 'low' end as complexity,
  case issue_type when 'abandoned_table' then 8e0 when 'missing_optimize' then 2e0 else 1e0 end as effort_hours
from (
  select *, case issue_type when 'abandoned_table' then size_gb * 0.023e0 * 0.7e0 when 'missing_optimize' then size_gb * 0.023e0 * 0.1e0
    when 'idle_cluster' then idle_hours * num_workers * 0.5e0 * 30 when 'high_failure_job' then failed_runs * avg_duration_hours * 2 * 0.8e0 end as m
  from issues_@S where severity = 'high' and category in ('storage', 'compute')) t
""",
    "wins_@S": """
select * from (
  select *, m * 12 as estimated_savings_usd_year, row_number() over (partition by workspace_name order by m desc, category, resource_id) as rn
  from (
    select workspace_name, 'quick_win' as alert_type, category, resource_id, concat('Cluster ', resource_name, ' ocioso') as title, recommended_action as action,
      idle_hours * num_workers * 0.5e0 * 30 as m, 1e0 as effort_hours, 'low' as complexity, 'high' as urgency
    from issues_@S where issue_type = 'idle_cluster' and idle_hours * num_workers * 0.5e0 * 30 > 100
    union all
    select workspace_name, 'quick_win', category, resource_id, concat('Tabela ', table_name, ' abandonada'), recommended_action, size_gb * 0.023e0, 4e0, 'medium', 'high'
    from issues_@S where issue_type = 'abandoned_table' and size_gb * 0.023e0 > 50) a) b
where rn <= 10
""",
    "report_names": """
select workspace_name from names_2 union select workspace_name from recent_2 union select workspace_name from recs_0 union select workspace_name from newres
""",
    "report": """
select n.workspace_name, '2001-08-01T00:00:00' as report_date, '2001-06-02T00:00:00' as baseline_date,
  m.maturity_score as current_maturity_score, m.maturity_level as current_maturity_level,
  cast(coalesce(i.total, 0) as integer) as total_issues, cast(coalesce(i.high, 0) as integer) as high_priority_issues, cast(coalesce(i.medium, 0) as integer) as medium_priority_issues,
  cast(coalesce(f.done, 0) as integer) as recommendations_implemented, cast(coalesce(f.still, 0) as integer) as recommendations_not_implemented, cast(coalesce(f.back, 0) as integer) as regressions_detected,
  coalesce(r.estimated_monthly_savings, 0e0) as estimated_monthly_savings, coalesce(r.estimated_annual_savings, 0e0) as estimated_annual_savings, coalesce(r.reduction_percentage, 0e0) as reduction_percentage
from report_names n left join maturity_2 m using (workspace_name)
left join (select workspace_name, count(*) as total, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium from issues_2 group by workspace_name) i using (workspace_name)
left join (select workspace_name, count(*) filter (where status = 'implementada') as done, count(*) filter (where status in ('não_implementada', 'parcial')) as still,
             count(*) filter (where status = 'regressão') as back from fate group by workspace_name) f using (workspace_name)
left join roi_2 r using (workspace_name)
""",
}
