"""Bronze inputs as SQL over the base tables, and the instants of the three snapshots."""

NOW = {0: 991440000000, 1: 994032000000, 2: 996624000000}

INPUTS = {
    "fx_snap": """
select 0 as s, 991440000000 as snap_ms union all select 1, 994032000000 union all select 2, 996624000000
""",
    "fx_clusters": """
select concat('ws_', cast(c_custkey % 25 as string)) as workspace_name,
  case (c_custkey % 25) % 3 when 0 then concat('https://adb-', cast(c_custkey % 25 as string), '.azuredatabricks.net')
    when 1 then concat('https://ws', cast(c_custkey % 25 as string), '.cloud.databricks.com')
    else concat('https://ws', cast(c_custkey % 25 as string), '.gcp.databricks.com') end as workspace_url,
  case (c_custkey % 25) % 3 when 0 then 'azure' when 1 then 'aws' else 'gcp' end as cloud,
  concat('c-', cast(c_custkey as string)) as cluster_id, concat('cluster_', cast(c_custkey as string)) as cluster_name,
  case when c_custkey % 4 = 0 then 'RUNNING' else 'TERMINATED' end as state, c_custkey % 21 as num_workers,
  case c_mktsegment when 'BUILDING' then 'UI' when 'MACHINERY' then 'JOB' else 'API' end as cluster_source,
  case when (c_custkey + s) % 5 = 0 then '{}' when (c_custkey + s) % 5 = 1 then null else '{"min_workers": 1, "max_workers": 8}' end as autoscale,
  case c_custkey % 3 when 0 then '{}' when 1 then '{"cost_center": "cc1", "BusinessUnit": "bu2"}' else '{"CostCenter": "cc2", "data_domain": "dd1", "owner": "o1"}' end as custom_tags,
  snap_ms - 86400000 * (30 + c_custkey % 10) as start_time,
  case when c_custkey % 4 = 0 then 0 else snap_ms - 86400000 * (c_custkey % 10) end as terminated_time,
  case when c_custkey % 13 = 0 then 0 else snap_ms - 60000 * ((c_custkey * 7 + s * 311) % 960) end as last_activity_time,
  cast(8192 * (c_custkey % 16 + 1) as double) as cluster_memory_mb, s, snap_ms as collect_ms
from customer cross join fx_snap where (s = 2 or c_custkey % 17 <> 0) and not (s = 2 and c_custkey % 29 = 7)
""",
    "fx_jobs": """
select concat('ws_', cast(p_partkey % 25 as string)) as workspace_name,
  case (p_partkey % 25) % 3 when 0 then 'azure' when 1 then 'aws' else 'gcp' end as cloud, p_partkey as job_id,
  concat(lower(p_type), '-', replace(p_name, ' ', '_')) as job_name,
  case p_size % 4 when 0 then '{}' when 1 then null else '{"cron": "0 0 0 * * ?"}' end as schedule,
  case when p_size % 5 = 0 then concat('c-', cast(p_partkey % 25 as string)) else '' end as existing_cluster_id,
  case p_partkey % 4 when 0 then null when 1 then '{}' else '{"cost_center": "cc1", "owner": "o2"}' end as tags,
  s, snap_ms as collect_ms
from part cross join fx_snap where (s = 2 or p_partkey % 19 <> 0) and not (s = 2 and p_partkey % 31 = 5)
""",
    "fx_runs": """
with l as (
  select *, cast(l_shipdate as date) - 95 as start_date, (l_orderkey * 31 + l_linenumber * 17) % 100 < l_partkey % 45 as fails,
    (l_orderkey + l_linenumber) % 9 = 0 as twice from lineitem
), c as (select *, false as flying from l union all select *, true from l where twice)
select concat('ws_', cast(l_partkey % 25 as string)) as workspace_name,
  case (l_partkey % 25) % 3 when 0 then 'azure' when 1 then 'aws' else 'gcp' end as cloud, l_partkey as job_id,
  ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as run_id,
  case when flying then 'RUNNING' when fails then 'FAILED' when (l_orderkey + l_linenumber) % 50 = 0 then 'CANCELLED' else 'SUCCESS' end as result_state,
  epoch_ms(cast(start_date as timestamp)) as start_ms,
  case when flying then 0 else cast(l_quantity as bigint) * (l_partkey % 12 + 1) * 60000 end as execution_duration, l_suppkey * 1000 as setup_duration,
  case when flying then 0 else l_linenumber * 1500 end as cleanup_duration,
  concat('{"cluster_id": "c-', cast(l_partkey % 25 + 25 * (l_orderkey % 8) as string), '"}') as cluster_instance,
  case when fails and not flying then concat('{"code": "E', cast(l_suppkey % 12 as string), '"}') else '{}' end as error,
  epoch_ms(cast(start_date as timestamp)) + case when twice and not flying then 86400000 else 0 end as collect_ms
from c
""",
    "fx_tables": """
select concat('ws_', cast(p_partkey % 25 as string)) as workspace_name,
  case (p_partkey % 25) % 3 when 0 then 'azure' when 1 then 'aws' else 'gcp' end as cloud,
  case when (p_partkey % 25) % 2 = 0 then 'unity_catalog' else 'hive' end as metastore_type, p_brand as db,
  concat('t_', cast(p_partkey as string)) as table_name, concat(p_brand, '.t_', cast(p_partkey as string)) as full_table_name,
  case when p_partkey % 7 = 0 then 'parquet' else 'delta' end as table_type,
  cast(p_partkey % 997 + 1 as bigint) * p_size * 4000000 as size_in_bytes, (p_partkey * 13) % 5000 as num_files,
  snap_ms - 86400000 * ((p_partkey * 7 + s * 37) % 400) as last_modified_ms,
  case when p_partkey % 3 = 0 then null else snap_ms - 86400000 * ((p_partkey * 5 + s * 151) % 400) end as last_access_ms,
  case p_partkey % 4 when 0 then '[]' when 1 then '[''dt'']' else '[''dt'', ''region'']' end as partition_columns,
  s, snap_ms as collect_ms
from part cross join fx_snap where (s = 2 or p_partkey % 23 <> 0) and not (s = 2 and p_partkey % 37 = 3)
""",
    "fx_billing": """
select concat('ws_', cast(o_custkey % 25 as string)) as workspace_name,
  case (o_custkey % 25) % 3 when 0 then 'azure' when 1 then 'aws' else 'gcp' end as cloud,
  cast(o_orderdate as date) as cost_date, concat('c-', cast(o_custkey as string)) as resource_id, o_orderpriority as service,
  case when pass = 0 and o_orderkey % 11 = 5 then o_totalprice / 2000 else o_totalprice / 1000 end as cost,
  case when o_orderkey % 10 = 0 then 'EUR' else 'USD' end as currency,
  epoch_ms(cast(cast(o_orderdate as date) as timestamp)) + pass * 20 * 86400000::bigint as collect_ms
from orders, (select 0 as pass union all select 1)
where case when pass = 0 then o_orderkey % 7 <> 3 else o_orderkey % 13 <> 4 end
""",
}
