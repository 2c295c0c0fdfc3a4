"""Payload readers on hand-written lines: missing fields, temporary tables, odd rows."""

from __future__ import annotations

import json

from meterline.schemas import TABLES
from meterline.sources import billing, payloads

ENVELOPE = {"workspace_name": "w", "workspace_url": "https://adb-9.azuredatabricks.net", "collected_at": 86_400_000}
NOW = 1_000 * 86_400_000


def lines(tmp_path, *objects):
    path = tmp_path / "part.json"
    path.write_text("\n".join(json.dumps(o) for o in objects))
    return str(path)


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def declared(name):
    return {f.name: f.dataType.simpleString() for f in TABLES[name].schema}


def test_cluster_defaults_and_nested_text(spark, tmp_path):
    path = lines(
        tmp_path,
        {**ENVELOPE, "summary": {"cluster_id": "c"}, "detail": {}},
        {**ENVELOPE, "summary": {"cluster_id": "d", "state": "RUNNING"},
         "detail": {"autoscale": {"max_workers": 8}, "start_time": 5, "custom_tags": {"a": "b"}}},
    )
    df = payloads.read_clusters(spark, path)
    assert types(df) == declared("bronze.compute_clusters")
    c, d = sorted(df.collect(), key=lambda r: r.cluster_id)
    assert (c.state, c.num_workers, c.is_pinned, c.autoscale, c.init_scripts, c.start_time) == ("", 0, False, "{}", "[]", None)
    assert (json.loads(d.autoscale), d.start_time, d.cloud) == ({"max_workers": 8}, 5, "azure")


def test_unknown_host_is_counted_not_dropped(spark, tmp_path):
    path = lines(tmp_path, {**ENVELOPE, "workspace_url": "https://example.org", "summary": {"cluster_id": "c"}, "detail": {}})
    df = payloads.read_clusters(spark, path)
    assert df.first().cloud is None
    assert payloads.unknown_hosts(df).first()["rows"] == 1


def test_job_fields(spark, tmp_path):
    path = lines(
        tmp_path,
        {**ENVELOPE, "summary": {"job_id": 5, "settings": {"name": "j"}, "job_type": {"id": "t"}},
         "detail": {"settings": {"schedule": {"cron": "x"}, "tags": {"o": "p"}}, "format": "MULTI"}},
        {**ENVELOPE, "summary": {"job_id": 6}},
    )
    df = payloads.read_jobs(spark, path)
    assert types(df) == declared("bronze.compute_jobs")
    five, six = sorted(df.collect(), key=lambda r: r.job_id)
    assert (five.job_name, five.job_type, five.format, json.loads(five.schedule)) == ("j", "t", "MULTI", {"cron": "x"})
    assert (six.job_name, six.max_concurrent_runs, six.schedule, six.libraries) == ("", 1, "{}", "[]")


def test_every_run_of_a_page_within_the_lookback(spark, tmp_path):
    day = 86_400_000
    runs = [{"run_id": i, "start_time": NOW - 30 * day, "state": {"result_state": "SUCCESS"}} for i in range(1500)]
    runs.append({"run_id": 9999, "start_time": NOW - 30 * day - 1})
    df = payloads.read_job_runs(spark, lines(tmp_path, {**ENVELOPE, "job_id": 1, "runs": runs}), as_of=NOW)
    assert types(df) == declared("bronze.compute_job_runs")
    assert df.count() == 1500


def test_table_names_and_temporary_tables(spark, tmp_path):
    base = {**ENVELOPE, "schema": "s", "table_name": "t", "detail": {"format": "delta", "partitionColumns": ["dt"]}}
    path = lines(
        tmp_path,
        {**base, "metastore_type": "unity_catalog", "catalog": "c"},
        {**base, "metastore_type": "hive", "catalog": "ignored", "history": {"timestamp": "2024-01-02T00:00:00Z"}},
        {**base, "metastore_type": "hive", "table_name": "tmp", "is_temporary": True},
    )
    df = payloads.read_tables(spark, path)
    assert types(df) == declared("bronze.storage_tables")
    got = {r.full_table_name: r for r in df.collect()}
    assert set(got) == {"c.s.t", "s.t"}
    assert got["s.t"].catalog is None and got["s.t"].last_access is not None
    assert (got["c.s.t"].num_files, json.loads(got["c.s.t"].partition_columns)) == (0, ["dt"])


def test_azure_columns_by_name_in_any_order(spark, tmp_path):
    path = lines(
        tmp_path,
        {**ENVELOPE, "columns": [{"name": n} for n in ("PreTaxCost", "UsageDate", "ResourceId")],
         "rows": [[1.5, 20240131, "r1"], [None, "2024-02-01T00:00:00", "r2"]]},
    )
    got = {r.resource_id: r for r in billing.read_billing_azure(spark, path).collect()}
    assert (got["r1"].date, got["r1"].cost, got["r1"].currency, got["r1"].resource_type) == ("2024-01-31", 1.5, "USD", None)
    assert (got["r2"].date, got["r2"].cost) == ("2024-02-01", 0.0)


def test_aws_currency_is_the_unit(spark, tmp_path):
    group = {"Keys": ["svc"], "Metrics": {"UnblendedCost": {"Amount": "2.25", "Unit": "EUR"}}}
    day = {"TimePeriod": {"Start": "2024-01-01"}, "Estimated": True, "Groups": [group]}
    r = billing.read_billing_aws(spark, lines(tmp_path, {**ENVELOPE, "ResultsByTime": [day]})).first()
    assert (r.service, r.resource_id, r.cost, r.currency) == ("svc", None, 2.25, "EUR")


def test_gcp_range_prunes_folders(spark, tmp_path):
    rows = spark.sql(
        "select 'w' workspace_name, 'u' workspace_url, timestamp'1972-09-01' usage_start_time, "
        "named_struct('description','s') service, named_struct('name','r') resource, cast(null as double) cost, "
        "cast(null as string) currency, 1L collected_at, suffix table_suffix from values ('19720901'), ('19720101') t(suffix)"
    )
    rows.write.partitionBy("table_suffix").parquet(str(tmp_path / "gcp"))
    df = billing.read_billing_gcp(spark, str(tmp_path / "gcp"), as_of=NOW)
    assert "PartitionFilters: [isnotnull(table_suffix" in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.cost, r.currency) for r in df.collect()] == [(0.0, "USD")]


def test_lake_inventory_lists_without_reading(spark, tmp_path):
    root = tmp_path / "lake"
    spark.range(10).withColumnRenamed("id", "k").selectExpr("k", "k % 2 as p").repartition(1).write.partitionBy("p").parquet(str(root / "t1"))
    spark.range(3).coalesce(1).write.parquet(str(root / "t2"))
    df = payloads.lake_inventory(spark, str(root))
    got = {r.location.rsplit("/", 1)[1]: r.num_files for r in df.collect()}
    assert got == {"t1": 2, "t2": 1}
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()
