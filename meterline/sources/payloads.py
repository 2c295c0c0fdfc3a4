"""Readers of exported inventory payloads: one JSON line per resource or result page.

Schemas are declared, never inferred. A nested object declared as ``string``
arrives as its JSON text, so nothing is parsed that nobody reads. Epochs that
the source leaves out or writes as 0 become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterline.functions import columns as C, timeutil as T
from meterline.schemas import TABLES, struct_of

_ENVELOPE = "workspace_name string, workspace_url string, collected_at bigint"

CLUSTER_LINE = f"""{_ENVELOPE},
summary struct<cluster_id:string,cluster_name:string,state:string>,
detail struct<spark_version:string,node_type_id:string,driver_node_type_id:string,num_workers:int,
  autotermination_minutes:int,enable_elastic_disk:boolean,cluster_source:string,spark_conf:string,
  aws_attributes:string,azure_attributes:string,gcp_attributes:string,start_time:bigint,
  terminated_time:bigint,last_state_loss_time:bigint,last_activity_time:bigint,
  cluster_memory_mb:double,cluster_cores:double,default_tags:string,creator_user_name:string,
  custom_tags:string,cluster_log_conf:string,spark_env_vars:string,autoscale:string,
  is_pinned:boolean,is_high_availability:boolean,init_scripts:string,
  enable_local_disk_encryption:boolean,data_security_mode:string,runtime_engine:string,
  photon:boolean,single_user_name:string>"""

JOB_LINE = f"""{_ENVELOPE},
summary struct<job_id:bigint,job_type:struct<id:string>,settings:struct<name:string>>,
detail struct<format:string,settings:struct<timeout_seconds:int,max_concurrent_runs:int,
  schedule:string,notebook_task:string,spark_python_task:string,spark_jar_task:string,
  spark_submit_task:string,new_cluster:string,existing_cluster_id:string,libraries:string,
  email_notifications:string,webhook_notifications:string,tags:string>>"""

RUN_LINE = f"""{_ENVELOPE}, job_id bigint,
runs array<struct<run_id:bigint,run_name:string,
  state:struct<life_cycle_state:string,result_state:string>,start_time:bigint,end_time:bigint,
  setup_duration:bigint,execution_duration:bigint,cleanup_duration:bigint,trigger:string,
  cluster_instance:string,cluster_spec:string,overriding_parameters:string,tasks:string,
  error:string>>"""

TABLE_LINE = f"""{_ENVELOPE}, metastore_type string, catalog string, schema string,
table_name string, is_temporary boolean,
detail struct<format:string,location:string,provider:string,numFiles:int,sizeInBytes:bigint,
  partitionColumns:string,lastModified:timestamp>,
history struct<timestamp:timestamp>"""

# What a missing field becomes, by type; lists and one job default differ.
_EPOCHS = {"start_time", "terminated_time", "last_state_loss_time", "last_activity_time", "end_time"}
_OBJECTS = {
    "spark_conf", "aws_attributes", "azure_attributes", "gcp_attributes", "default_tags",
    "custom_tags", "cluster_log_conf", "spark_env_vars", "autoscale", "schedule", "notebook_task",
    "spark_python_task", "spark_jar_task", "spark_submit_task", "new_cluster",
    "email_notifications", "webhook_notifications", "tags", "cluster_instance", "cluster_spec",
    "overriding_parameters", "error",
}
_LISTS = {"init_scripts", "libraries", "tasks"}
_DEFAULTS = {"max_concurrent_runs": 1}


def _filled(path: str, name: str, type_name: str) -> Column:
    """A payload field with its default, under its bronze name."""
    value = F.col(path)
    if name in _EPOCHS:
        value = F.nullif(value, F.lit(0).cast("bigint"))
    elif name in _OBJECTS or name in _LISTS:
        value = F.coalesce(value, F.lit("[]" if name in _LISTS else "{}"))
    elif type_name == "string":
        value = F.coalesce(value, F.lit(""))
    elif type_name == "boolean":
        value = F.coalesce(value, F.lit(False))
    else:
        value = F.coalesce(value, F.lit(_DEFAULTS.get(name, 0)).cast(type_name))
    return value.alias(name)


def _envelope() -> list[Column]:
    return [
        F.col("workspace_name"),
        F.col("workspace_url"),
        C.cloud_from_url(F.col("workspace_url")).alias("cloud"),
    ]


def _collected() -> Column:
    return F.timestamp_millis("collected_at").alias("collect_timestamp")


def _types(table: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in TABLES[f"bronze.{table}"].schema}


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster payload lines as bronze cluster rows."""
    types = _types("compute_clusters")
    lines = spark.read.schema(struct_of(CLUSTER_LINE)).json(path)
    summary = ("cluster_name", "state")
    detail = [f.name for f in lines.schema["detail"].dataType]
    return lines.select(
        *_envelope(),
        F.col("summary.cluster_id").alias("cluster_id"),
        *[_filled(f"summary.{n}", n, types[n]) for n in summary],
        *[_filled(f"detail.{n}", n, types[n]) for n in detail],
        _collected(),
    )


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    types = _types("compute_jobs")
    lines = spark.read.schema(struct_of(JOB_LINE)).json(path)
    settings = [f.name for f in lines.schema["detail"].dataType["settings"].dataType]
    return lines.select(
        *_envelope(),
        F.col("summary.job_id").alias("job_id"),
        _filled("summary.settings.name", "job_name", "string"),
        _filled("summary.job_type.id", "job_type", "string"),
        *[_filled(f"detail.settings.{n}", n, types[n]) for n in settings],
        _filled("detail.format", "format", "string"),
        _collected(),
    )


def runs_of_pages(pages: DataFrame, since: T.AsOf | None = None) -> DataFrame:
    """Bronze runs of result pages, batch or stream; every run of a page is kept."""
    types = _types("compute_job_runs")
    runs = pages.select(
        *_envelope(), "job_id", _collected(), F.explode("runs").alias("run")
    )
    if since is not None:
        runs = runs.filter(F.col("run.start_time") >= T.as_of_ms(since))
    plain = (
        "run_id", "run_name", "start_time", "end_time", "setup_duration", "execution_duration",
        "cleanup_duration", "trigger", "cluster_instance", "cluster_spec",
        "overriding_parameters", "tasks", "error",
    )
    return runs.select(
        "workspace_name",
        "workspace_url",
        "cloud",
        "job_id",
        _filled("run.state.life_cycle_state", "state", "string"),
        _filled("run.state.result_state", "result_state", "string"),
        *[_filled(f"run.{n}", n, types[n]) for n in plain],
        "collect_timestamp",
    )


def read_job_runs(
    spark: SparkSession, path: str, *, as_of: int | None = None, days_back: int = 30
) -> DataFrame:
    """Run pages as bronze runs, without those started before the look-back cut-off."""
    pages = spark.read.schema(struct_of(RUN_LINE)).json(path)
    since = None if as_of is None else as_of - days_back * T.MS_PER_DAY
    return runs_of_pages(pages, since)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Table detail lines as bronze tables; temporary tables are left out.

    A unity_catalog name has three parts, a hive name two and no catalog.
    """
    lines = spark.read.schema(struct_of(TABLE_LINE)).json(path)
    unity = F.col("metastore_type") == "unity_catalog"
    catalog = F.when(unity, F.col("catalog"))
    return lines.filter(~C.truthy(F.col("is_temporary"))).select(
        *_envelope(),
        "metastore_type",
        catalog.alias("catalog"),
        "schema",
        "table_name",
        F.concat_ws(".", catalog, "schema", "table_name").alias("full_table_name"),
        _filled("detail.format", "table_type", "string"),
        _filled("detail.location", "location", "string"),
        _filled("detail.provider", "provider", "string"),
        _filled("detail.numFiles", "num_files", "int"),
        _filled("detail.sizeInBytes", "size_in_bytes", "bigint"),
        F.coalesce("detail.partitionColumns", F.lit("[]")).alias("partition_columns"),
        F.col("detail.lastModified").alias("last_modified"),
        F.col("history.timestamp").alias("last_access"),
        _collected(),
    )


def lake_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files, bytes and last change of every table folder below ``root``.

    Only the file listing is read: the content column is never selected. The
    table folder is the file's folder without trailing ``key=value`` parts.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )
    folder = F.regexp_replace(F.regexp_replace("path", r"/[^/]+$", ""), r"(/[^/=]+=[^/]*)+$", "")
    return (
        files.filter(~F.col("path").rlike(r"/[._][^/]*$"))
        .groupBy(folder.alias("location"))
        .agg(
            F.count(F.lit(1)).cast("int").alias("num_files"),
            F.sum("length").alias("size_in_bytes"),
            F.max("modificationTime").alias("last_modified"),
        )
    )


def unknown_hosts(bronze: DataFrame) -> DataFrame:
    """Workspace URLs whose cloud could not be told, with their row counts."""
    return (
        bronze.filter(F.col("cloud").isNull())
        .groupBy("workspace_name", "workspace_url")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
