"""Payload files and stream inputs written from the bronze fixtures, then read back.

Files go to the shared folder of the session (see ``session.shared_folder``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meterline.fixtures import AS_OF, DAY, SNAPSHOTS, Bronze
from meterline.operators import gold, partials, silver
from meterline.plans import incremental
from meterline.plans.pipeline import Warehouse
from meterline.session import shared_folder
from meterline.sources import billing, layers, payloads, table_log
from meterline.streaming import costs, runs

GCP_DAYS = 1000
STREAM_CUT = AS_OF - 365 * DAY


LINES_PER_FILE = 1_000_000  # a compressed file is read by one task


def _lines(df: DataFrame, label: str) -> str:
    path = shared_folder(df.sparkSession, label)
    # names and keys repeat in every line: plain text is many times the size of the tables
    df.write.option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).json(path)
    return path


def _envelope() -> list:
    return [
        F.col("workspace_name"),
        F.col("workspace_url"),
        F.unix_millis("collect_timestamp").alias("collected_at"),
    ]


def _with_url(df: DataFrame) -> DataFrame:
    n = F.substring_index("workspace_name", "_", -1)
    return df.withColumn(
        "workspace_url",
        F.when(F.col("cloud") == "azure", F.concat(F.lit("https://adb-"), n, F.lit(".azuredatabricks.net")))
        .when(F.col("cloud") == "aws", F.concat(F.lit("https://ws"), n, F.lit(".cloud.databricks.com")))
        .otherwise(F.concat(F.lit("https://ws"), n, F.lit(".gcp.databricks.com"))),
    )


def _object(name: str):
    return F.from_json(F.col(name), "map<string,string>").alias(name)


def src_clusters(b: Bronze) -> DataFrame:
    path = _lines(
        b.clusters.select(
            *_envelope(),
            F.struct("cluster_id", "cluster_name", "state").alias("summary"),
            F.struct(
                "num_workers",
                "cluster_source",
                "start_time",
                "terminated_time",
                "last_activity_time",
                "cluster_memory_mb",
                _object("custom_tags"),
                _object("autoscale"),
            ).alias("detail"),
        ),
        "clusters",
    )
    got = payloads.read_clusters(b.spark, path)
    return got.withColumns(
        {
            "max_workers": F.get_json_object("autoscale", "$.max_workers"),
            "tag_owner": F.get_json_object("custom_tags", "$.owner"),
            "collect_ms": F.unix_millis("collect_timestamp"),
        }
    )


def src_jobs(b: Bronze) -> DataFrame:
    path = _lines(
        b.jobs.select(
            *_envelope(),
            F.struct(
                "job_id", F.struct(F.col("job_name").alias("name")).alias("settings")
            ).alias("summary"),
            F.struct(
                F.struct(_object("schedule"), "existing_cluster_id", _object("tags")).alias(
                    "settings"
                )
            ).alias("detail"),
        ),
        "jobs",
    )
    got = payloads.read_jobs(b.spark, path)
    return got.withColumns(
        {
            "cron": F.get_json_object("schedule", "$.cron"),
            "tag_owner": F.get_json_object("tags", "$.owner"),
            "collect_ms": F.unix_millis("collect_timestamp"),
        }
    )


def run_pages(runs_df: DataFrame) -> DataFrame:
    """One page per run: no grouping, so no job or day can grow into one hot line."""
    run = F.struct(
        "run_id",
        F.struct("result_state").alias("state"),
        "start_time",
        "setup_duration",
        "execution_duration",
        "cleanup_duration",
        _object("cluster_instance"),
        _object("error"),
    )
    return _with_url(runs_df).select(*_envelope(), "job_id", F.array(run).alias("runs"))


def src_job_runs(b: Bronze) -> DataFrame:
    path = _lines(run_pages(b.runs), "runs")
    got = payloads.read_job_runs(b.spark, path, as_of=AS_OF)
    return got.withColumns(
        {
            "used_cluster": F.get_json_object("cluster_instance", "$.cluster_id"),
            "error_code": F.get_json_object("error", "$.code"),
        }
    )


def src_tables(b: Bronze) -> DataFrame:
    names = F.regexp_replace("partition_columns", "'", '"')
    path = _lines(
        b.tables.select(
            *_envelope(),
            "metastore_type",
            F.when(F.col("metastore_type") == "unity_catalog", "main").alias("catalog"),
            "schema",
            "table_name",
            F.lit(False).alias("is_temporary"),
            F.struct(
                F.col("table_type").alias("format"),
                F.col("num_files").alias("numFiles"),
                F.col("size_in_bytes").alias("sizeInBytes"),
                F.from_json(names, "array<string>").alias("partitionColumns"),
                F.col("last_modified").alias("lastModified"),
            ).alias("detail"),
            F.struct(F.col("last_access").alias("timestamp")).alias("history"),
        ),
        "tables",
    )
    got = payloads.read_tables(b.spark, path)
    return got.withColumns(
        {
            "last_modified_ms": F.unix_millis("last_modified"),
            "last_access_ms": F.unix_millis("last_access"),
            "collect_ms": F.unix_millis("collect_timestamp"),
            "n_partition_columns": F.json_array_length("partition_columns"),
        }
    )


def lake_inventory(b: Bronze) -> DataFrame:
    """Files of a partitioned copy of the billing rows, found by listing alone.

    How many files there are depends on the tasks that wrote them, so only their
    presence is shown; a unit test counts them.
    """
    root = shared_folder(b.spark, "lake")
    for cloud in ("azure", "aws", "gcp"):
        part = b.billing.filter(F.col("cloud") == cloud).select("resource_id", "currency", "cost")
        part.write.partitionBy("currency").parquet(f"{root}/{cloud}_costs")
    found = payloads.lake_inventory(b.spark, root)
    return found.select(
        F.substring_index("location", "/", -1).alias("table_name"),
        (F.col("num_files") > 0).alias("has_files"),
        (F.col("size_in_bytes") > 0).alias("has_bytes"),
    )


def src_billing_azure(b: Bronze) -> DataFrame:
    rows = _with_url(b.billing.filter(F.col("cloud") == "azure"))
    names = ("UsageDate", "ResourceId", "ResourceType", "ResourceGroupName", "PreTaxCost", "Currency")
    cells = F.array(
        F.regexp_replace("date", "-", ""),
        "resource_id",
        F.lit("cluster"),
        F.lit("rg"),
        F.col("cost").cast("string"),
        "currency",
    )
    columns = F.array(*[F.struct(F.lit(n).alias("name")) for n in names]).alias("columns")
    pages = rows.select(*_envelope(), columns, F.array(cells).alias("rows"))
    return billing.read_billing_azure(b.spark, _lines(pages, "azure"))


def src_billing_aws(b: Bronze) -> DataFrame:
    rows = _with_url(b.billing.filter(F.col("cloud") == "aws"))
    group = F.struct(
        F.array("service", "resource_id").alias("Keys"),
        F.struct(
            F.struct(
                F.col("cost").cast("string").alias("Amount"), F.col("currency").alias("Unit")
            ).alias("UnblendedCost")
        ).alias("Metrics"),
    )
    day = F.struct(
        F.struct(F.col("date").alias("Start")).alias("TimePeriod"), F.array(group).alias("Groups")
    )
    pages = rows.select(*_envelope(), F.array(day).alias("ResultsByTime"))
    return billing.read_billing_aws(b.spark, _lines(pages, "aws"))


def src_billing_gcp(b: Bronze) -> DataFrame:
    rows = _with_url(b.billing.filter(F.col("cloud") == "gcp"))
    path = shared_folder(b.spark, "gcp")
    (
        rows.select(
            "workspace_name",
            "workspace_url",
            F.col("date").cast("timestamp").alias("usage_start_time"),
            F.struct(F.col("service").alias("description")).alias("service"),
            F.struct(F.col("resource_id").alias("name")).alias("resource"),
            "cost",
            "currency",
            F.unix_millis("collect_timestamp").alias("collected_at"),
            # Month folders keep the copy small; the suffix range drops the oldest of them.
            F.concat(F.regexp_replace(F.substring("date", 1, 7), "-", ""), F.lit("01")).alias(
                "table_suffix"
            ),
        )
        .hint("rebalance", "table_suffix")
        .write.partitionBy("table_suffix")
        .parquet(path)
    )
    return billing.read_billing_gcp(b.spark, path, as_of=AS_OF, days_back=GCP_DAYS)


def src_billing(b: Bronze) -> DataFrame:
    return billing.unified_billing(src_billing_azure(b), src_billing_aws(b), src_billing_gcp(b))


def stream_job_runs(b: Bronze) -> DataFrame:
    """Two collections that overlap: runs in flight come again when they are finished."""
    spark = b.spark
    folder = shared_folder(spark, "stream-runs")
    source, target, checkpoint = (f"{folder}/{p}" for p in ("in", "out", "checkpoint"))
    known = silver.seen_by(b.runs, AS_OF)
    at = F.unix_millis("collect_timestamp")
    # half of the finished copies of runs started before the cut come late, after newer runs
    late = F.pmod(F.xxhash64("run_id"), F.lit(2)) == 0
    second = (at >= STREAM_CUT) | (late & (F.col("result_state") != "RUNNING"))
    for part in (known.filter(~second), known.filter(second | (at >= STREAM_CUT - 30 * DAY))):
        part.write.mode("append").parquet(source)
        runs.store_updates(runs.bronze_stream(spark, source), target, checkpoint).awaitTermination()
    return silver.silver_job_runs(runs.current_runs(spark, target), as_of=AS_OF)


def stream_daily_cost(b: Bronze) -> DataFrame:
    """Two batches of billing lines; the second collects days of the first again."""
    spark = b.spark
    folder = shared_folder(spark, "stream-costs")
    source, target, checkpoint = (f"{folder}/{p}" for p in ("in", "out", "checkpoint"))
    known = silver.seen_by(b.billing, AS_OF)
    at = F.unix_millis("collect_timestamp")
    late = (at >= STREAM_CUT - 7 * DAY) & (F.pmod(F.xxhash64("resource_id"), F.lit(2)) == 0)
    second = (at >= STREAM_CUT) | late
    for part in (known.filter(~second), known.filter(second)):
        part.write.mode("append").parquet(source)
        lines = silver.silver_billing(costs.billing_stream(spark, source), as_of=AS_OF)
        costs.store_updates(lines, target, checkpoint).awaitTermination()
    return costs.current_daily_cost(spark, target)


def stream_runs_watermarked(b: Bronze) -> DataFrame:
    """Four collections through the bounded state; finished copies come again and some come late."""
    spark = b.spark
    folder = shared_folder(spark, "stream-state")
    source, target, checkpoint = (f"{folder}/{p}" for p in ("in", "out", "checkpoint"))
    known = silver.seen_by(b.runs, AS_OF)
    at = F.unix_millis("collect_timestamp")
    late = (F.pmod(F.xxhash64("run_id"), F.lit(4)) == 0) & (F.col("result_state") != "RUNNING")
    first, last = at < STREAM_CUT, at >= STREAM_CUT + 180 * DAY
    again = (at >= STREAM_CUT - 30 * DAY) & (at < STREAM_CUT)
    for part in (
        known.filter(first & ~late),
        known.filter((~first & ~last) | again & ~late),  # a month is collected again
        known.filter(last),
        known.filter(first & late),  # by now far behind the watermark
    ):
        part.write.mode("append").parquet(source)
        runs.advance(_stream_of(part, source), target, checkpoint)
    return silver.silver_job_runs(runs.final_runs(spark, target), as_of=AS_OF)


def _stream_of(df: DataFrame, path: str) -> DataFrame:
    """Files with the columns of ``df`` as a stream."""
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def stream_daily_windows(b: Bronze) -> DataFrame:
    """Three batches of billing lines through daily windows: revised days, then days long closed."""
    spark = b.spark
    folder = shared_folder(spark, "stream-windows")
    source, target, checkpoint = (f"{folder}/{p}" for p in ("in", "out", "checkpoint"))
    known = silver.seen_by(b.billing, AS_OF)
    at = F.unix_millis("collect_timestamp")
    part_of_day = F.pmod(F.xxhash64("resource_id"), F.lit(3)) == 0
    late = (at < STREAM_CUT - 200 * DAY) & part_of_day
    revised = (at >= STREAM_CUT - 7 * DAY) & (at < STREAM_CUT) & part_of_day
    second = (at >= STREAM_CUT) | revised
    for part in (known.filter(~second & ~late), known.filter(second), known.filter(late)):
        part.write.mode("append").parquet(source)
        lines = silver.silver_billing(_stream_of(part, source), as_of=AS_OF)
        costs.advance(lines, target, checkpoint)
    return costs.windowed_daily_cost(spark, target)


def _folded(b: Bronze, name: str, rows: DataFrame, fold) -> Warehouse:
    """A warehouse whose bronze rows came in three collections, each folded in by itself."""
    path = shared_folder(b.spark, f"folded-{name}")
    at = F.unix_millis("collect_timestamp")
    floor = 0
    for until in SNAPSHOTS:
        layers.append(rows.filter((at > floor) & (at <= until)), f"bronze.{name}", path, as_of=until)
        run = Warehouse(b.spark, path, until)
        fold(run)
        floor = until
    return run


def folded_run_stats(b: Bronze) -> DataFrame:
    return incremental.run_stats(_folded(b, incremental.RUNS, b.runs, incremental.fold_runs))


def folded_daily_cost(b: Bronze) -> DataFrame:
    return incremental.daily(_folded(b, incremental.COSTS, b.billing, incremental.fold_costs))


LOG_START = AS_OF - 30 * DAY
LOG_PATTERN = r"/table=([^/]+)/version=(\d+)/[^/]*$"


def _log_actions(b: Bronze) -> DataFrame:
    """Brands are tables, parts their files: some are removed later, and some of these added again."""
    part = b.table("part").select("p_partkey", "p_size", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("table"))
    path = F.format_string("part-%d.parquet", "p_partkey")
    at = lambda v: F.lit(LOG_START) + v.cast("bigint") * DAY
    null = F.lit(None)

    def rows(df, version, add=null, remove=null, meta=null, commit=null):
        names = {"add": add, "remove": remove, "metaData": meta, "commitInfo": commit}
        kinds = {f.name: f.dataType for f in table_log.struct_of(table_log.ACTIONS)}
        return df.select("table", version.cast("int").alias("version"), *[c.cast(kinds[n]).alias(n) for n, c in names.items()])

    def add(version, size):
        return F.struct(path.alias("path"), size.alias("size"), at(version).alias("modificationTime"))

    first = F.col("p_size") % 10
    gone = part.filter("p_partkey % 7 = 0")
    tables = part.select("table").distinct()
    even = tables.filter(F.right("table", F.lit(1)).cast("int") % 2 == 0)
    versions = tables.select("table", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("v"))
    meta = lambda *names: F.struct(
        F.struct(F.lit("delta").alias("provider")).alias("format"), F.array(*map(F.lit, names)).alias("partitionColumns")
    )
    commit = F.struct(at(F.col("v")).alias("timestamp"), F.lit("WRITE").alias("operation"))
    parts = [
        rows(part, first, add=add(first, F.col("p_partkey").cast("bigint") * 1000)),
        rows(gone, first + 2, remove=F.struct(path.alias("path"), at(first + 2).alias("deletionTimestamp"))),
        rows(gone.filter("p_partkey % 3 = 0"), first + 4, add=add(first + 4, F.col("p_partkey").cast("bigint") * 500)),
        rows(tables, F.lit(0), meta=meta("dt")),
        rows(even, F.lit(3), meta=meta("dt", "region")),
        rows(versions, F.col("v"), commit=commit),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def table_log_inventory(b: Bronze) -> DataFrame:
    """Logs as files; a third of the tables has a checkpoint at version 6 and no commits before it."""
    spark, folder = b.spark, shared_folder(b.spark, "log")
    commits, state = f"{folder}/commits", f"{folder}/state"
    actions = _log_actions(b)
    cut = F.length(F.regexp_replace("table", "[^3]", "")) > 0
    tip = Window.partitionBy("table", F.coalesce("add.path", "remove.path", F.lit("meta"))).orderBy(F.desc("version"))
    held = actions.filter(cut & (F.col("version") <= 6) & F.col("commitInfo").isNull())
    # a checkpoint has the newest action of each file and the newest metadata
    newest = held.withColumn("_no", F.row_number().over(tip)).filter("_no = 1").drop("_no")
    newest.withColumn("version", F.lit(6)).write.partitionBy("table", "version").parquet(state)
    actions.filter(~cut | (F.col("version") >= 6)).repartition("table").write.partitionBy("table", "version").json(commits)
    found = table_log.inventory(
        table_log.read_log(spark, commits, pattern=LOG_PATTERN),
        table_log.read_log(spark, state, pattern=LOG_PATTERN, checkpoints=True),
    )
    return found.withColumns(
        {
            "table_name": F.col("location"),
            "last_modified_ms": F.unix_millis("last_modified"),
            "last_commit_ms": F.unix_millis("last_access"),
        }
    )


def sink_append_evolved(b: Bronze) -> DataFrame:
    """Three collections of jobs whose columns came, went and changed their type, and a day with both types."""
    spark, name = b.spark, "bronze.compute_jobs"
    path = shared_folder(spark, "evolved")
    narrow = F.pmod("job_id", F.lit(100))
    first, second, third = (b.jobs.filter(F.unix_millis("collect_timestamp") == at) for at in SNAPSHOTS)
    odd = F.pmod("job_id", F.lit(2)) == 1
    detail = F.struct(narrow.cast("int").alias("a"))
    wide = F.struct(narrow.alias("a"), F.col("job_name").alias("b"))
    writes = (
        first.drop("tags").withColumns({"priority": narrow.cast("int"), "retries": narrow.cast("int"), "detail": detail}),
        second.filter(odd).withColumns({"priority": F.col("job_id") * 5_000_000_000, "retries": narrow / 4, "detail": wide}),
        second.filter(~odd).withColumns({"priority": narrow.cast("int"), "retries": narrow.cast("int"), "detail": detail}),
        third.withColumns({"priority": narrow.cast("decimal(12,2)") / 8, "retries": F.lit("many"), "detail": wide}),
    )
    for rows in writes:
        layers.append(rows, name, path, keep_extra=True)
    found = layers.read(spark, name, path, evolved=True)
    return found.select(
        "workspace_name",
        "job_id",
        "tags",
        F.unix_millis("collect_timestamp").alias("collect_ms"),
        F.col("priority").cast("double").alias("priority"),
        F.col("retries").try_cast("double").alias("retries"),
        F.col("retries").isNotNull().alias("has_retries"),
        F.col("detail.a").alias("detail_a"),
        F.col("detail.b").alias("detail_b"),
    )


def sink_replace(b: Bronze) -> DataFrame:
    """Jobs of all workspaces at the baseline; some are replaced by the newest, one of them by nothing."""
    spark, name = b.spark, "silver.compute_jobs"
    path = shared_folder(spark, "replaced")
    at = F.unix_millis("collect_timestamp")
    old, new = (silver.silver_jobs(b.jobs.filter(at == ms), as_of=ms) for ms in (SNAPSHOTS[0], SNAPSHOTS[-1]))
    layers.replace(old, name, path)
    changed = [f"ws_{i}" for i in range(0, 25, 2)]
    layers.replace(new.filter(F.col("workspace_name") != "ws_4"), name, path, workspaces=changed)
    return layers.read(spark, name, path).withColumn("collect_ms", at)


BUCKETS = 8


def gold_jobs_colocated(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs and the month partials of their runs, stored in the same buckets of (workspace, job)."""
    spark = jobs.sparkSession
    folder, keys = shared_folder(spark, "colocated"), ["workspace_name", "job_id"]
    mark = folder.rsplit("-", 1)[1]  # a name of its own: the catalog outlives a query
    stored = layers.store_colocated(jobs, f"jobs_{mark}", f"{folder}/jobs", keys, BUCKETS)
    months = layers.store_colocated(partials.run_months(runs), f"job_months_{mark}", f"{folder}/months", keys, BUCKETS)
    return gold.gold_jobs(stored, partials.job_run_stats(months))
