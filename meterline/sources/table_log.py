"""Table inventory from transaction logs: which files a table consists of, by replaying its commits.

A log folder holds a JSON-lines file for each version, named by it, whose lines are
actions: files added and removed, the table's metadata, and who committed. Now and
then a checkpoint in Parquet repeats the state of a version, and older commits may be
gone. Of each file the newest action counts; a file is live if that adds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.functions import timeutil as T
from meterline.schemas import struct_of

# The published names of the log's folder, files and action fields.
LOG_FILE = r"^(.*)/_delta_log/(\d{20})(?:\.checkpoint[^/]*)?\.(?:json|parquet)$"
COMMITS, CHECKPOINTS = "_delta_log/*.json", "_delta_log/*.checkpoint*.parquet"
ACTIONS = """
add struct<path:string,size:bigint,modificationTime:bigint>,
remove struct<path:string,deletionTimestamp:bigint>,
metaData struct<format:struct<provider:string>,partitionColumns:array<string>>,
commitInfo struct<timestamp:bigint,operation:string>"""


def read_log(spark: SparkSession, path: str, *, pattern: str = LOG_FILE, checkpoints: bool = False) -> DataFrame:
    """Actions of all log files at ``path`` (globs allowed) with their table's location and version.

    ``pattern`` takes both from a file's path. Files of other names are left out.
    """
    reader = spark.read.schema(struct_of(ACTIONS))
    found = reader.parquet(path) if checkpoints else reader.json(path)
    file = F.col("_metadata.file_path")
    return found.select(
        F.regexp_extract(file, pattern, 1).alias("location"),
        F.try_to_number(F.nullif(F.regexp_extract(file, pattern, 2), F.lit("")), F.lit("9" * 20)).cast("bigint").alias("version"),
        *struct_of(ACTIONS).names,
    ).filter(F.col("version").isNotNull())


def inventory(commits: DataFrame, checkpoints: DataFrame | None = None, *, as_of: T.AsOf | None = None) -> DataFrame:
    """One row a table: live files, bytes, partition columns, format, newest version and commit.

    Only the newest checkpoint and the commits after it are replayed. With ``as_of``
    the table is that of the newest version committed by then; a table none of
    whose remaining commits is that old is left out. Files are settled by (table,
    file), so a table that holds most files is spread over all tasks.
    """
    stamped = commits.withColumn("is_state", F.lit(False))
    if as_of is not None:
        known = commits.filter(F.col("commitInfo.timestamp") <= T.as_of_ms(as_of))
        last = known.groupBy("location").agg(F.max("version").alias("_last"))
        until = F.col("version") <= F.col("_last")
        stamped = stamped.join(last, "location").filter(until).drop("_last")
        if checkpoints is not None:
            checkpoints = checkpoints.join(last, "location").filter(until).drop("_last")
    actions = stamped
    if checkpoints is not None:
        base = checkpoints.groupBy("location").agg(F.max("version").alias("_base"))
        state = checkpoints.withColumn("is_state", F.lit(True))
        # the commit of the checkpoint's own version still tells when that was
        actions = stamped.unionByName(state).join(base, "location", "left").filter(
            F.col("_base").isNull()
            | (F.col("is_state") & (F.col("version") == F.col("_base")))
            | (~F.col("is_state") & (F.col("version") >= F.col("_base")))
        )
        repeats = ~F.col("is_state") & F.col("version").eqNullSafe(F.col("_base"))
        no_file = F.lit(None)
        actions = actions.withColumns(
            {
                "add": F.when(~repeats, F.col("add")).otherwise(no_file),
                "remove": F.when(~repeats, F.col("remove")).otherwise(no_file),
            }
        )
    path = F.coalesce("add.path", "remove.path")
    adds = F.col("add").isNotNull()
    # a commit that removes and adds a file leaves it added
    order = F.struct("version", adds)
    files = (
        actions.filter(path.isNotNull())
        .groupBy("location", path.alias("path"))
        .agg(F.max_by("add", order).alias("add"))
        .filter("add is not null")
        .groupBy("location")
        .agg(
            F.count(F.lit(1)).alias("num_files"),
            F.sum("add.size").alias("size_in_bytes"),
            F.max("add.modificationTime").alias("_modified"),
        )
    )
    meta = F.col("metaData").isNotNull()
    tables = actions.groupBy("location").agg(
        F.max("version").alias("version"),
        F.max_by("metaData", F.when(meta, F.col("version"))).alias("_meta"),
        F.max_by("commitInfo", F.when(F.col("commitInfo").isNotNull(), F.col("version"))).alias("_commit"),
    )
    return tables.join(files, "location", "left").select(
        "location",
        F.coalesce("_meta.format.provider", F.lit("")).alias("table_type"),
        F.coalesce("num_files", F.lit(0)).cast("int").alias("num_files"),
        F.coalesce("size_in_bytes", F.lit(0)).cast("bigint").alias("size_in_bytes"),
        F.to_json(F.coalesce("_meta.partitionColumns", F.array().cast("array<string>"))).alias("partition_columns"),
        F.timestamp_millis("_modified").alias("last_modified"),
        F.timestamp_millis("_commit.timestamp").alias("last_access"),
        F.col("_commit.operation").alias("last_operation"),
        "version",
    )
