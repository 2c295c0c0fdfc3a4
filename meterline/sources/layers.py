"""Reading and writing layer tables by logical name."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from meterline.schemas import TABLES, Table
from meterline.sources import evolution

# History tables carry the day they were written for: as-of reads skip later
# folders and writing a day again replaces it.
DAY = "snapshot_date"
STAMPS = ("collect_timestamp", "process_timestamp", "snapshot_timestamp", "generated_at")
MAX_RECORDS_PER_FILE = 5_000_000


def _table(name: str) -> Table:
    try:
        return TABLES[name]
    except KeyError:
        raise KeyError(f"unknown table {name!r}") from None


def _partitions(table: Table) -> list[str]:
    return [DAY, *table.partition_by] if table.append else list(table.partition_by)


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's declared columns, cast; columns the frame lacks become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in _table(name).schema
        ]
    )


def _stamp_of(df: DataFrame) -> str:
    for c in STAMPS:
        if c in df.columns:
            return c
    raise ValueError("a history table needs a timestamp column")


def _laid_out(df: DataFrame, table: Table, parts: list[str]) -> DataFrame:
    """Spread rows over tasks by folder; a hot folder is split, tiny ones are merged."""
    rows, order = df.hint("rebalance", *parts), [*parts, *table.sort_by]
    return rows.sortWithinPartitions(*order) if order else rows


def _dated(df: DataFrame, table: Table, as_of: int | None = None) -> DataFrame:
    if not table.append:
        return df
    if as_of is None:
        return df.withColumn(DAY, F.col(_stamp_of(df)).cast("date"))
    return df.withColumn(DAY, F.timestamp_millis(F.lit(as_of).cast("bigint")).cast("date"))


def _write(df: DataFrame, table: Table, path: str, parts: list[str], mode: str, overwrite: str = "static") -> None:
    (
        _laid_out(df, table, parts)
        .write.mode(mode)
        .option("partitionOverwriteMode", overwrite)
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy(*parts)
        .parquet(path)
    )


def append(
    df: DataFrame, name: str, warehouse: str, *, as_of: int | None = None, keep_extra: bool = False
) -> None:
    """Add rows. ``keep_extra`` also stores columns the declared schema lacks."""
    table = _table(name)
    rows = df if keep_extra else conform(df, name)
    _write(_dated(rows, table, as_of), table, table.path(warehouse), _partitions(table), "append")


def replace(
    df: DataFrame,
    name: str,
    warehouse: str,
    *,
    as_of: int | None = None,
    workspaces: Sequence[str] | None = None,
) -> None:
    """Make ``df`` the whole content of a table, or of its day if it keeps a history.

    Rows that ``df`` no longer has go, whichever folder they were in, and running a
    day again leaves one copy of it. With ``workspaces`` only those are replaced, each
    as a whole, by one job over ``df``; a job that fails leaves what was there.
    """
    table, path, parts = _table(name), _table(name).path(warehouse), list(_table(name).partition_by)
    rows = conform(df, name)
    if table.append:
        if as_of is None:
            raise ValueError("as_of names the day of a history table")
        path = f"{path}/{DAY}={datetime.fromtimestamp(as_of / 1000, tz=timezone.utc):%Y-%m-%d}"
    if workspaces is None:
        _write(rows, table, path, parts, "overwrite")
        return
    spark, named = df.sparkSession, list(dict.fromkeys(workspaces))
    before = _files(spark, path, named)
    # One job: its files stay apart until it commits, then the folders it wrote are exchanged.
    _write(rows.filter(F.col("workspace_name").isin(named)), table, path, parts, "overwrite", "dynamic")
    # Folders that still hold a file from before were not written: their rows are gone.
    for folder in {f.rsplit("/", 1)[0] for f in before & _files(spark, path, named)}:
        _system(spark, folder)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def replace_parts(df: DataFrame, name: str, warehouse: str) -> None:
    """Exchange the partitions that ``df`` has rows of, in one job; all others stay as they are.

    The committer moves these folders one by one, so a table that is not there yet is
    written as a whole instead.
    """
    table, kind = _table(name), "dynamic" if exists(df.sparkSession, name, warehouse) else "static"
    _write(conform(df, name), table, table.path(warehouse), list(table.partition_by), "overwrite", kind)


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, name: str, warehouse: str) -> bool:
    """True if the table has been written."""
    system, at = _system(spark, _table(name).path(warehouse))
    return system.exists(at)


def _files(spark: SparkSession, path: str, workspaces: Sequence[str]) -> set[str]:
    """Data files below the folders of the workspaces."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    found = set()
    for one in workspaces:
        system, at = _system(spark, f"{path}/workspace_name={escape(one)}")
        if system.exists(at):
            listing = system.listFiles(at, True)
            while listing.hasNext():
                found.add(listing.next().getPath().toString())
    return found


def days(spark: SparkSession, name: str, warehouse: str) -> list[str]:
    """Days for which a history table has folders, in order."""
    system, at = _system(spark, _table(name).path(warehouse))
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return sorted(n.partition("=")[2] for n in names if n.startswith(f"{DAY}="))


def store_colocated(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Store ``df`` as a table whose files hold one bucket of ``keys`` each, sorted by them.

    Frames stored with the same keys and number of buckets are aggregated by the keys
    and joined on them without a shuffle. A bucket is one task, so this is for rows
    whose number per key is bounded: partial results and inventories, not facts.
    """
    rows = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    (
        rows.write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def read(spark: SparkSession, name: str, warehouse: str, *, evolved: bool = False) -> DataFrame:
    """A layer table with its declared schema, or with every column ever written.

    ``evolved`` also joins columns whose type changed (see ``evolution.common_type``).
    """
    table = _table(name)
    schema = table.schema
    if table.append:
        schema = T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])
    if evolved:
        folders = T.StructType([schema[c] for c in _partitions(table)])
        found = evolution.read_evolved(spark, table.path(warehouse), folders)
        if found is None:
            found = spark.createDataFrame([], schema)
        return found.drop(DAY)
    return spark.read.schema(schema).parquet(table.path(warehouse))


def read_known(
    spark: SparkSession, name: str, warehouse: str, *, as_of: int, days: Sequence[str] | None = None
) -> DataFrame:
    """History rows known at ``as_of``, of ``days`` only if given; other days' folders are not opened."""
    df = read(spark, name, warehouse)
    at = F.timestamp_millis(F.lit(as_of).cast("bigint"))
    if days is not None:
        df = df.filter(F.col(DAY).isin([date.fromisoformat(d) for d in days]))
    return df.filter((F.col(DAY) <= at.cast("date")) & (F.col(_stamp_of(df)) <= at)).drop(DAY)


def day_size(spark: SparkSession, name: str, warehouse: str, day: str) -> tuple[int, int]:
    """Files and bytes of one day's folder, from its listing."""
    system, at = _system(spark, f"{_table(name).path(warehouse)}/{DAY}={day}")
    summary = system.getContentSummary(at)
    return summary.getFileCount(), summary.getLength()


def register_views(spark: SparkSession, warehouse: str, names: list[str] | None = None) -> list[str]:
    """Temporary views ``<layer>_<table>`` so report SQL can be run as text."""
    made = []
    for name in names or list(TABLES):
        table = _table(name)
        read(spark, name, warehouse).createOrReplaceTempView(table.view)
        made.append(table.view)
    return made
