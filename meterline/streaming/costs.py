"""Incremental daily cost: a day's newest collection counts, however late it comes.

Two forms. ``store_updates`` remembers nothing: sums of each batch are stored and
readers add them up. ``advance`` keeps the open days as event-time windows in the
state store and upserts the days that a batch has revised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from meterline.schemas import TABLES
from meterline.streaming import batches, lateness

#: Days stay open for revision so long: billing is collected again for a month.
OPEN_DAYS = 31
DAY = ["workspace_name", "cloud", "date_parsed"]


def billing_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """New bronze billing files as they are appended."""
    return (
        spark.readStream.schema(TABLES["bronze.billing_costs"].schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def store_updates(
    silver_lines: DataFrame, target: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Keep each batch's cost of every workspace, cloud, day and collection.

    A later collection replaces a day instead of adding to it, so sums stay apart by
    the time of collection; one collection may come in several batches. Nothing is
    remembered between batches and no row is too late. A batch that is retried writes
    the same folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batches.store(_sums(batch), target, number)

    writer = silver_lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _sums(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*DAY, "collect_timestamp").agg(F.sum("cost_usd").alias("cost_usd"))


def _newest(sums: DataFrame) -> DataFrame:
    """Daily cost from sums of each collection, in any number of parts."""
    newest = _sums(sums).groupBy(*DAY).agg(F.max_by("cost_usd", "collect_timestamp").alias("cost_usd"))
    return newest.groupBy("workspace_name", "date_parsed").agg(F.sum("cost_usd").alias("daily_cost_usd"))


def current_daily_cost(spark: SparkSession, target: str) -> DataFrame:
    """Cost of each workspace and day by the newest collection of each of its clouds."""
    return _newest(batches.load(spark, target))


def compact(spark: SparkSession, target: str) -> int:
    """One row a day and collection for all batches so far; readers and writers go on as before."""
    return batches.compact(spark, target, _added)


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*DAY, "collect_timestamp").agg(
        F.sum("cost_usd").alias("cost_usd"), F.max(batches.NUMBER).alias(batches.NUMBER)
    )


# ------------------------------------------------------------ event-time windows


def _event_time():
    """Start of the billing day; null for an unreadable date."""
    return F.timestamp_seconds(F.unix_date("date_parsed") * 86_400)


def day_windows(lines: DataFrame, days: int = OPEN_DAYS) -> DataFrame:
    """Running sums of each collection of each day, as a streaming frame.

    The state holds a row for each workspace, cloud, open day and collection, and
    forgets a day when the watermark has passed its end.
    """
    timed = lines.withColumn("at", _event_time()).withWatermark("at", lateness.watermark(days))
    sums = timed.groupBy(F.window("at", "1 day").alias("window"), *DAY, "collect_timestamp").agg(
        F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("n_lines")
    )
    return sums.drop("window")


def advance(
    lines: DataFrame, target: str, checkpoint: str, *, days: int = OPEN_DAYS
) -> StreamingQuery:
    """Take in the silver lines that have come: windows revised by them to ``target``/days.

    Lines of days no longer open are added up in ``target``/late. Returns the
    finished stateful query, whose progress tells the size of its state.
    """
    lateness.deal(lines, _event_time(), days, target, f"{checkpoint}/deal", _sums).awaitTermination()
    fresh = lateness.fresh_stream(lines.sparkSession, lines.schema, target)
    query = (
        day_windows(fresh, days)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, number: batches.store(batch, f"{target}/days", number))
        .option("checkpointLocation", f"{checkpoint}/days")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _upserted(days: DataFrame) -> DataFrame:
    """The newest revision of each day and collection."""
    newest = F.max_by(F.struct("cost_usd", "n_lines", batches.NUMBER), batches.NUMBER)
    return days.groupBy(*DAY, "collect_timestamp").agg(newest.alias("_row")).select(*DAY, "collect_timestamp", "_row.*")


def windowed_daily_cost(spark: SparkSession, target: str) -> DataFrame:
    """Cost of each workspace and day: the newest revision of its windows and the late lines."""
    days, late = (batches.load(spark, f"{target}/{p}") for p in ("days", "late"))
    columns = [*DAY, "collect_timestamp", "cost_usd"]
    return _newest(_upserted(days).select(*columns).unionByName(late.select(*columns)))


def compact_windows(spark: SparkSession, target: str) -> None:
    """Merge the stored revisions and the late sums; ``windowed_daily_cost`` stays as it is."""
    batches.compact(spark, f"{target}/days", _upserted)
    batches.compact(spark, f"{target}/late", _added)
