"""Incremental run ingest: the newest state of every run, although pages repeat.

Two forms. ``store_updates`` remembers nothing: every batch is stored reduced, and
readers take the newest copy of a run. ``advance`` remembers the copies of the last
weeks in the state store, bounded by a watermark, and stores each distinct copy of a
run once, however often it is collected again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from meterline.operators.silver import latest_runs
from meterline.schemas import TABLES, struct_of
from meterline.sources.payloads import RUN_LINE, runs_of_pages
from meterline.streaming import batches, lateness

#: Runs are collected again for 30 days; a day more is remembered.
REMEMBERED_DAYS = 31


def page_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """New page files as bronze runs."""
    pages = (
        spark.readStream.schema(struct_of(RUN_LINE))
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )
    return runs_of_pages(pages)


def bronze_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """New bronze run files as they are appended."""
    return (
        spark.readStream.schema(TABLES["bronze.compute_job_runs"].schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def store_updates(
    runs: DataFrame, target: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Keep each batch's newest copy of every run under the batch's number.

    Pages repeat the last 30 days, and a run that was in flight comes again when it
    is finished. Nothing is remembered between batches and no row is too late; a
    batch that is retried writes the same folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batches.store(latest_runs(batch), target, number)

    writer = runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_runs(spark: SparkSession, target: str) -> DataFrame:
    """Newest copy of each run over all batches, as the batch path has it."""
    found = batches.load(spark, target)
    if found is None:
        return spark.createDataFrame([], TABLES["bronze.compute_job_runs"].schema)
    return latest_runs(found.drop(batches.NUMBER))


def compact(spark: SparkSession, target: str) -> int:
    """One copy of the current runs for all batches so far; readers and writers go on as before."""
    return batches.compact(spark, target, latest_runs)


# ------------------------------------------------------------ bounded state


def first_copies(runs: DataFrame, days: int = REMEMBERED_DAYS) -> DataFrame:
    """Each distinct copy of a run once: same workspace, run and figures, whenever collected.

    A streaming frame. The state holds a row for each distinct copy collected in the
    last ``days`` days and forgets it when the watermark on the time of collection has
    passed; a copy that comes again later is let through again.
    """
    figures = [c for c in runs.columns if c != "collect_timestamp"]
    # nulls leave a hash as it is, so they are told apart by their places
    same = F.xxhash64(*figures, *[F.col(c).isNull() for c in figures])
    keyed = runs.withColumn("_figures", same).withWatermark("collect_timestamp", lateness.watermark(days))
    return keyed.dropDuplicatesWithinWatermark(["workspace_name", "run_id", "_figures"]).drop("_figures")


def advance(
    runs: DataFrame, target: str, checkpoint: str, *, days: int = REMEMBERED_DAYS
) -> StreamingQuery:
    """Take in what has come: late rows to their place, distinct fresh copies to ``target``/first.

    Late rows are stored as they come: ``final_runs`` has to choose among all copies anyway, and
    a shuffle of a long history for each batch that brings one would do its work twice.
    ``compact_final`` reduces them.

    Returns the finished stateful query, whose progress tells the size of its state.
    ``runs`` has the declared bronze columns, or some of them.
    """
    stamp = F.col("collect_timestamp")
    lateness.deal(runs, stamp, days, target, f"{checkpoint}/deal").awaitTermination()
    fresh = lateness.fresh_stream(runs.sparkSession, runs.schema, target)
    query = (
        first_copies(fresh, days)
        .writeStream.outputMode("append")
        .foreachBatch(lambda batch, number: batches.store(batch, f"{target}/first", number))
        .option("checkpointLocation", f"{checkpoint}/first")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def final_runs(spark: SparkSession, target: str) -> DataFrame:
    """Newest copy of each run over the distinct fresh copies and the late ones.

    A copy collected again keeps the time it was first collected at, so of the
    copies of a run the one that changed last counts.
    """
    parts = [f for f in (batches.load(spark, f"{target}/{p}") for p in ("first", "late")) if f is not None]
    if not parts:
        return spark.createDataFrame([], TABLES["bronze.compute_job_runs"].schema)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return latest_runs(rows.drop(batches.NUMBER))


def compact_final(spark: SparkSession, target: str) -> None:
    """Merge the stored copies of each part; ``final_runs`` stays as it is."""
    for part in ("first", "late"):
        batches.compact(spark, f"{target}/{part}", latest_runs)
