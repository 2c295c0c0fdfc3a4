"""Rows that are too old for a stream's state get a place of their own.

A stateful operator forgets keys that the watermark has passed and would drop rows
that still come for them. So a stream is first dealt in two: rows not older than
``days`` before the newest event time seen so far, this batch included, are fresh;
all others, and those without an event time, are late. The stateful query reads the
fresh folders only, with a watermark a second wider, so it never drops a row, and
readers add what the late folders hold. The first load of a long history thus
passes the state by.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from meterline.streaming import batches


def watermark(days: int) -> str:
    """Delay under which the rows that ``deal`` calls fresh are never late."""
    return f"{days * 86_400 + 1} seconds"


def deal(
    rows: DataFrame,
    event_time: Column,
    days: int,
    target: str,
    checkpoint: str,
    reduce_late: Callable[[DataFrame], DataFrame] = lambda late: late,
) -> StreamingQuery:
    """Store each batch's fresh rows in ``target``/fresh and its late ones, reduced, in ``target``/late.

    The newest event time so far is stored with each batch, so a batch that is
    retried deals its rows as before. A batch whose fresh rows are complete is not
    written again: the stateful query may have read them.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        fresh = f"{target}/fresh/batch_id={number:010d}"
        if batches.complete(spark, fresh):
            return
        marks = batch.agg(F.max(event_time).alias("newest"))
        if number:
            marks = marks.unionByName(spark.read.parquet(f"{target}/mark/batch_id={number - 1:010d}").select("newest"))
        batches.store(marks.agg(F.max("newest").alias("newest")), f"{target}/mark", number)
        newest = spark.read.parquet(f"{target}/mark/batch_id={number:010d}").first().newest
        is_fresh = F.lit(False)
        if newest is not None:
            floor = F.lit(newest) - F.expr(f"interval {days} days")
            is_fresh = F.coalesce(event_time >= floor, F.lit(False))
        batches.store(reduce_late(batch.filter(~is_fresh)), f"{target}/late", number)
        batch.filter(is_fresh).write.mode("overwrite").parquet(fresh)

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fresh_stream(spark: SparkSession, schema, target: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """The fresh rows as a stream; ``deal`` has stored a batch before this starts."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{target}/fresh/*")
    )
