"""Streams over files in several batches equal the batch result."""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import functions as F

from meterline import fixtures_payloads as files
from meterline.fixtures import Bronze, estate
from meterline.operators import silver
from meterline.schemas import TABLES
from meterline.streaming import batches, costs, lateness, runs


def keys(df):
    cols = ("workspace_name", "run_id", "result_state", "execution_duration")
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pages_streamed_twice_end_with_the_newest_state(spark, tiny, tmp_path):
    known = Bronze(spark, tiny).runs
    once = silver.latest_runs(known)
    source, target, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))
    flying = F.col("result_state") == "RUNNING"
    for part in (known.filter(flying), known.filter(~flying), known.filter(flying)):  # old copies come again
        files.run_pages(part).coalesce(4).write.mode("append").json(source)
        runs.store_updates(runs.page_stream(spark, source), target, checkpoint).awaitTermination()
    assert keys(runs.current_runs(spark, target)) == keys(once)
    assert not [k for k in keys(once) if k[2] == "RUNNING"]
    before = batches.load(spark, target).count()
    assert runs.compact(spark, target) == 2
    assert keys(runs.current_runs(spark, target)) == keys(once)
    assert batches.load(spark, target).count() == once.count() < before


def test_stream_equals_batch(spark, tiny):
    e = estate(spark, tiny)
    assert keys(files.stream_job_runs(e.bronze)) == keys(e.runs)


def test_days_collected_again_are_replaced(spark, tiny):
    e = estate(spark, tiny)
    got = {(r.workspace_name, r.date_parsed): round(r.daily_cost_usd, 6) for r in files.stream_daily_cost(e.bronze).collect()}
    want = {(r.workspace_name, r.date_parsed): round(r.daily_cost_usd, 6) for r in e.daily.collect()}
    assert got == want


def test_collecting_twice_changes_nothing(spark, tiny):
    bill = Bronze(spark, tiny).billing
    total = lambda df: df.agg(F.round(F.sum("cost"), 4)).first()[0]
    old = bill.filter("date < '1999-01-01'")
    newest = silver.newest_collection(old)
    both = old.unionByName(newest.withColumn("collect_timestamp", F.col("collect_timestamp") + F.expr("interval 90 days")))
    assert total(silver.newest_collection(both)) == total(newest) < total(old)


def test_retried_batch_is_stored_once(spark, tmp_path):
    target = str(tmp_path / "t")
    day = spark.sql("select 'w' workspace_name, 'aws' cloud, date'2024-01-01' date_parsed, timestamp'2024-01-02' collect_timestamp, 1.0D cost_usd")
    for number, value in ((0, 5), (0, 2), (1, 3)):
        day.withColumn("cost_usd", F.lit(float(value))).write.mode("overwrite").parquet(f"{target}/batch_id={number}")
    later = day.selectExpr("workspace_name", "'gcp' cloud", "date_parsed", "timestamp'2024-02-02' collect_timestamp", "7.0D cost_usd")
    later.write.mode("overwrite").parquet(f"{target}/batch_id=2")
    assert [r.daily_cost_usd for r in costs.current_daily_cost(spark, target).collect()] == [12.0]


def run_rows(spark, *rows):
    """(run, result, day of collection) as bronze runs."""
    data = [("w", i, state, day) for i, state, day in rows]
    df = spark.createDataFrame(data, "workspace_name string, run_id bigint, result_state string, day int")
    stamp = F.timestamp_seconds(F.lit(1_700_006_400) + F.col("day") * 86_400)
    schema = TABLES["bronze.compute_job_runs"].schema
    df = df.withColumn("collect_timestamp", stamp).withColumn("start_time", F.lit(0).cast("bigint"))
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def test_state_is_bounded_and_no_run_is_lost(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))

    def take(*rows):
        run_rows(spark, *rows).write.mode("append").parquet(source)
        query = runs.advance(runs.bronze_stream(spark, source), target, checkpoint)
        return query.recentProgress[-1].stateOperators[0]

    def final():
        return sorted((r.run_id, r.result_state) for r in runs.final_runs(spark, target).collect())

    take(*[(i, "RUNNING" if i % 3 else "SUCCESS", 0) for i in range(60)])
    state = take(*[(i, "SUCCESS", 10) for i in range(60)])  # a third is collected again, the rest has ended
    assert batches.load(spark, f"{target}/first").count() == 60 + 40
    assert state.numRowsTotal == 100 and final() == [(i, "SUCCESS") for i in range(60)]
    state = take((100, "SUCCESS", 100))  # the watermark passes all copies of day 0 and 10
    assert state.numRowsTotal <= 1 and state.numRowsDroppedByWatermark == 0
    state = take((200, "FAILED", 20), (3, "SUCCESS", 15), (100, "SUCCESS", 101))  # two late ones, one known
    assert state.numRowsDroppedByWatermark == 0
    assert sorted(r.run_id for r in batches.load(spark, f"{target}/late").collect()) == [3, 200]
    want = sorted([(i, "SUCCESS") for i in range(60)] + [(100, "SUCCESS"), (200, "FAILED")])
    assert final() == want
    runs.compact_final(spark, target)
    assert final() == want


def lines_of(spark, *rows):
    """(day, cost, day of collection) as silver billing lines."""
    df = spark.createDataFrame(list(rows), "day int, cost_usd double, seen int")
    return df.select(
        F.lit("w").alias("workspace_name"),
        F.lit("aws").alias("cloud"),
        F.when(F.col("day") >= 0, F.date_add(F.lit("2024-01-01").cast("date"), "day")).alias("date_parsed"),
        "cost_usd",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("seen") * 86_400).alias("collect_timestamp"),
    )


PARTS = (
    [(0, 1.0, 0), (1, 2.0, 1), (1, 2.5, 1), (-1, 7.0, 1)],
    [(0, 4.0, 20), (1, 0.5, 1), (40, 3.0, 40)],  # day 0 again, day 1 goes on
    [(90, 5.0, 90)],
    [(1, 9.0, 91), (0, 1.0, 20), (90, 1.5, 90)],  # days closed long ago
)
DAYS = {None: 7.0, 0: 5.0, 1: 9.0, 40: 3.0, 90: 6.5}


def take_costs(spark, folder, parts):
    source, target, checkpoint = (f"{folder}/{p}" for p in ("in", "out", "cp"))
    sizes = []
    for part in parts:
        rows = lines_of(spark, *part)
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        sizes.append(costs.advance(stream, target, checkpoint).recentProgress[-1].stateOperators[0].numRowsTotal)
    return target, sizes


def days_of(df):
    first = date(2024, 1, 1)
    return {r.date_parsed and (r.date_parsed - first).days: r.daily_cost_usd for r in df.collect()}


def test_windows_revise_open_days_and_forget_closed_ones(spark, tmp_path):
    target, sizes = take_costs(spark, str(tmp_path), PARTS)
    assert days_of(costs.windowed_daily_cost(spark, target)) == DAYS
    assert sizes[-1] <= 1 < max(sizes)  # only day 90 is open
    assert batches.load(spark, f"{target}/late").count() > 0
    costs.compact_windows(spark, target)
    assert days_of(costs.windowed_daily_cost(spark, target)) == DAYS


def test_batches_may_be_cut_anywhere(spark, tmp_path):
    whole, _ = take_costs(spark, str(tmp_path / "a"), [sum(PARTS, [])])
    halves, _ = take_costs(spark, str(tmp_path / "b"), [sum(PARTS[:2], []), sum(PARTS[2:], [])])
    for target in (whole, halves):
        assert days_of(costs.windowed_daily_cost(spark, target)) == DAYS


def test_retried_deal_changes_nothing(spark, tmp_path):
    """A batch whose fresh rows are complete is not written again."""
    target, _ = take_costs(spark, str(tmp_path), PARTS[:1])
    path = f"{target}/fresh/batch_id=0000000000"
    before = sorted(os.listdir(path))
    rows = lines_of(spark, *PARTS[0])
    again = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    lateness.deal(again, costs._event_time(), costs.OPEN_DAYS, target, f"{tmp_path}/lost-checkpoint").awaitTermination()
    assert sorted(os.listdir(path)) == before
