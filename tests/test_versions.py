"""Version intervals, dated rates and co-located storage."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from meterline import fixtures_payloads as files
from meterline.fixtures import BASELINE, SNAPSHOTS, Bronze, estate
from meterline.operators import history, silver

START = datetime(2024, 1, 1)


def snapshots(spark, seed=3):
    """Collections of two workspaces at their own times; resources come, change, go and come back."""
    rnd = random.Random(seed)
    rows = []
    for ws, every in (("w1", 1), ("w2", 2)):
        for no in range(0, 12, every):
            for key in range(8):
                if rnd.random() < 0.75:
                    value = rnd.choice([None, "a", "b"])
                    rows += [(ws, key, value, None if value else "a", START + timedelta(days=no))] * rnd.choice([1, 1, 2])
    return spark.createDataFrame(rows, "workspace_name string, job_id long, x string, y string, collect_timestamp timestamp")


def millis(at):
    return int((at - datetime(1970, 1, 1)).total_seconds() * 1000)


def test_intervals_give_every_state(spark):
    bronze = snapshots(spark)
    intervals = history.version_intervals(bronze, ["job_id"]).cache()
    columns = ["workspace_name", "job_id", "x", "y"]
    for day in range(-1, 14):
        at = millis(START + timedelta(days=day, hours=5))
        want = silver.latest_snapshot(bronze, ["job_id"], at).select(*columns)
        got = history.valid_at(intervals, as_of=at).select(*columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        new = history.appeared_since(intervals, "job_id", baseline=at)
        assert sorted(new.collect()) == sorted(history.new_since(bronze, "job_id", baseline=at).collect())
    assert intervals.count() < bronze.dropDuplicates().count()


def test_intervals_of_the_fixture_have_fewer_rows(spark, tiny):
    bronze = Bronze(spark, tiny)
    e = estate(spark, tiny)
    assert e.job_versions.count() < bronze.jobs.count() / 2
    for at in SNAPSHOTS:
        want = silver.latest_snapshot(bronze.jobs, ["job_id"], at).select("workspace_name", "job_id", "tags")
        got = history.valid_at(e.job_versions, as_of=at).select("workspace_name", "job_id", "tags")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    got = history.appeared_since(e.job_versions, "job_id", baseline=BASELINE)
    assert sorted(got.collect()) == sorted(history.new_since(bronze.jobs, "job_id", baseline=BASELINE).collect())


def test_newest_rate_on_or_before_the_day(spark):
    rates = [("EUR", date(2024, 1, 5), 1.1), ("EUR", date(2024, 1, 10), 1.2), ("EUR", date(2024, 1, 10), 1.15), ("GBP", date(2024, 1, 1), 1.3)]
    fx = spark.createDataFrame(rates, "currency string, valid_from date, rate double")
    lines = [
        ("2024-01-04", "EUR"), ("2024-01-05", "EUR"), ("2024-01-09", "EUR"), ("2024-01-10", "EUR"), ("2025-01-01", "EUR"),
        ("2024-01-04", "GBP"), ("2024-01-04", "USD"), ("2024-01-04", "JPY"), ("no day", "EUR"), ("2024-01-05", None),
    ]
    costs = spark.createDataFrame([(d, c, 100.0, i) for i, (d, c) in enumerate(lines)], "date string, currency string, cost double, i int")
    got = {r.i: r.cost_usd for r in silver.silver_billing(costs, as_of=BASELINE, fx=fx).collect()}
    want = [100.0, 110.0, 110.0, 120.0, 120.0, 130.0, 100.0, 100.0, 100.0, 100.0]
    assert [round(got[i], 6) for i in range(len(lines))] == want


def test_colocated_tables_need_no_shuffle(spark, tiny, tmp_path):
    e = estate(spark, tiny)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = files.gold_jobs_colocated(e.jobs, e.runs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        columns = ["workspace_name", "job_id", "total_runs", "failed_runs", F.round("avg_duration_hours", 8).alias("avg")]
        want = e.gold_jobs.select(*columns).collect()
        assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
