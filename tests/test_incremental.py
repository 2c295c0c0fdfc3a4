"""Folding in what is new ends where processing everything ends, and touches only its months."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from meterline.fixtures import DAY, SNAPSHOTS, Bronze
from meterline.operators import partials
from meterline.plans import incremental
from meterline.plans.pipeline import Warehouse
from meterline.schemas import TABLES
from meterline.sources import layers

NAMES = ("clusters", "jobs", "runs", "tables", "billing")
TARGETS = ("compute_clusters", "compute_jobs", "compute_job_runs", "storage_tables", "billing_costs")


def collected(spark, folder, floor, until):
    """Bronze rows of three workspaces that one collection brought; one workspace skips the second."""
    bronze = Bronze(spark, folder)
    at = F.unix_millis("collect_timestamp")
    out = {}
    for name, target in zip(NAMES, TARGETS):
        df = getattr(bronze, name).filter(F.col("workspace_name").isin("ws_1", "ws_2", "ws_3"))
        if name in ("runs", "billing"):  # the last months'
            df = df.filter(at >= SNAPSHOTS[0] - 120 * DAY)
        df = df.filter((at > floor) & (at <= until))
        out[target] = df.filter("workspace_name <> 'ws_3'") if until == SNAPSHOTS[1] else df
    return out


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def both(spark, tiny, tmp_path_factory):
    paths = [str(tmp_path_factory.mktemp(n)) for n in ("full", "folded")]
    floor, changed = 0, []
    for until in SNAPSHOTS:
        for path in paths:
            for name, df in collected(spark, tiny, floor, until).items():
                layers.append(df, f"bronze.{name}", path, as_of=until)
        Warehouse(spark, paths[0], until).process()
        silver = f"{paths[1]}/silver/compute_job_runs"
        before = files_of(silver)
        Warehouse(spark, paths[1], until).process_new()
        changed.append((before, files_of(silver)))
        floor = until
    return Warehouse(spark, paths[0], until), Warehouse(spark, paths[1], until), changed


TABLES_OUT = [f"silver.{t}" for t in TARGETS] + [
    f"gold.{t}"
    for t in (
        "compute_clusters_summary",
        "compute_jobs_summary",
        "storage_tables_summary",
        "storage_workspace_summary",
        "billing_costs_summary",
        "costs_dbu_estimates",
    )
]


def shown(df):
    rows = []
    for r in df.collect():
        kept = {c: round(v, 6) if isinstance(v, float) else v for c, v in r.asDict().items() if c != "process_timestamp"}
        rows.append(repr(sorted(kept.items())))
    return sorted(rows)


@pytest.mark.parametrize("name", TABLES_OUT)
def test_folding_equals_processing_everything(both, name):
    full, fold, _ = both
    want = shown(full.read(name))
    assert want and shown(fold.read(name)) == want


def test_untouched_months_keep_their_files(both):
    _, _, changed = both
    month = lambda f: f.split("start_month=")[1][:7]
    before, after = changed[2]
    rewritten = {month(f) for f in before - after}
    assert rewritten and rewritten <= {"2001-05", "2001-06", "2001-07", "2001-08"}
    assert len({month(f) for f in before & after}) > 2


def test_scan_opens_only_touched_months(both):
    _, fold, _ = both
    new = fold.spark.sql("select date'2001-07-01' as start_month")
    rows = incremental._of_months(fold, incremental.RUNS, new, ["start_month"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*start_month", plan)
    rows.collect()
    assert rows.select(F.min("start_time")).first()[0] >= 993_945_600_000


def test_folding_again_changes_nothing(both):
    _, fold, _ = both
    names = ("silver.compute_job_runs", "gold.job_run_months", "gold.daily_costs", "silver.compute_clusters")
    before = {n: shown(fold.read(n)) for n in names}
    fold.process_new()
    assert {n: shown(fold.read(n)) for n in names} == before


def test_partials_of_any_cut_add_up(both, spark):
    full, *_ = both
    runs = full.read("silver.compute_job_runs")
    halves = [runs.filter(F.col("run_id") % 2 == i) for i in (0, 1)]
    cut = partials.run_months(halves[0]).unionByName(partials.run_months(halves[1]))
    whole = partials.job_run_stats(partials.run_months(runs))
    assert shown(partials.job_run_stats(cut)) == shown(whole)


def test_sketches_count_a_schema_once(spark):
    rows = [(f"w{i % 3}", f"s{i % 40}", 1.0) for i in range(200)]
    tables = spark.createDataFrame(rows, "workspace_name string, schema string, size_tb double")
    got = partials.over_workspaces(partials.schema_sketches(tables)).first()
    assert (got.total_tables, got.total_size_tb, got.total_schemas) == (200, 200.0, 40)


def runs_like(spark, *rows):
    """(workspace, month, run) as silver runs."""
    df = spark.createDataFrame(list(rows), "workspace_name string, month string, run_id bigint")
    return df.withColumn("start_month", F.col("month").cast("date"))


def test_workspaces_are_replaced_by_one_scan(spark, tmp_path):
    name, path = "silver.compute_job_runs", str(tmp_path)
    layers.replace(
        runs_like(spark, *[(f"w{i}", f"2024-0{m}-01", i * 10 + m) for i in range(5) for m in (1, 2)]), name, path
    )
    scans = spark.sparkContext.accumulator(0)

    def count(batches):
        scans.add(1)
        yield from batches

    new = runs_like(spark, *[(f"w{i}", "2024-01-01", 100 + i) for i in (1, 2, 3)]).coalesce(1)
    new = new.mapInArrow(count, new.schema)
    layers.replace(new, name, path, workspaces=["w1", "w2", "w3", "w4"])
    assert scans.value == 1
    got = {(r.workspace_name, str(r.start_month), r.run_id) for r in layers.read(spark, name, path).collect()}
    want = {("w0", "2024-01-01", 1), ("w0", "2024-02-01", 2)} | {(f"w{i}", "2024-01-01", 100 + i) for i in (1, 2, 3)}
    assert got == want  # w4 and the second months are gone


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    name, path = "silver.compute_job_runs", str(tmp_path)
    layers.replace(runs_like(spark, ("w1", "2024-01-01", 1), ("w2", "2024-01-01", 2)), name, path)
    before = shown(layers.read(spark, name, path))
    bad = runs_like(spark, ("w1", "2024-01-01", 7), ("w2", "2024-01-01", 8)).withColumn(
        "run_id", F.when(F.col("run_id") == 8, F.raise_error(F.lit("broken"))).otherwise(F.col("run_id"))
    )
    with pytest.raises(Exception, match="broken"):
        layers.replace(bad, name, path, workspaces=["w1", "w2"])
    assert shown(layers.read(spark, name, path)) == before


def test_declared_partials():
    assert {"gold.job_run_months", "gold.daily_costs", "gold.folded_days"} <= set(TABLES)
