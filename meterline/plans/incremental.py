"""Daily processing that reads what is new and rewrites the months it touches.

Silver runs and billing lie in month folders of a workspace, and each month has a
partial result. A fold takes the bronze days that came since the last one, merges
them with the silver folders of the months they touch, exchanges these folders and
their partials, and adds the partials up. Nothing else of the history is read.

A fold can be run again at any time: the last folded day is taken in once more if its
folder has changed or had rows beyond the instant, and copies already known change
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime, timezone
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from meterline.operators import partials, silver
from meterline.session import shared_folder
from meterline.sources import layers

if TYPE_CHECKING:
    from meterline.plans.pipeline import Warehouse

RUNS, COSTS = "compute_job_runs", "billing_costs"
#: What a collection of billing lines is known by; its lines come together.
COLLECTION = ("workspace_name", "cloud", "date", "collect_timestamp")


def unfolded(run: Warehouse, name: str) -> tuple[DataFrame, list] | None:
    """Bronze rows known now of the days to fold, and the mark to keep; None without such days.

    Only the folders of those days are opened. The mark is the newest day with the
    files and bytes its folder has now; with rows beyond the instant it has none.
    """
    table, at = f"bronze.{name}", F.timestamp_millis(F.lit(run.as_of).cast("bigint"))
    last, size = "", None
    if layers.exists(run.spark, "gold.folded_days", run.path):
        for r in run.read("gold.folded_days").filter(F.col("table_name") == name).collect():  # one row
            last, size = str(r.snapshot_date), (r.n_files, r.n_bytes)
    today = str(datetime.fromtimestamp(run.as_of / 1000, tz=timezone.utc).date())
    known = [d for d in layers.days(run.spark, table, run.path) if last <= d <= today]
    new = [d for d in known if d > last or layers.day_size(run.spark, table, run.path, d) != size]
    if not new:
        return None
    mark = [name, date.fromisoformat(new[-1]), *layers.day_size(run.spark, table, run.path, new[-1])]
    newest = layers.read(run.spark, table, run.path).filter(F.col(layers.DAY) == F.lit(mark[1]))
    if not newest.filter(F.col("collect_timestamp") > at).isEmpty():
        mark[2:] = [None, None]
    # day folders are few and known by name, so the scan is cut to them while planning
    return layers.read_known(run.spark, table, run.path, as_of=run.as_of, days=new), mark


def folded(run: Warehouse, mark: list) -> None:
    """Remember what has been taken in; written last."""
    row = run.spark.createDataFrame([tuple(mark)], "table_name string, snapshot_date date, n_files bigint, n_bytes bigint")
    row = row.withColumn("process_timestamp", F.timestamp_millis(F.lit(run.as_of).cast("bigint")))
    layers.replace_parts(row, "gold.folded_days", run.path)


def _staged(df: DataFrame, label: str) -> DataFrame:
    """Written apart first: the folders it replaces are among its inputs."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _of_months(run: Warehouse, name: str, new: DataFrame, months: list[str]) -> DataFrame:
    """Silver rows, as bronze has them, of the months of ``new``.

    Months are bounded by the calendar; as literals they cut the scan to their folders.
    All workspaces of a month belong to it: they are collected together.
    """
    inside = F.lit(False)
    for r in new.select(*months).distinct().collect():
        same = [F.col(c).isNull() if r[c] is None else F.col(c) == F.lit(r[c]) for c in months]
        inside = inside | reduce(Column.__and__, same)
    bronze = [f.name for f in layers.TABLES[f"bronze.{name}"].schema]
    return run.read(f"silver.{name}").filter(inside).select(*bronze)


def _same(columns: Sequence[str]) -> Column:
    """Columns equal those of the same name after an underscore; nulls equal nulls."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])


def _merge(
    run: Warehouse,
    name: str,
    months: list[str],
    newest: Callable[[DataFrame], DataFrame],
    derive: Callable[..., DataFrame],
    whole: tuple[str, ...] = (),
) -> tuple[DataFrame, list] | None:
    """Silver rows of the touched months, old and new, as stored, and the mark; None if nothing is new.

    Stored rows that share the ``whole`` columns with new ones give way to them: a day
    that is taken in again brings all of these rows again.
    """
    found = unfolded(run, name)
    if found is None:
        return None
    new, mark = found
    fresh = derive(new, as_of=run.as_of, cfg=run.cfg)
    rows, table = new, f"silver.{name}"
    known = layers.exists(run.spark, table, run.path)
    if known:
        stored = _of_months(run, name, fresh, months)
        if whole:
            again = new.select(*[F.col(c).alias(f"_{c}") for c in whole]).distinct()
            stored = stored.join(again, _same(whole), "left_anti")
        rows = rows.unionByName(stored)
    merged = derive(newest(rows), as_of=run.as_of, cfg=run.cfg)
    if known:
        merged = _staged(merged, name)
    layers.replace_parts(merged, table, run.path)
    # the first fold, of a whole history, makes the table: what it wrote is what is there
    return merged if known else run.read(table), mark


def fold_runs(run: Warehouse) -> None:
    """New run copies into silver and into the partial results of their months."""
    if found := _merge(run, RUNS, ["start_month"], silver.latest_runs, silver.silver_job_runs):
        layers.replace_parts(partials.run_months(found[0]), "gold.job_run_months", run.path)
        folded(run, found[1])


def fold_costs(run: Warehouse) -> None:
    """New billing lines into silver and into the daily costs of their months."""
    if found := _merge(run, COSTS, ["year", "month"], silver.newest_collection, silver.silver_billing, COLLECTION):
        layers.replace_parts(partials.daily_costs(found[0]), "gold.daily_costs", run.path)
        folded(run, found[1])


def fold_inventory(run: Warehouse, name: str, key: str, derive: Callable[..., DataFrame]) -> None:
    """Newly collected workspaces exchange their resources; ages of the others go on."""
    found, known = unfolded(run, name), layers.exists(run.spark, f"silver.{name}", run.path)
    if found is None and not known:
        return
    bronze = [f.name for f in layers.TABLES[f"bronze.{name}"].schema]
    rows = run.read(f"silver.{name}").select(*bronze) if known else None
    if found is not None:
        new = silver.latest_snapshot(found[0], [key])
        if rows is not None:
            kept = rows.join(new.select("workspace_name").distinct(), "workspace_name", "left_anti")
            new = new.unionByName(kept)
        rows = new
    run.replace(_staged(derive(rows, as_of=run.as_of, cfg=run.cfg), name), f"silver.{name}")
    if found is not None:
        folded(run, found[1])


def run_stats(run: Warehouse) -> DataFrame:
    """Run statistics of every job from the stored partials."""
    return partials.job_run_stats(run.read("gold.job_run_months"), cfg=run.cfg)


def daily(run: Warehouse) -> DataFrame:
    """Daily cost of every workspace from the stored partials."""
    return run.read("gold.daily_costs").select("workspace_name", "date_parsed", "daily_cost_usd")
