"""Mergeable partial results: sums of closed groups that add up to the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.operators import gold


def run_months(runs: DataFrame) -> DataFrame:
    """Counts and durations of each job's runs of a month."""
    spent = F.col("duration_hours")
    return runs.groupBy("workspace_name", "job_id", "start_month").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if("is_success").alias("successful_runs"),
        F.count_if("is_failed").alias("failed_runs"),
        F.count(spent).alias("timed_runs"),
        F.sum(spent).alias("sum_duration_hours"),
        F.max(spent).alias("max_duration_hours"),
        F.min(spent).alias("min_duration_hours"),
    )


def job_run_stats(months: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``gold.job_run_stats`` from ``run_months`` of any cut of the runs."""
    total = F.sum("sum_duration_hours")
    merged = months.groupBy("workspace_name", "job_id").agg(
        *[F.sum(c).alias(c) for c in ("total_runs", "successful_runs", "failed_runs")],
        (total / F.sum("timed_runs")).alias("avg_duration_hours"),
        F.max("max_duration_hours").alias("max_duration_hours"),
        F.min("min_duration_hours").alias("min_duration_hours"),
        total.alias("total_duration_hours"),
    )
    return gold.with_rates(merged, cfg=cfg)


def daily_costs(billing: DataFrame) -> DataFrame:
    """Daily cost with the month it belongs to; the rows of a month make its partial."""
    return gold.daily_cost(billing).withColumns(
        {"year": F.year("date_parsed"), "month": F.month("date_parsed")}
    )


def schema_sketches(tables: DataFrame) -> DataFrame:
    """Table count, size and a sketch of the schema names of each workspace."""
    return tables.groupBy("workspace_name").agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.sum("size_tb").alias("total_size_tb"),
        F.hll_sketch_agg("schema").alias("schemas"),
    )


def over_workspaces(sketches: DataFrame) -> DataFrame:
    """Totals over all workspaces; schemas of the same name count once, by the merged sketch.

    Distinct counts do not add up, their sketches do: no table row is read again.
    """
    merged = sketches.agg(
        F.sum("total_tables").alias("total_tables"),
        F.sum("total_size_tb").alias("total_size_tb"),
        F.hll_union_agg("schemas").alias("schemas"),
    )
    return merged.select("total_tables", "total_size_tb", F.hll_sketch_estimate("schemas").alias("total_schemas"))
