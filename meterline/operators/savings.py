"""Savings estimates: column expressions priced from a resource's own figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import columns as C, texts, timeutil as T
from meterline.functions.frames import per_workspace
from meterline.operators.scores import actual_monthly_cost

DAY_HOURS = 24
MONTH_DAYS = 30
MONTHS = 12


# ---------------------------------------------------------------- monthly savings


def idle_month(cfg: EngineConfig = DEFAULT) -> Column:
    """Cost of a month of the present daily idle hours; all of it is saved by stopping."""
    return (
        C.zero_if_null(F.col("idle_hours"))
        * F.coalesce(F.col("num_workers"), F.lit(0))
        * cfg.worker_hour_usd
        * MONTH_DAYS
    )


def storage_month(cfg: EngineConfig = DEFAULT) -> Column:
    return C.zero_if_null(F.col("size_gb")) * cfg.gb_month_usd


def failure_waste(cfg: EngineConfig = DEFAULT) -> Column:
    return (
        F.coalesce(F.col("failed_runs"), F.lit(0))
        * C.zero_if_null(F.col("avg_duration_hours"))
        * cfg.run_hour_usd
    )


def archive_saving(cfg: EngineConfig = DEFAULT) -> Column:
    return storage_month(cfg) * cfg.archive_saved


def optimize_saving(cfg: EngineConfig = DEFAULT) -> Column:
    return storage_month(cfg) * cfg.optimize_saved


def fix_failures_saving(cfg: EngineConfig = DEFAULT) -> Column:
    return failure_waste(cfg) * cfg.fix_failures_saved


# ---------------------------------------------------------------- full estimates


def _percent(share: float) -> float:
    return round(share * 100, 6)


def _option(
    action: str, current: Column, target: Column | None, saved: Column, pct: float, sure: str
) -> Column:
    return F.struct(
        F.lit(action).alias("action"),
        current.cast("double").alias("current_monthly_cost"),
        (F.lit(None) if target is None else target).cast("double").alias("estimated_monthly_cost"),
        saved.cast("double").alias("estimated_monthly_savings"),
        (saved * MONTHS).cast("double").alias("estimated_annual_savings"),
        F.lit(pct).alias("reduction_percentage"),
        F.lit(sure).alias("confidence"),
        F.lit(0.0).alias("payback_months"),
    )


def _options(df: DataFrame, key: str, options: list[Column]) -> DataFrame:
    return df.select("workspace_name", key, F.inline(F.array(*options)))


def savings_clusters(flags: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Three options for every cluster."""
    workers = F.coalesce(F.col("num_workers"), F.lit(0))
    month = workers * cfg.worker_hour_usd * DAY_HOURS * MONTH_DAYS
    elastic = workers * (1 - cfg.autoscaling_saved) * cfg.worker_hour_usd * DAY_HOURS * MONTH_DAYS
    fewer = F.greatest(F.lit(1), (workers * cfg.resize_factor).cast("int"))
    resized = fewer * cfg.worker_hour_usd * DAY_HOURS * MONTH_DAYS
    idle = idle_month(cfg)
    return _options(
        flags,
        "cluster_id",
        [
            _option("terminate_idle", idle, None, idle, 100.0, "high"),
            _option("enable_autoscaling", month, elastic, month - elastic, _percent(cfg.autoscaling_saved), "medium"),
            _option("resize_cluster", month, resized, month - resized, _percent(1 - cfg.resize_factor), "medium"),
        ],
    )


def savings_tables(tables: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Three options for every table."""
    month = storage_month(cfg)
    saved = archive_saving(cfg)
    tidy = optimize_saving(cfg)
    out = _options(
        tables,
        "full_table_name",
        [
            _option("archive_abandoned", month, month - saved, saved, _percent(cfg.archive_saved), "high"),
            _option("delete_abandoned", month, F.lit(0.0), month, 100.0, "high"),
            _option("optimize_small_files", month, month - tidy, tidy, _percent(cfg.optimize_saved), "medium"),
        ],
    )
    return out.withColumn(
        "performance_improvement",
        F.when(F.col("action") == "optimize_small_files", texts.OPTIMIZE_GAIN),
    )


def savings_jobs(jobs: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Two options for every job; the remaining waste is what the stated reduction leaves."""
    waste, fixed = failure_waste(cfg), fix_failures_saving(cfg)
    month = (
        F.coalesce(F.col("total_runs"), F.lit(0))
        * C.zero_if_null(F.col("avg_duration_hours"))
        * cfg.run_hour_usd
    )
    faster = month * cfg.long_runs_saved
    return _options(
        jobs,
        "job_id",
        [
            _option("fix_failures", waste, waste - fixed, fixed, _percent(cfg.fix_failures_saved), "high"),
            _option("optimize_long_runs", month, month - faster, faster, _percent(cfg.long_runs_saved), "medium"),
        ],
    )


def issue_savings(cfg: EngineConfig = DEFAULT) -> Column:
    """Total-ROI saving of one issue: stop compute, archive storage, nothing else."""
    return (
        F.when(F.col("category") == "compute", idle_month(cfg))
        .when(F.col("category") == "storage", archive_saving(cfg))
        .otherwise(0.0)
    )


def issue_totals(issues: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Issue counts and the savings of the high ones, from one pass over the issues."""
    high = F.col("severity") == "high"
    return issues.groupBy("workspace_name").agg(
        F.count(F.lit(1)).cast("int").alias("total_issues"),
        F.count_if(high).cast("int").alias("high_issues"),
        F.count_if(F.col("severity") == "medium").cast("int").alias("medium_issues"),
        F.sum(F.when(high, issue_savings(cfg))).alias("saved"),
    )


def roi_columns(as_of: T.AsOf) -> list[Column]:
    """ROI figures from the columns ``saved`` and ``actual_monthly_cost``."""
    cost = C.zero_if_null(F.col("actual_monthly_cost"))
    gain = C.zero_if_null(F.col("saved"))
    return [
        F.round(cost, 2).alias("current_monthly_cost"),
        F.round(cost - gain, 2).alias("estimated_monthly_cost"),
        F.round(gain, 2).alias("estimated_monthly_savings"),
        F.round(gain * MONTHS, 2).alias("estimated_annual_savings"),
        F.round(F.when(cost > 0, gain / cost * 100).otherwise(0.0), 2).alias(
            "reduction_percentage"
        ),
        F.lit("medium").alias("confidence"),
        F.lit(texts.MARGIN_OF_ERROR).alias("margin_of_error"),
        T.as_of_ts(as_of).alias("calculation_timestamp"),
    ]


def monthly_actual(daily: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return actual_monthly_cost(daily, cfg=cfg).select("workspace_name", "actual_monthly_cost")


def total_roi(
    issues: DataFrame, daily: DataFrame, *, as_of: T.AsOf, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Savings of all high issues against the actual monthly cost, per workspace."""
    totals = issue_totals(issues.filter(F.col("severity") == "high"), cfg=cfg)
    merged = per_workspace(
        totals.select("workspace_name", "saved"), monthly_actual(daily, cfg=cfg)
    )
    return merged.select("workspace_name", *roi_columns(as_of))
