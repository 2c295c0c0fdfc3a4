"""Silver to gold: flags, tiers, per-job and per-workspace summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import columns as C, timeutil as T
from meterline.functions.frames import spread_rank


def with_flags(silver: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Silver clusters with idle, overprovisioned and utilization columns added."""
    idle = F.col("idle_hours")
    return silver.withColumns(
        {
            "is_idle": C.truthy(idle > cfg.idle_hours),
            "is_overprovisioned": C.truthy(
                (F.col("num_workers") > cfg.overprovisioned_workers)
                & (idle > cfg.overprovisioned_idle_hours)
            ),
            "utilization_score": F.when(idle.isNull(), F.lit(cfg.utilization_unknown)).otherwise(
                C.below(idle, cfg.utilization_bands, cfg.utilization_floor)
            ),
        }
    )


def cluster_flags(silver: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per-cluster summary without the rank; what most other operators need."""
    return with_flags(silver, cfg=cfg).select(
        "workspace_name",
        "cluster_id",
        "cluster_name",
        "state",
        "num_workers",
        "memory_gb",
        "uptime_hours",
        "idle_hours",
        "is_idle",
        "is_overprovisioned",
        "utilization_score",
        "has_autoscaling",
        "process_timestamp",
    )


def gold_clusters(silver: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    flags = cluster_flags(silver, cfg=cfg)
    return spread_rank(
        flags, "workspace_name", "uptime_hours", cfg.rank_bucket_hours, "rank_by_uptime"
    )


def job_run_stats(runs: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Run counts, durations and rates per job."""
    spent = F.col("duration_hours")
    stats = runs.groupBy("workspace_name", "job_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if("is_success").alias("successful_runs"),
        F.count_if("is_failed").alias("failed_runs"),
        F.avg(spent).alias("avg_duration_hours"),
        F.max(spent).alias("max_duration_hours"),
        F.min(spent).alias("min_duration_hours"),
        F.sum(spent).alias("total_duration_hours"),
    )
    return with_rates(stats, cfg=cfg)


def with_rates(stats: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    runs = F.col("total_runs")
    return stats.withColumns(
        {"success_rate": F.col("successful_runs") / runs, "failure_rate": F.col("failed_runs") / runs}
    ).withColumn(
        "efficiency_score",
        C.at_least(F.col("success_rate"), cfg.efficiency_bands, cfg.efficiency_floor),
    )


def gold_jobs(jobs: DataFrame, run_stats: DataFrame) -> DataFrame:
    """Jobs with their run statistics; a job that never ran keeps nulls."""
    return jobs.join(run_stats, ["workspace_name", "job_id"], "left")


def gold_tables(silver: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    cold, gone = F.col("is_cold_data"), F.col("is_abandoned")
    size = F.col("size_gb")
    urgent = gone | (F.col("has_small_files") & (size > cfg.small_files_high_gb))
    worth = (cold & (size > cfg.cold_medium_gb)) | (
        ~F.col("is_partitioned") & (size > cfg.unpartitioned_medium_gb)
    )
    return silver.withColumns(
        {
            "storage_tier": F.when(cold, "cold")
            .when(F.col("days_since_accessed") > cfg.warm_days, "warm")
            .otherwise("hot"),
            "optimization_priority": F.when(urgent, "high").when(worth, "medium").otherwise("low"),
            "estimated_savings_gb": F.when(gone, size)
            .when(cold, size * cfg.cold_savings_share)
            .otherwise(0.0),
        }
    )


def storage_workspace_summary(silver: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    def tb_where(flag: str):
        return F.sum(F.when(F.col(flag), F.col("size_tb")).otherwise(0.0))

    totals = silver.groupBy("workspace_name").agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.sum("size_tb").alias("total_size_tb"),
        tb_where("is_cold_data").alias("cold_size_tb"),
        tb_where("is_abandoned").alias("abandoned_size_tb"),
        tb_where("has_small_files").alias("small_files_size_tb"),
        F.count_distinct("schema").alias("total_schemas"),
        F.avg("avg_file_size_mb").alias("avg_file_size_mb"),
        F.max("process_timestamp").alias("process_timestamp"),
    )

    def share(part: str):
        return F.when(
            F.col("total_size_tb") > 0, F.col(part) / F.col("total_size_tb") * 100
        ).otherwise(0.0)

    return totals.withColumns(
        {
            "cold_data_percentage": share("cold_size_tb"),
            "abandoned_data_percentage": share("abandoned_size_tb"),
        }
    )


def daily_cost(silver: DataFrame) -> DataFrame:
    return silver.groupBy("workspace_name", "date_parsed").agg(
        F.sum("cost_usd").alias("daily_cost_usd")
    )


def monthly_cost(daily: DataFrame) -> DataFrame:
    """Month totals and the average of the daily sums, from the already small daily rows."""
    return daily.groupBy(
        "workspace_name", F.year("date_parsed").alias("year"), F.month("date_parsed").alias("month")
    ).agg(
        F.sum("daily_cost_usd").alias("monthly_cost_usd"),
        F.avg("daily_cost_usd").alias("avg_daily_cost_usd"),
    )


def gold_billing(daily: DataFrame, *, as_of: T.AsOf) -> DataFrame:
    """Each day with its own month's figures.

    A month has at most 31 daily rows per workspace, so a window over it stays
    tiny and saves the join of days to months.
    """
    month = Window.partitionBy("workspace_name", "year", "month")
    dated = daily.withColumns({"year": F.year("date_parsed"), "month": F.month("date_parsed")})
    return dated.withColumns(
        {
            "monthly_cost_usd": F.sum("daily_cost_usd").over(month),
            "avg_daily_cost_usd": F.avg("daily_cost_usd").over(month),
            "process_timestamp": T.as_of_ts(as_of),
        }
    )
