"""Failure patterns, stage shares and the cost of failing jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import columns as C, texts, timeutil as T
from meterline.functions.frames import top_n
from meterline.operators.silver import runs_since


def failure_patterns(
    runs: DataFrame, *, as_of: T.AsOf, days: int | None = None, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Most frequent error texts of failed runs per workspace.

    The pattern is the leading ``cfg.error_key_chars`` characters of the error,
    so that one error with varying details counts once.
    """
    failed = runs_since(runs, days or cfg.lookback_days, as_of=as_of).filter(
        F.col("is_failed") & C.is_present(F.col("error"))
    )
    counted = failed.groupBy(
        "workspace_name", F.substring("error", 1, cfg.error_key_chars).alias("error_pattern")
    ).agg(F.count(F.lit(1)).alias("occurrence_count"))
    listed = top_n(
        counted,
        cfg.errors_listed,
        ["workspace_name"],
        [F.col("occurrence_count").desc(), F.col("error_pattern")],
    )
    bands = ((cfg.error_high_count, "high"), (cfg.error_medium_count, "medium"))
    return listed.withColumns(
        {
            "severity": C.above(F.col("occurrence_count"), bands, "low"),
            "recommendation": F.lit(texts.FAILURE_ADVICE),
            "analysis_date": T.as_of_ts(as_of),
        }
    )


def stage_performance(runs: DataFrame, *, as_of: T.AsOf) -> DataFrame:
    """Average share of setup, execution and cleanup, and the longer of the first two."""
    stages = ("setup", "execution", "cleanup")
    means = runs.groupBy("workspace_name").agg(
        *[
            F.coalesce(F.avg(f"{s}_duration"), F.lit(0.0)).alias(f"avg_{s}_duration")
            for s in stages
        ]
    )
    total = sum((F.col(f"avg_{s}_duration") for s in stages), F.lit(0.0))
    return means.select(
        "workspace_name",
        *[f"avg_{s}_duration" for s in stages],
        *[
            C.ratio(F.col(f"avg_{s}_duration") * 100, total, 0.0).alias(f"{s}_percentage")
            for s in stages
        ],
        F.when(F.col("avg_setup_duration") > F.col("avg_execution_duration"), "setup")
        .otherwise("execution")
        .alias("bottleneck"),
        T.as_of_ts(as_of).alias("analysis_date"),
    )


def failure_waste(jobs: DataFrame, *, as_of: T.AsOf, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Jobs that fail often, what their failed runs cost, and how hard that hits."""
    waste = F.col("waste_cost_monthly")
    return (
        jobs.filter(F.col("failure_rate") > cfg.waste_failure_rate)
        .withColumn(
            "waste_cost_monthly", F.coalesce("failed_runs", F.lit(0)) * cfg.failed_run_usd
        )
        .select(
            "workspace_name",
            "job_id",
            "job_name",
            "failure_rate",
            "waste_cost_monthly",
            F.when(F.col("failure_rate") > cfg.waste_performance_rate, "high")
            .otherwise("medium")
            .alias("performance_impact"),
            C.above(
                waste, ((cfg.waste_high_usd, "high"), (cfg.waste_medium_usd, "medium")), "low"
            ).alias("cost_impact"),
            F.format_string(texts.WASTE_ADVICE, waste).alias("recommendation"),
            T.as_of_ts(as_of).alias("analysis_date"),
        )
    )
