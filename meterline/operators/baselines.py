"""Assessment baselines: recorded state of each workspace and comparison of two of them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from meterline.functions import timeutil as T
from meterline.functions.frames import latest, per_workspace


def create_baseline(
    maturity: DataFrame,
    estimates: DataFrame,
    flags: DataFrame,
    jobs: DataFrame,
    storage_summary: DataFrame,
    *,
    as_of: int | datetime,
    framework_version: str = "1.0.0",
    primary_use_case: str = "",
    team_size: int = 0,
    notes: str = "",
) -> DataFrame:
    """One baseline row per workspace, with an id that only depends on workspace and time."""
    at = datetime.fromtimestamp(T.as_of_millis(as_of) / 1000, tz=timezone.utc)
    stamp = at.strftime("%Y%m%d_%H%M%S")
    costs = estimates.groupBy("workspace_name").agg(
        F.round(F.sum("estimated_monthly_cost"), 2).alias("monthly"),
        F.max("cloud").alias("cloud"),
        )
    merged = per_workspace(
        maturity.drop("process_timestamp"),
        costs,
        flags.groupBy("workspace_name").agg(F.count(F.lit(1)).alias("clusters")),
        jobs.groupBy("workspace_name").agg(F.count(F.lit(1)).alias("jobs")),
        storage_summary.select("workspace_name", "total_tables", "total_size_tb"),
    )
    monthly = F.coalesce("monthly", F.lit(0.0))
    digest = F.sha2(F.concat_ws("|", F.col("workspace_name"), F.lit(stamp)), 256)
    return merged.select(
        F.concat_ws("_", F.col("workspace_name"), F.lit(stamp), F.substring(digest, 1, 8)).alias(
            "baseline_id"
        ),
        "workspace_name",
        F.lit(at.date()).alias("baseline_date"),
        "cloud",
        F.lit(framework_version).alias("framework_version"),
        "maturity_score",
        "maturity_level",
        "compute_score",
        "storage_score",
        "governance_score",
        "pipelines_score",
        "observability_score",
        "costs_score",
        monthly.alias("estimated_monthly_cost"),
        (monthly * 12).alias("estimated_annual_cost"),
        F.coalesce("clusters", F.lit(0)).cast("int").alias("total_clusters"),
        F.coalesce("jobs", F.lit(0)).cast("int").alias("total_jobs"),
        F.coalesce("total_tables", F.lit(0)).cast("bigint").alias("total_tables"),
        F.coalesce("total_size_tb", F.lit(0.0)).alias("total_storage_tb"),
        F.struct(
            F.lit(1).alias("num_workspaces"),
            F.lit(primary_use_case).alias("primary_use_case"),
            F.lit(team_size).alias("team_size"),
            F.lit(notes).alias("notes"),
        ).alias("context"),
        T.as_of_ts(as_of).alias("process_timestamp"),
    )


def latest_baseline(baselines: DataFrame) -> DataFrame:
    newest = latest(
        baselines, ["workspace_name"], [F.col("baseline_date").desc(), F.col("baseline_id").desc()]
    )
    return newest.select(
        "workspace_name",
        "baseline_id",
        "baseline_date",
        "maturity_score",
        "estimated_monthly_cost",
        "total_clusters",
        "total_jobs",
    )


def _side(baselines: DataFrame, n: int) -> DataFrame:
    return baselines.select(
        "workspace_name",
        F.col("baseline_id").alias(f"baseline_{n}_id"),
        F.col("baseline_date").alias(f"baseline_{n}_date"),
        F.col("maturity_score").alias(f"baseline_{n}_score"),
        F.col("estimated_monthly_cost").alias(f"baseline_{n}_cost"),
    )


def _improvements(pairs: DataFrame) -> DataFrame:
    before, after = F.col("baseline_1_cost"), F.col("baseline_2_cost")
    saved = before - after
    return pairs.withColumns(
        {
            "score_improvement": F.col("baseline_2_score") - F.col("baseline_1_score"),
            "cost_reduction": saved,
            "cost_reduction_percentage": F.when(before > 0, saved / before * 100).otherwise(0.0),
        }
    )


def compare_baselines(baselines: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Score and cost change between two baselines of a workspace.

    ``pairs`` (workspace_name, baseline_1_id, baseline_2_id) names them and is
    joined by equality on both ids, the earlier one first. Without it the oldest
    baseline of each workspace is compared with the newest, from one aggregation.
    """
    if pairs is not None:
        both = (
            pairs.join(_side(baselines, 1), ["workspace_name", "baseline_1_id"])
            .join(_side(baselines, 2), ["workspace_name", "baseline_2_id"])
            .filter(F.col("baseline_1_date") < F.col("baseline_2_date"))
        )
        return _improvements(both)
    when = F.struct("baseline_date", "baseline_id")
    row = F.struct("baseline_id", "baseline_date", "maturity_score", "estimated_monthly_cost")
    ends = baselines.groupBy("workspace_name").agg(
        F.min_by(row, when).alias("b1"), F.max_by(row, when).alias("b2")
    )
    spread = ends.select(
        "workspace_name",
        *[
            F.col(f"b{n}.{src}").alias(f"baseline_{n}_{dst}")
            for n in (1, 2)
            for src, dst in (
                ("baseline_id", "id"),
                ("baseline_date", "date"),
                ("maturity_score", "score"),
                ("estimated_monthly_cost", "cost"),
            )
        ],
    ).filter(F.col("baseline_1_date") < F.col("baseline_2_date"))
    return _improvements(spread)
