"""Compute cost estimates per cluster and per workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import timeutil as T
from meterline.functions.frames import per_workspace


def _card(cfg: EngineConfig, cloud: str) -> Column:
    pairs = [F.lit(x) for kv in cfg.rates[cloud].items() for x in kv]
    return F.create_map(*pairs)


def _rate_from_config(cfg: EngineConfig) -> Column:
    """Rate of (cloud, cluster_type) from literals: no join, nothing to broadcast."""
    kind = F.col("cluster_type")
    rate = F.when(F.lit(False), F.lit(None).cast("double"))
    for cloud in cfg.rates:
        rate = rate.when(F.col("cloud") == cloud, _card(cfg, cloud)[kind])
    return rate.otherwise(_card(cfg, cfg.fallback_cloud)[kind])


def with_cost(
    silver_clusters: DataFrame,
    *,
    as_of: T.AsOf,
    rate_card: DataFrame | None = None,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Silver clusters with their rate and cost columns added.

    The cost is that of each cluster's uptime and of ``cfg.monthly_hours`` hours of it.
    ``rate_card`` (cloud, cluster_type, dbu_rate) replaces the configured rates;
    it is joined without a hint, so its size decides how Spark joins it.
    """
    typed = silver_clusters.withColumn(
        "cluster_type",
        F.when(F.col("cluster_source") == "UI", "all_purpose")
        .when(F.col("cluster_source") == "JOB", "jobs")
        .otherwise("compute"),
    )
    if rate_card is None:
        rated = typed.withColumn("dbu_rate", _rate_from_config(cfg))
    else:
        own = rate_card.select("cloud", "cluster_type", F.col("dbu_rate").alias("_own"))
        fallback = rate_card.filter(F.col("cloud") == cfg.fallback_cloud).select(
            "cluster_type", F.col("dbu_rate").alias("_fallback")
        )
        rated = (
            typed.join(own, ["cloud", "cluster_type"], "left")
            .join(fallback, "cluster_type", "left")
            .withColumn("dbu_rate", F.coalesce("_own", "_fallback"))
        )
    workers = F.col("num_workers")
    running_hours = T.hours(T.as_of_ms(as_of) - F.col("start_time"))
    billed_hours = F.coalesce(
        F.col("uptime_hours"), F.when(F.col("is_running"), running_hours), F.lit(0.0)
    )
    return (
        rated.withColumn(
            "dbu_per_hour",
            F.when(workers > 0, workers + 1).otherwise(1) * F.col("dbu_rate"),
        )
        .withColumn(
            "estimated_dbu_cost",
            F.coalesce(billed_hours * F.col("dbu_per_hour"), F.lit(0.0)),
        )
        .withColumn(
            "estimated_monthly_cost",
            F.col("estimated_dbu_cost")
            * cfg.monthly_hours
            / F.when(F.col("uptime_hours") > 0, F.col("uptime_hours")).otherwise(1.0),
        )
    )


def dbu_cost(
    silver_clusters: DataFrame,
    *,
    as_of: T.AsOf,
    rate_card: DataFrame | None = None,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Cost estimate rows of all clusters."""
    return with_cost(silver_clusters, as_of=as_of, rate_card=rate_card, cfg=cfg).select(
        "workspace_name",
        "cloud",
        "cluster_id",
        "cluster_name",
        "cluster_type",
        "num_workers",
        "is_running",
        "uptime_hours",
        "dbu_rate",
        "dbu_per_hour",
        "estimated_dbu_cost",
        "estimated_monthly_cost",
        T.as_of_ts(as_of).alias("process_timestamp"),
    )


def workspace_dbu_cost(estimates: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """Totals per workspace; a workspace listed in ``workspaces`` without clusters gets zeros."""
    totals = estimates.groupBy("workspace_name").agg(
        F.round(F.coalesce(F.sum("estimated_dbu_cost"), F.lit(0.0)), 2).alias(
            "total_estimated_dbu_cost"
        ),
        F.round(F.coalesce(F.sum("estimated_monthly_cost"), F.lit(0.0)), 2).alias(
            "total_estimated_monthly_cost"
        ),
        F.count(F.lit(1)).alias("clusters_count"),
        F.count_if("is_running").alias("running_clusters"),
        F.coalesce(F.sum("num_workers"), F.lit(0)).alias("total_workers"),
    )
    if workspaces is None:
        return totals
    names = workspaces.select("workspace_name").distinct()
    return names.join(totals, "workspace_name", "left").fillna(0)


def cost_per_tb(estimates: DataFrame, storage_summary: DataFrame) -> DataFrame:
    """Monthly compute cost per stored TB; null when either side is missing or zero."""
    monthly = estimates.groupBy("workspace_name").agg(
        F.sum("estimated_monthly_cost").alias("monthly_cost")
    )
    merged = per_workspace(monthly, storage_summary.select("workspace_name", "total_size_tb"))
    cost = F.nullif(F.col("monthly_cost"), F.lit(0.0))
    return merged.withColumn("cost_per_tb", F.try_divide(cost, F.col("total_size_tb")))
