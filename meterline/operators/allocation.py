"""Cost allocation by tag, pipeline, product and service tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import columns as C, timeutil as T
from meterline.operators.silver import runs_since




def tag_allocation(
    silver_clusters: DataFrame, silver_jobs: DataFrame, estimates: DataFrame, *, as_of: T.AsOf
) -> DataFrame:
    """Clusters with their estimated cost and jobs at no cost, spread over the tag dimensions."""
    costs = estimates.select(
        "workspace_name", "cluster_id", "estimated_monthly_cost", "estimated_dbu_cost"
    )
    clusters = silver_clusters.join(costs, ["workspace_name", "cluster_id"], "left").select(
        "workspace_name",
        F.lit("cluster").alias("resource_type"),
        F.col("cluster_id").alias("resource_id"),
        F.col("cluster_name").alias("resource_name"),
        C.zero_if_null(F.col("estimated_monthly_cost")).alias("estimated_monthly_cost"),
        C.zero_if_null(F.col("estimated_dbu_cost")).alias("estimated_dbu_cost"),
        C.tags_struct(F.col("custom_tags")).alias("tags"),
    )
    jobs = silver_jobs.select(
        "workspace_name",
        F.lit("job").alias("resource_type"),
        F.col("job_id").cast("string").alias("resource_id"),
        F.col("job_name").alias("resource_name"),
        F.lit(0.0).alias("estimated_monthly_cost"),
        F.lit(0.0).alias("estimated_dbu_cost"),
        C.tags_struct(F.col("tags")).alias("tags"),
    )
    both = clusters.unionByName(jobs)
    return both.withColumns(
        {
            "cost_center": C.shown_tag(F.col("tags.cost_center")),
            "business_unit": C.shown_tag(F.col("tags.business_unit")),
            "data_domain": C.shown_tag(F.col("tags.data_domain")),
            "allocation_method": F.when(F.col("tags.cost_center") != "", "tags").otherwise(
                "default"
            ),
            "process_timestamp": T.as_of_ts(as_of),
        }
    )


def _totals_by(df: DataFrame, dims: list[str], *aggs) -> DataFrame:
    """One pass over ``df`` for several single-dimension totals per workspace."""
    grouped = df.groupingSets(
        [["workspace_name", d] for d in dims], "workspace_name", *dims
    ).agg(*aggs, *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dimension = F.when(F.lit(False), F.lit(""))
    value = F.when(F.lit(False), F.lit(""))
    for d in dims:
        dimension = dimension.when(F.col(f"_g_{d}") == 0, F.lit(d))
        value = value.when(F.col(f"_g_{d}") == 0, F.col(d))
    return (
        grouped.withColumns({"dimension": dimension, "dimension_value": value})
        .drop(*dims, *[f"_g_{d}" for d in dims])
    )


def cost_by_domain(allocation: DataFrame) -> DataFrame:
    return _totals_by(
        allocation,
        ["cost_center", "business_unit", "data_domain"],
        F.sum("estimated_monthly_cost").alias("total_monthly_cost"),
        F.sum("estimated_dbu_cost").alias("total_dbu_cost"),
    )


def run_cost_per_job(
    runs: DataFrame, estimates: DataFrame, *, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Cost of each job's runs, charged from the cluster each run used.

    Runs collapse to one row per (job, cluster) before they meet the cluster
    costs, so a cluster that served a third of all runs brings no hot join key.
    """
    used = F.from_json(F.col("cluster_instance"), "cluster_id string")["cluster_id"]
    pairs = (
        runs.withColumn("cluster_id", used)
        .groupBy("workspace_name", "job_id", "cluster_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("duration_hours").alias("hours"),
            F.count("duration_hours").alias("n_hours"),
        )
    )
    costs = estimates.select("workspace_name", "cluster_id", "estimated_dbu_cost")
    charge = F.col("estimated_dbu_cost") * F.col("n")
    if cfg.charge_mode == "prorated":
        busy = pairs.groupBy("workspace_name", "cluster_id").agg(F.sum("hours").alias("busy"))
        costs = costs.join(busy, ["workspace_name", "cluster_id"])
        charge = F.col("estimated_dbu_cost") * F.try_divide(F.col("hours"), F.col("busy"))
    charged = pairs.join(costs, ["workspace_name", "cluster_id"], "left").withColumn(
        "charge", charge
    )
    priced_runs = F.sum(F.when(F.col("charge").isNotNull(), F.col("n")))
    return charged.groupBy("workspace_name", "job_id").agg(
        F.sum("charge").alias("total_dbu_cost"),
        F.try_divide(F.sum("charge"), priced_runs).alias("avg_dbu_cost_per_run"),
        F.sum("n").alias("total_runs"),
        F.try_divide(F.sum("hours"), F.sum("n_hours")).alias("avg_duration_hours"),
    )


def pipeline_name(job_name: Column) -> Column:
    return F.substring_index(job_name, "_", 1)


def product_name(job_name: Column) -> Column:
    return F.when(job_name.contains("-"), F.substring_index(job_name, "-", 1)).otherwise("default")


def sla_tier(avg_hours: Column, cfg: EngineConfig = DEFAULT) -> Column:
    hours = C.settled(avg_hours)
    return (
        F.when(hours < cfg.sla_fast_hours, "fast")
        .when(hours > cfg.sla_slow_hours, "slow")
        .otherwise("standard")
    )


def pipeline_costs(
    jobs: DataFrame,
    runs: DataFrame,
    estimates: DataFrame,
    *,
    as_of: T.AsOf,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Look-back cost, run count and service tier of every job.

    ``jobs`` needs workspace_name, job_id and job_name only.
    """
    recent = runs_since(runs, cfg.lookback_days, as_of=as_of)
    per_job = run_cost_per_job(recent, estimates, cfg=cfg)
    name = F.col("job_name")
    hours = C.zero_if_null(F.col("avg_duration_hours"))
    cost = C.zero_if_null(F.col("total_dbu_cost"))
    return (
        jobs.select("workspace_name", "job_id", "job_name")
        .join(per_job, ["workspace_name", "job_id"], "left")
        .select(
            "workspace_name",
            F.lit("pipeline").alias("resource_type"),
            F.col("job_id").cast("string").alias("resource_id"),
            name.alias("resource_name"),
            pipeline_name(name).alias("pipeline_name"),
            product_name(name).alias("product_name"),
            sla_tier(hours, cfg).alias("sla_tier"),
            (cost * cfg.month_factor).alias("estimated_monthly_cost"),
            cost.alias("estimated_dbu_cost"),
            C.zero_if_null(F.col("avg_dbu_cost_per_run")).alias("cost_per_run"),
            F.coalesce("total_runs", F.lit(0).cast("bigint")).alias("total_runs_monthly"),
            hours.alias("avg_duration_hours"),
            F.lit("job_runs").alias("allocation_method"),
            T.as_of_ts(as_of).alias("process_timestamp"),
        )
    )


def cost_by_product(pipelines: DataFrame) -> DataFrame:
    return _totals_by(
        pipelines,
        ["product_name", "pipeline_name", "sla_tier"],
        F.sum("estimated_monthly_cost").alias("total_monthly_cost"),
        F.count("resource_id").alias("resource_count"),
    )
