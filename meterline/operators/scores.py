"""Maturity scores: one wide row of metrics per workspace, then plain expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import columns as C, timeutil as T
from meterline.functions.frames import per_workspace, top_n
from meterline.operators.cost import with_cost
from meterline.operators.gold import with_flags

# Maturity levels by lower bound.
MATURITY_LEVELS = ((0.8, "Otimizado"), (0.6, "Avançado"), (0.4, "Intermediário"))
LOWEST_LEVEL = "Básico"

DIMENSIONS = ("compute", "storage", "governance", "pipelines", "observability", "costs")


# ---------------------------------------------------------------- metrics


def _cluster_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_clusters"),
        F.avg("utilization_score").alias("avg_utilization"),
        F.count_if("is_idle").alias("idle_clusters"),
        F.count_if("has_autoscaling").alias("autoscaling_clusters"),
    ]


def _job_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_jobs"),
        F.avg("success_rate").alias("avg_success_rate"),
        F.avg("efficiency_score").alias("avg_efficiency"),
        F.count_if("has_schedule").alias("scheduled_jobs"),
    ]


def cluster_metrics(flags: DataFrame) -> DataFrame:
    return flags.groupBy("workspace_name").agg(*_cluster_aggregates())


def job_metrics(gold_jobs: DataFrame) -> DataFrame:
    return gold_jobs.groupBy("workspace_name").agg(*_job_aggregates())


def table_metrics(tables: DataFrame) -> DataFrame:
    return tables.groupBy("workspace_name").agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.count_if("is_partitioned").alias("partitioned_tables"),
        F.count_if("has_small_files").alias("small_file_tables"),
        F.count_if("is_abandoned").alias("abandoned_tables"),
        F.max(F.col("metastore_type").eqNullSafe("unity_catalog")).alias("uses_unity"),
    )


def tag_metrics(silver_clusters: DataFrame, silver_jobs: DataFrame) -> DataFrame:
    """Tagged and total counts of clusters and jobs in one aggregation."""
    c = silver_clusters.select(
        "workspace_name",
        F.lit(1).alias("is_cluster"),
        C.is_present(F.col("custom_tags")).alias("tagged"),
    )
    j = silver_jobs.select(
        "workspace_name", F.lit(0).alias("is_cluster"), C.is_present(F.col("tags")).alias("tagged")
    )
    cluster = F.col("is_cluster") == 1
    return (
        c.unionByName(j)
        .groupBy("workspace_name")
        .agg(
            F.count_if(cluster).alias("taggable_clusters"),
            F.count_if(cluster & F.col("tagged")).alias("tagged_clusters"),
            F.count_if(~cluster).alias("taggable_jobs"),
            F.count_if(~cluster & F.col("tagged")).alias("tagged_jobs"),
        )
    )


def tag_coverage(silver_clusters: DataFrame, silver_jobs: DataFrame) -> DataFrame:
    m = tag_metrics(silver_clusters, silver_jobs)
    return m.withColumns(
        {
            "cluster_tag_coverage": C.ratio(F.col("tagged_clusters"), F.col("taggable_clusters")),
            "job_tag_coverage": C.ratio(F.col("tagged_jobs"), F.col("taggable_jobs")),
        }
    )


def current_cost(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("workspace_name").agg(
        F.sum("estimated_monthly_cost").alias("current_monthly_cost")
    )


def actual_monthly_cost(daily: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Mean of the newest daily rows times 30. Daily rows are one per day and workspace."""
    newest = top_n(daily, cfg.billing_rows, ["workspace_name"], [F.col("date_parsed").desc()])
    return newest.groupBy("workspace_name").agg(
        F.count(F.lit(1)).alias("days_counted"),
        F.avg("daily_cost_usd").alias("avg_daily_cost"),
        (F.avg("daily_cost_usd") * 30).alias("actual_monthly_cost"),
    )


def cost_change_score(change: Column, cfg: EngineConfig = DEFAULT) -> Column:
    scored = C.below(C.settled(change), cfg.cost_change_bands, cfg.cost_change_floor)
    return F.when(change.isNull(), F.lit(cfg.cost_unknown)).otherwise(scored)


def cost_trend_score(daily: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Newest rows' mean against the mean of all earlier rows, one row per workspace.

    The window runs over daily rows, so its group is bounded by calendar days.
    """
    newest_first = Window.partitionBy("workspace_name").orderBy(F.col("date_parsed").desc())
    cut, rn = cfg.trend_recent_rows, F.col("_rn")
    means = (
        daily.withColumn("_rn", F.row_number().over(newest_first))
        .groupBy("workspace_name")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.avg(F.when(rn <= cut, F.col("daily_cost_usd"))).alias("recent_avg"),
            F.avg(F.when(rn > cut, F.col("daily_cost_usd"))).alias("earlier_avg"),
        )
        .withColumn("older_avg", F.coalesce("earlier_avg", "recent_avg"))
    )
    change = C.ratio(F.col("recent_avg") - F.col("older_avg"), F.col("older_avg"))
    return means.select(
        "workspace_name",
        "days",
        "recent_avg",
        "older_avg",
        F.when(F.col("days") < 2, F.lit(cfg.cost_unknown))
        .otherwise(cost_change_score(change, cfg))
        .alias("cost_trend_score"),
    )


# ---------------------------------------------------------------- score expressions


def _share(part: str, total: str) -> Column:
    return C.ratio(F.col(part), F.col(total), 0.0)


def compute_score() -> Column:
    busy = C.zero_if_null(F.col("avg_utilization")) * (
        1 - _share("idle_clusters", "n_clusters") * 0.5
    )
    elastic = _share("autoscaling_clusters", "n_clusters") * 0.3
    jobs = (
        C.zero_if_null(F.col("avg_success_rate")) * 0.4
        + C.zero_if_null(F.col("avg_efficiency")) * 0.3
    )
    score = C.unit_interval(busy * 0.5 + elastic * 0.2 + jobs * 0.3)
    return F.when(F.col("n_clusters") > 0, score).otherwise(0.0)


def storage_score() -> Column:
    score = (
        _share("partitioned_tables", "n_tables") * 0.4
        + (1 - _share("small_file_tables", "n_tables")) * 0.3
        + (1 - _share("abandoned_tables", "n_tables")) * 0.3
    )
    return F.when(F.col("n_tables") > 0, C.unit_interval(score)).otherwise(0.0)


def governance_score() -> Column:
    return F.when(F.col("uses_unity"), 0.5).otherwise(0.0)


def pipelines_score() -> Column:
    score = (
        _share("scheduled_jobs", "n_jobs") * 0.3
        + C.zero_if_null(F.col("avg_success_rate")) * 0.4
        + C.zero_if_null(F.col("avg_efficiency")) * 0.3
    )
    return F.when(F.col("n_jobs") > 0, C.unit_interval(score)).otherwise(0.5)


def observability_score() -> Column:
    score = (
        _share("tagged_clusters", "taggable_clusters") * 0.5
        + _share("tagged_jobs", "taggable_jobs") * 0.5
    )
    return F.when(F.col("taggable_clusters") > 0, C.unit_interval(score)).otherwise(0.0)


def costs_score(cfg: EngineConfig = DEFAULT) -> Column:
    """Current total against the baseline total; no or zero baseline means no change."""
    now = F.col("current_monthly_cost")
    base = F.coalesce(F.nullif(F.col("baseline_monthly_cost"), F.lit(0.0)), now)
    return cost_change_score(C.ratio(now - base, base), cfg)


# ---------------------------------------------------------------- scored frames


def score_compute(flags: DataFrame, gold_jobs: DataFrame) -> DataFrame:
    m = per_workspace(cluster_metrics(flags), job_metrics(gold_jobs))
    return m.select("workspace_name", compute_score().alias("compute_score"))


def score_storage(tables: DataFrame) -> DataFrame:
    return table_metrics(tables).select("workspace_name", storage_score().alias("storage_score"))


def score_governance(tables: DataFrame) -> DataFrame:
    return table_metrics(tables).select(
        "workspace_name", governance_score().alias("governance_score")
    )


def score_pipelines(gold_jobs: DataFrame) -> DataFrame:
    return job_metrics(gold_jobs).select(
        "workspace_name", pipelines_score().alias("pipelines_score")
    )


def score_observability(silver_clusters: DataFrame, silver_jobs: DataFrame) -> DataFrame:
    return tag_metrics(silver_clusters, silver_jobs).select(
        "workspace_name", observability_score().alias("observability_score")
    )


def baseline_cost(baselines: DataFrame) -> DataFrame:
    """Monthly cost of each workspace's newest baseline."""
    return baselines.groupBy("workspace_name").agg(
        F.max_by("estimated_monthly_cost", F.struct("baseline_date", "baseline_id")).alias(
            "baseline_monthly_cost"
        )
    )


def score_costs(
    estimates: DataFrame | None,
    baselines: DataFrame | None = None,
    daily: DataFrame | None = None,
    *,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Cost dimension; falls back to the billing trend when there are no estimates at all."""
    if estimates is None:
        if daily is None:
            raise ValueError("score_costs needs estimates or daily costs")
        return cost_trend_score(daily, cfg=cfg).select(
            "workspace_name", F.col("cost_trend_score").alias("costs_score")
        )
    now = current_cost(estimates)
    if baselines is None:
        m = now.withColumn("baseline_monthly_cost", F.lit(None).cast("double"))
    else:
        m = per_workspace(now, baseline_cost(baselines))
    return m.select("workspace_name", costs_score(cfg).alias("costs_score"))


def inventory_metrics(
    clusters: DataFrame,
    jobs: DataFrame,
    tables: DataFrame,
    *,
    as_of: T.AsOf,
    rate_card: DataFrame | None = None,
    cfg: EngineConfig = DEFAULT,
) -> list[DataFrame]:
    """All score inputs from one aggregation per inventory.

    Flags and costs are per-row expressions, so deriving them again from the
    silver clusters is cheaper than reading and shuffling three cluster tables.
    """
    profile = with_cost(
        with_flags(clusters, cfg=cfg), as_of=as_of, rate_card=rate_card, cfg=cfg
    ).withColumn("tagged", C.is_present(F.col("custom_tags")))
    cluster_frame = profile.groupBy("workspace_name").agg(
        *_cluster_aggregates(),
        F.count(F.lit(1)).alias("taggable_clusters"),
        F.count_if("tagged").alias("tagged_clusters"),
        F.sum("estimated_monthly_cost").alias("current_monthly_cost"),
    )
    job_frame = (
        jobs.withColumn("tagged", C.is_present(F.col("tags")))
        .groupBy("workspace_name")
        .agg(
            *_job_aggregates(),
            F.count(F.lit(1)).alias("taggable_jobs"),
            F.count_if("tagged").alias("tagged_jobs"),
        )
    )
    return [cluster_frame, job_frame, table_metrics(tables)]


def maturity_scores(
    *,
    clusters: DataFrame,
    jobs: DataFrame,
    tables: DataFrame,
    as_of: T.AsOf,
    baselines: DataFrame | None = None,
    daily: DataFrame | None = None,
    rate_card: DataFrame | None = None,
    weights: Mapping[str, float] | None = None,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Six dimension scores, their weighted sum and its level for every workspace.

    ``clusters`` and ``tables`` are silver frames; ``jobs`` is the job summary
    with the jobs' ``tags``. Costs are compared with the newest of ``baselines``;
    when ``daily`` is given the billing trend takes the place of that comparison.
    """
    weights = dict(weights or cfg.weights)
    missing = set(DIMENSIONS) - set(weights)
    if missing:
        raise ValueError(f"weights missing: {sorted(missing)}")
    frames = inventory_metrics(
        clusters, jobs, tables, as_of=as_of, rate_card=rate_card, cfg=cfg
    )
    cost_dim = costs_score(cfg)
    if daily is not None:
        frames.append(score_costs(None, daily=daily, cfg=cfg))
        cost_dim = F.coalesce("costs_score", F.lit(cfg.cost_unknown))
    elif baselines is not None:
        frames.append(baseline_cost(baselines))
    merged = per_workspace(*frames)
    if "baseline_monthly_cost" not in merged.columns:
        merged = merged.withColumn("baseline_monthly_cost", F.lit(None).cast("double"))
    scored = merged.select(
        "workspace_name",
        compute_score().alias("compute_score"),
        storage_score().alias("storage_score"),
        governance_score().alias("governance_score"),
        pipelines_score().alias("pipelines_score"),
        observability_score().alias("observability_score"),
        cost_dim.alias("costs_score"),
    )
    total = sum((F.col(f"{d}_score") * weights[d] for d in DIMENSIONS), F.lit(0.0))
    return scored.withColumn("_total", C.settled(total)).select(
        "workspace_name",
        F.round("_total", 4).alias("maturity_score"),
        C.at_least(F.col("_total"), MATURITY_LEVELS, LOWEST_LEVEL).alias("maturity_level"),
        *[F.round(f"{d}_score", 4).alias(f"{d}_score") for d in DIMENSIONS],
        T.as_of_ts(as_of).alias("process_timestamp"),
    )
