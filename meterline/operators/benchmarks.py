"""Benchmark levels, billing reconciliation and confidence in the savings."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import columns as C, timeutil as T
from meterline.functions.frames import per_workspace
from meterline.operators.cost import cost_per_tb
from meterline.operators.scores import actual_monthly_cost, cluster_metrics, job_metrics

LEVELS = ("excellent", "good", "average")
WORST = "poor"
NO_DATA = "no_data"
# Points of each level in the overall mean.
POINTS = {"excellent": 4, "good": 3, "average": 2, "poor": 1}

# Texts shown with a reconciliation or a confidence.
TEXT_INTEGRATE = "Integrar billing real para maior precisão"
TEXT_INTEGRATED = "Billing real integrado"
TEXT_REVIEW = "Revisar estimativas ou integrar billing real"
TEXT_ROI_OK = "ROI confiável"
TEXT_ROI_REVIEW = "Revisar estimativas antes de apresentar ROI"


def level_of(value: Column, cutoffs: tuple[float, float, float], lower_is_better: bool) -> Column:
    value = C.settled(value)
    out = F.when(value.isNull(), NO_DATA)
    for cutoff, level in zip(cutoffs, LEVELS):
        out = out.when(value <= cutoff if lower_is_better else value >= cutoff, level)
    return out.otherwise(WORST)


def _points(level: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, n in POINTS.items():
        out = out.when(level == name, F.lit(n))
    return out


def benchmarks(
    flags: DataFrame,
    gold_jobs: DataFrame,
    storage_summary: DataFrame,
    estimates: DataFrame,
    *,
    as_of: int | datetime,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Four metrics, their levels and the overall level.

    A metric without data is null, has level ``no_data`` and does not count in
    the mean.
    """
    merged = per_workspace(
        cost_per_tb(estimates, storage_summary).select("workspace_name", "cost_per_tb"),
        cluster_metrics(flags).select("workspace_name", "avg_utilization"),
        job_metrics(gold_jobs).select("workspace_name", "avg_success_rate"),
        storage_summary.select(
            "workspace_name",
            F.try_divide(F.col("cold_size_tb"), F.col("total_size_tb")).alias("cold_share"),
        ),
    )
    cpt, use = F.col("cost_per_tb"), F.col("avg_utilization")
    success, cold = F.col("avg_success_rate"), F.col("cold_share")
    levelled = merged.withColumns(
        {
            "cost_per_tb_level": level_of(cpt, cfg.bench_cost_per_tb, True),
            "utilization_level": level_of(use, cfg.bench_utilization, False),
            "success_rate_level": level_of(success, cfg.bench_success, False),
            "cold_data_level": level_of(cold, cfg.bench_cold_share, True),
        }
    )
    marks = [
        _points(F.col(c))
        for c in ("cost_per_tb_level", "utilization_level", "success_rate_level", "cold_data_level")
    ]
    total = sum((F.coalesce(m, F.lit(0)) for m in marks), F.lit(0))
    counted = sum((m.isNotNull().cast("int") for m in marks), F.lit(0))
    at = datetime.fromtimestamp(T.as_of_millis(as_of) / 1000, tz=timezone.utc)
    return levelled.withColumn("_score", F.try_divide(total, counted)).select(
        "workspace_name",
        F.lit(at.replace(tzinfo=None).isoformat()).alias("benchmark_date"),
        F.round(cpt, 2).alias("cost_per_tb"),
        "cost_per_tb_level",
        F.round(use, 2).alias("cluster_utilization"),
        "utilization_level",
        F.round(success, 2).alias("job_success_rate"),
        "success_rate_level",
        F.round(cold * 100, 2).alias("cold_data_percentage"),
        "cold_data_level",
        F.round("_score", 2).alias("overall_score"),
        level_of(F.col("_score"), cfg.bench_overall, False).alias("overall_level"),
        T.as_of_ts(as_of).alias("process_timestamp"),
    )


def reconcile_billing(
    estimates: DataFrame,
    daily: DataFrame | None = None,
    *,
    as_of: int | datetime,
    actuals: DataFrame | None = None,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Estimated monthly cost against the actual one of every workspace.

    ``actuals`` (workspace_name, actual_cost[, actual_cost_date]) wins over the
    billing rows in ``daily``.
    """
    frames = [
        estimates.groupBy("workspace_name").agg(
            F.coalesce(F.sum("estimated_monthly_cost"), F.lit(0.0)).alias("estimated")
        )
    ]
    billed = given = F.lit(None).cast("double")
    at = datetime.fromtimestamp(T.as_of_millis(as_of) / 1000, tz=timezone.utc)
    dated: Column = F.lit(at.replace(tzinfo=None).isoformat())
    if daily is not None:
        frames.append(
            actual_monthly_cost(daily, cfg=cfg).select(
                "workspace_name", F.col("actual_monthly_cost").alias("billed")
            )
        )
        billed = F.col("billed")
    if actuals is not None:
        told = actuals.select("workspace_name", F.col("actual_cost").alias("given"))
        given = F.col("given")
        if "actual_cost_date" in actuals.columns:
            told = actuals.select(
                "workspace_name",
                F.col("actual_cost").alias("given"),
                F.col("actual_cost_date").cast("string").alias("given_date"),
            )
            dated = F.coalesce("given_date", dated)
        frames.append(told)
    merged = per_workspace(*frames) if len(frames) > 1 else frames[0]

    est = F.col("estimated")
    actual = F.nullif(F.coalesce(given, billed), F.lit(0.0))
    m = merged.withColumns({"_dated": dated, "_actual": actual}).withColumn(
        "_pct", F.when(F.col("_actual") > 0, F.abs(est - F.col("_actual")) / F.col("_actual") * 100).otherwise(
            F.when(F.col("_actual").isNotNull(), 0.0)
        )
    )
    known, pct = est.isNotNull(), C.settled(F.col("_pct"))
    both = known & F.col("_actual").isNotNull()
    status = (
        F.when(~known, NO_DATA)
        .when(~both, "estimated_only")
        .when(pct < cfg.variance_reconciled_pct, "reconciled")
        .when(pct < cfg.variance_close_pct, "close")
        .otherwise("needs_review")
    )
    confidence = (
        F.when(status == "reconciled", "high")
        .when(status.isin("estimated_only", "close"), "medium")
        .otherwise("low")
    )
    return m.select(
        "workspace_name",
        F.when(both, F.col("_dated")).alias("reconciliation_date"),
        F.round(est, 2).alias("estimated_monthly_cost"),
        F.when(both, F.round("_actual", 2)).alias("actual_cost"),
        F.when(both, F.round(F.abs(est - F.col("_actual")), 2)).alias("variance"),
        F.when(both, F.round(pct, 2)).alias("variance_percentage"),
        status.alias("reconciliation_status"),
        confidence.alias("confidence"),
        F.when(status == "estimated_only", TEXT_INTEGRATE)
        .when(status == "reconciled", TEXT_INTEGRATED)
        .when(both, TEXT_REVIEW)
        .alias("recommendation"),
        T.as_of_ts(as_of).alias("process_timestamp"),
    )


def roi_confidence(
    reconciliation: DataFrame, savings: DataFrame, *, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Confidence in estimated savings (workspace_name, estimated_savings)."""
    rows = savings.select("workspace_name", "estimated_savings").join(
        reconciliation.select(
            "workspace_name", "reconciliation_status", "confidence", "variance_percentage"
        ),
        "workspace_name",
        "left",
    )
    base = (
        F.when(F.col("confidence") == "high", cfg.confidence_high)
        .when(F.col("confidence") == "medium", cfg.confidence_medium)
        .otherwise(cfg.confidence_low)
    )
    spread = F.col("variance_percentage")
    floor = F.lit(cfg.confidence_floor)
    penalised = F.greatest(
        base - F.least(spread / 100, F.lit(cfg.variance_penalty_cap)), floor
    )
    settled = F.when(F.coalesce(spread, F.lit(0.0)) != 0, penalised).otherwise(base)
    saved = F.col("estimated_savings")
    final = (
        F.when(saved > cfg.savings_bonus_above, F.least(settled + cfg.savings_step, F.lit(1.0)))
        .when(saved < cfg.savings_malus_below, F.greatest(settled - cfg.savings_step, floor))
        .otherwise(settled)
    )
    c = F.col("_c")
    return rows.withColumn("_c", C.settled(final)).select(
        "workspace_name",
        "estimated_savings",
        F.round(c, 2).alias("roi_confidence"),
        F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low").alias("confidence_level"),
        F.coalesce("reconciliation_status", F.lit(NO_DATA)).alias("reconciliation_status"),
        "variance_percentage",
        F.when(c >= 0.8, TEXT_ROI_OK).otherwise(TEXT_ROI_REVIEW).alias("recommendation"),
    )
