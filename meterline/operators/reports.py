"""Reports built from the audit issues: checklist, backlog, quick wins, executive report."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import texts, timeutil as T
from meterline.functions.frames import per_workspace, top_n
from meterline.operators import savings as S
from meterline.operators.scores import DIMENSIONS


# Kinds of issues that a report can show; asking an audit for these alone keeps its plan short.
STORAGE_KINDS = ("missing_optimize", "abandoned_table")
QUICK_WIN_KINDS = ("idle_cluster", "abandoned_table")
BACKLOG_KINDS = ("missing_optimize", "abandoned_table", "idle_cluster", "high_failure_job")


def technical_checklist(issues: DataFrame) -> DataFrame:
    return issues.select(
        "workspace_name",
        "category",
        "issue_type",
        F.coalesce("resource_name", "table_name", "resource_id").alias("resource_name"),
        "severity",
        "description",
        "recommended_action",
        "estimated_impact",
        F.lit("pending").alias("status"),
        "validation_timestamp",
    )


def backlog_items(issues: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """High storage and compute issues, each with its saving and effort."""
    kind = F.col("issue_type")
    saved = (
        F.when(kind == "abandoned_table", S.archive_saving(cfg))
        .when(kind == "missing_optimize", S.optimize_saving(cfg))
        .when(kind == "idle_cluster", S.idle_month(cfg))
        .when(kind == "high_failure_job", S.fix_failures_saving(cfg))
        .otherwise(0.0)
    )
    light_storage = F.lower("recommended_action").contains("optimize")
    storage = F.col("category") == "storage"
    high = issues.filter(
        (F.col("severity") == "high") & F.col("category").isin("storage", "compute")
    )
    return high.select(
        "workspace_name",
        F.lit(1).alias("priority"),
        "category",
        "issue_type",
        "resource_id",
        F.col("description").alias("issue"),
        F.col("recommended_action").alias("action"),
        saved.alias("estimated_savings_usd_month"),
        (saved * S.MONTHS).alias("estimated_savings_usd_year"),
        F.when(storage & ~light_storage, "medium").otherwise("low").alias("complexity"),
        F.when(~storage, 1.0).when(light_storage, 2.0).otherwise(8.0).alias("effort_hours"),
    )


def prioritized_backlog(issues: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Backlog in working order; ids close every tie, so the range sort stays even."""
    return backlog_items(issues, cfg=cfg).orderBy(
        "workspace_name",
        "priority",
        F.col("estimated_savings_usd_month").desc(),
        "issue_type",
        "resource_id",
    )


def quick_wins(issues: DataFrame, *, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Best cheap savings of each workspace."""
    cluster, table = (
        F.col("issue_type") == "idle_cluster",
        F.col("issue_type") == "abandoned_table",
    )
    saved = F.when(cluster, S.idle_month(cfg)).when(table, S.storage_month(cfg))
    floor = F.when(cluster, cfg.quick_win_cluster_usd).otherwise(cfg.quick_win_table_usd)
    priced = issues.filter((F.col("severity") == "high") & (cluster | table)).select(
        "workspace_name",
        F.lit("quick_win").alias("alert_type"),
        "category",
        "resource_id",
        F.when(
            cluster,
            F.format_string(texts.QUICK_WIN_CLUSTER, F.coalesce("resource_name", F.lit(""))),
        )
        .otherwise(F.format_string(texts.QUICK_WIN_TABLE, F.coalesce("table_name", F.lit(""))))
        .alias("title"),
        "description",
        F.col("recommended_action").alias("action"),
        saved.alias("estimated_savings_usd_month"),
        (saved * S.MONTHS).alias("estimated_savings_usd_year"),
        F.when(cluster, 1.0).otherwise(4.0).alias("effort_hours"),
        F.when(cluster, "low").otherwise("medium").alias("complexity"),
        F.lit("high").alias("urgency"),
        floor.alias("_floor"),
    )
    worth = priced.filter(F.col("estimated_savings_usd_month") > F.col("_floor")).drop("_floor")
    return top_n(
        worth,
        cfg.quick_wins_listed,
        ["workspace_name"],
        [F.col("estimated_savings_usd_month").desc(), F.col("category"), F.col("resource_id")],
    )


def _packed(order: list[str], row: Column) -> Column:
    """Aggregate: the group's rows as one array sorted by ``order``."""
    keyed = F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)], row.alias("row"))
    return F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["row"])


ISSUE_FIELDS = (
    "workspace_name",
    "issue_type",
    "table_name",
    "resource_id",
    "resource_name",
    "severity",
    "description",
    "recommended_action",
    "estimated_impact",
    "validation_timestamp",
)
STATUS_FIELDS = (
    "workspace_name",
    "recommendation_title",
    "category",
    "priority",
    "status",
    "baseline_date",
    "validation_timestamp",
)
def executive_report(
    *,
    maturity: DataFrame,
    issues: DataFrame,
    statuses: DataFrame,
    new_resources: DataFrame,
    daily: DataFrame,
    baseline: int | datetime,
    as_of: int | datetime,
    workspaces: DataFrame | None = None,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """One nested row per workspace: those of all parts and those named in ``workspaces``.

    Every part is reduced to one row per workspace first: counts and savings come
    from one pass over the issues, outcome counts and list from one over the
    statuses. The arrays hold at most ``critical_issues_listed`` issues and the
    baseline's top recommendations, so no array grows with the workspace.
    """
    worst = top_n(
        issues.filter(F.col("severity") == "high").select(*ISSUE_FIELDS),
        cfg.critical_issues_listed,
        ["workspace_name"],
        [F.col("issue_type"), F.col("resource_id")],
    )
    critical = worst.groupBy("workspace_name").agg(
        _packed(["issue_type", "resource_id"], F.struct(*ISSUE_FIELDS)).alias("critical_issues")
    )
    status = F.col("status")
    outcome = statuses.groupBy("workspace_name").agg(
        F.count_if(status == texts.IMPLEMENTED).cast("int").alias("n_implemented"),
        F.count_if(status.isin(texts.NOT_IMPLEMENTED, texts.PARTIAL)).cast("int").alias("n_open"),
        F.count_if(status == texts.REGRESSION).cast("int").alias("n_regressed"),
        _packed(["rule_id", "resource_id"], F.struct(*STATUS_FIELDS)).alias(
            "recommendations_status"
        ),
    )
    merged = per_workspace(
        *([] if workspaces is None else [workspaces]),
        maturity.drop("process_timestamp"),
        S.issue_totals(issues, cfg=cfg),
        critical,
        outcome,
        new_resources,
        S.monthly_actual(daily, cfg=cfg),
    ).withColumn("roi_analysis", F.struct("workspace_name", *S.roi_columns(as_of)))

    def n(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    def stamp(at: int | datetime) -> str:
        ms = T.as_of_millis(at)
        return datetime.fromtimestamp(ms / 1000, tz=timezone.utc).replace(tzinfo=None).isoformat()

    roi_part = F.col("roi_analysis")
    return merged.select(
        "workspace_name",
        F.lit(stamp(as_of)).alias("report_date"),
        F.lit(stamp(baseline)).alias("baseline_date"),
        F.struct(
            F.col("maturity_score").alias("current_maturity_score"),
            F.col("maturity_level").alias("current_maturity_level"),
            n("total_issues").alias("total_issues"),
            n("high_issues").alias("high_priority_issues"),
            n("medium_issues").alias("medium_priority_issues"),
            n("n_implemented").alias("recommendations_implemented"),
            n("n_open").alias("recommendations_not_implemented"),
            n("n_regressed").alias("regressions_detected"),
            roi_part["estimated_monthly_savings"].alias("estimated_monthly_savings"),
            roi_part["estimated_annual_savings"].alias("estimated_annual_savings"),
            roi_part["reduction_percentage"].alias("reduction_percentage"),
        ).alias("executive_summary"),
        F.struct(
            *[n(c).cast("int").alias(c) for c in ("new_clusters", "new_tables", "new_jobs")]
        ).alias("new_resources"),
        F.coalesce("recommendations_status", F.array()).alias("recommendations_status"),
        F.coalesce("critical_issues", F.array()).alias("critical_issues"),
        "roi_analysis",
        F.struct(*[f"{d}_score" for d in DIMENSIONS]).alias("maturity_breakdown"),
    )
