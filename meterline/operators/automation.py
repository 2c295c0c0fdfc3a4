"""Suggested automation for idle clusters. Commands are text; nothing is executed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import texts, timeutil as T


def automation_actions(
    flags: DataFrame, *, as_of: T.AsOf, level: str = "alert", cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """One stop action per idle cluster; only level ``auto`` may mark it executable."""
    idle, cid, name = F.col("idle_hours"), F.col("cluster_id"), F.col("cluster_name")
    runnable = F.lit(level == "auto") & (idle > cfg.auto_execute_idle_hours)
    return flags.filter(F.col("is_idle") & (idle > cfg.idle_hours)).select(
        "workspace_name",
        F.lit("cluster").alias("resource_type"),
        cid.alias("resource_id"),
        name.alias("resource_name"),
        F.lit("terminate_idle").alias("action_type"),
        F.lit(level).alias("automation_level"),
        F.format_string(texts.IDLE_CONDITION, idle).alias("condition"),
        (idle * cfg.worker_hour_usd).alias("estimated_savings"),
        F.lit("low").alias("risk_level"),
        F.lit(level == "alert").alias("requires_approval"),
        runnable.alias("can_execute"),
        F.format_string(texts.STOP_COMMAND, cid).alias("action_command"),
        F.format_string(texts.START_COMMAND, cid).alias("rollback_command"),
        F.when(~runnable, F.format_string(texts.IDLE_ALERT, name, idle)).alias("alert_message"),
        F.lit(False).alias("executed"),
        F.lit(None).cast("timestamp").alias("executed_at"),
        T.as_of_ts(as_of).alias("generated_at"),
    )


def automation_alerts(
    flags: DataFrame, *, as_of: T.AsOf, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    return automation_actions(flags, as_of=as_of, level="alert", cfg=cfg).select(
        "workspace_name",
        F.lit("automation_opportunity").alias("alert_type"),
        F.lit("medium").alias("severity"),
        F.format_string(texts.ALERT_TITLE, F.col("action_type")).alias("title"),
        F.coalesce("alert_message", F.lit("")).alias("description"),
        "resource_id",
        "resource_name",
        F.lit(True).alias("action_available"),
        "action_command",
        "estimated_savings",
        "risk_level",
        "requires_approval",
        "generated_at",
    )
