"""Audits of storage, compute and workflows: one row per issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import texts, timeutil as T
from meterline.functions.frames import top_n
from meterline.operators.rules import is_failing, matches, untouched_days
from meterline.operators.silver import runs_since

# Figures an issue carries so that reports can price it without looking it up again.
FACTS = {
    "idle_hours": "double",
    "num_workers": "int",
    "size_gb": "double",
    "failed_runs": "bigint",
    "avg_duration_hours": "double",
}


KINDS = {
    "storage": ("missing_optimize", "abandoned_table"),
    "clusters": ("idle_cluster", "missing_autoscaling"),
    "jobs": ("high_failure_job",),
    "schedules": ("job_without_schedule",),
    "runs": ("long_running_job",),
}
ALL_KINDS = tuple(kind for kinds in KINDS.values() for kind in kinds)


def _found(df: DataFrame, kinds: tuple[str, ...], pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Issues of the wanted kinds; rules that are not wanted are not in the plan."""
    return matches(df, *[pair for kind, pair in pairs.items() if kind in kinds])


def _all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _issue(
    kind: str,
    *,
    resource_id: Column,
    severity: Column | str,
    resource_name: Column | None = None,
    table_name: Column | None = None,
    say: tuple[Column, ...] = (),
    impact: tuple[Column, ...] = (),
    facts: tuple[str, ...] = (),
) -> Column:
    category, description, action, effect = texts.ISSUES[kind]
    none = F.lit(None).cast("string")
    return F.struct(
        F.col("workspace_name"),
        F.lit(kind).alias("issue_type"),
        F.lit(category).alias("category"),
        resource_id.cast("string").alias("resource_id"),
        (none if resource_name is None else resource_name).alias("resource_name"),
        (none if table_name is None else table_name).alias("table_name"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (F.format_string(description, *say) if say else F.lit(description)).alias("description"),
        F.lit(action).alias("recommended_action"),
        (F.format_string(effect, *impact) if impact else F.lit(effect)).alias("estimated_impact"),
        *[
            (F.col(f) if f in facts else F.lit(None)).cast(kind_).alias(f)
            for f, kind_ in FACTS.items()
        ],
    )


def _stamped(issues: DataFrame, as_of: T.AsOf) -> DataFrame:
    return issues.withColumn("validation_timestamp", T.as_of_ts(as_of))


def audit_storage(
    tables: DataFrame,
    *,
    as_of: T.AsOf,
    cfg: EngineConfig = DEFAULT,
    kinds: tuple[str, ...] = KINDS["storage"],
) -> DataFrame:
    size, full = F.col("size_gb"), F.col("full_table_name")
    unoptimised = F.col("is_delta") & F.col("has_small_files") & (size > cfg.optimize_min_gb)
    pairs = {
        "missing_optimize": (
            unoptimised,
            _issue(
                "missing_optimize",
                resource_id=full,
                table_name=full,
                severity=F.when(size > cfg.small_files_high_gb, "high").otherwise("medium"),
                say=(F.col("num_files"), F.col("avg_file_size_mb")),
                impact=(F.col("num_files") * 0.3,),
                facts=("size_gb",),
            ),
        ),
        "abandoned_table": (
            F.col("is_abandoned"),
            _issue(
                "abandoned_table",
                resource_id=full,
                table_name=full,
                severity="high",
                say=(untouched_days(), size),
                impact=(size,),
                facts=("size_gb",),
            ),
        ),
    }
    return _stamped(_found(tables, kinds, pairs), as_of)


def audit_compute(
    flags: DataFrame,
    jobs: DataFrame,
    *,
    as_of: T.AsOf,
    cfg: EngineConfig = DEFAULT,
    kinds: tuple[str, ...] = KINDS["clusters"] + KINDS["jobs"],
) -> DataFrame:
    idle, workers = F.col("idle_hours"), F.col("num_workers")
    named = dict(resource_id=F.col("cluster_id"), resource_name=F.col("cluster_name"))
    on_clusters = {
        "idle_cluster": (
            F.col("is_idle") & (idle > cfg.idle_hours),
            _issue(
                "idle_cluster",
                **named,
                severity="high",
                say=(idle,),
                impact=(idle * workers * cfg.worker_hour_usd,),
                facts=("idle_hours", "num_workers"),
            ),
        ),
        "missing_autoscaling": (
            ~F.col("has_autoscaling") & (workers > cfg.autoscaling_min_workers),
            _issue(
                "missing_autoscaling",
                **named,
                severity="medium",
                say=(workers,),
                facts=("idle_hours", "num_workers"),
            ),
        ),
    }
    on_jobs = {
        "high_failure_job": (
            is_failing(cfg),
            _issue(
                "high_failure_job",
                resource_id=F.col("job_id"),
                resource_name=F.col("job_name"),
                severity="high",
                say=(F.col("failure_rate") * 100, F.col("total_runs")),
                impact=(F.col("failed_runs") * 0.5,),
                facts=("failed_runs", "avg_duration_hours"),
            ),
        ),
    }
    parts = [
        _found(df, kinds, pairs)
        for df, pairs in ((flags, on_clusters), (jobs, on_jobs))
        if any(kind in kinds for kind in pairs)
    ]
    return _stamped(_all_of(parts), as_of)


def audit_workflows(
    jobs: DataFrame,
    runs: DataFrame,
    *,
    as_of: T.AsOf,
    cfg: EngineConfig = DEFAULT,
    kinds: tuple[str, ...] = KINDS["schedules"] + KINDS["runs"],
) -> DataFrame:
    parts = []
    if "job_without_schedule" in kinds:
        row = _issue(
            "job_without_schedule",
            resource_id=F.col("job_id"),
            resource_name=F.col("job_name"),
            severity="medium",
        )
        parts.append(matches(jobs, (~F.col("has_schedule"), row)))
    if "long_running_job" in kinds:
        spent = F.col("duration_hours")
        long_runs = top_n(
            runs_since(runs, cfg.long_runs_days, as_of=as_of)
            .filter(spent > cfg.long_run_hours)
            .select("workspace_name", "run_id", "run_name", "duration_hours"),
            cfg.long_runs_listed,
            ["workspace_name"],
            [spent.desc(), F.col("run_id")],
        )
        row = _issue(
            "long_running_job",
            resource_id=F.col("run_id"),
            resource_name=F.col("run_name"),
            severity="medium",
            say=(spent,),
            facts=("avg_duration_hours",),
        )
        parts.append(matches(long_runs.withColumn("avg_duration_hours", spent), (F.lit(True), row)))
    return _stamped(_all_of(parts), as_of)


def audit_all(
    *,
    flags: DataFrame,
    tables: DataFrame,
    jobs: DataFrame,
    runs: DataFrame,
    as_of: T.AsOf,
    plain_jobs: DataFrame | None = None,
    cfg: EngineConfig = DEFAULT,
    kinds: tuple[str, ...] = ALL_KINDS,
) -> DataFrame:
    """Every issue of the wanted kinds in one frame; inputs no wanted rule reads stay unread.

    ``plain_jobs``, jobs without run statistics, spares the schedule check a
    join when ``jobs`` is not a stored table.
    """
    if unknown := set(kinds) - set(ALL_KINDS) or not kinds:
        raise ValueError(f"unknown kinds: {unknown}" if kinds else "no kinds")
    scheduled = jobs if plain_jobs is None else plain_jobs
    audits = (
        (KINDS["storage"], lambda k: audit_storage(tables, as_of=as_of, cfg=cfg, kinds=k)),
        (KINDS["clusters"] + KINDS["jobs"], lambda k: audit_compute(flags, jobs, as_of=as_of, cfg=cfg, kinds=k)),
        (KINDS["schedules"] + KINDS["runs"], lambda k: audit_workflows(scheduled, runs, as_of=as_of, cfg=cfg, kinds=k)),
    )
    wanted = [(tuple(k for k in of if k in kinds), audit) for of, audit in audits]
    return _all_of([audit(k) for k, audit in wanted if k])
