"""Improvement rules: ranked recommendations and the conditions behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import texts, timeutil as T
from meterline.functions.frames import top_n


def matches(df: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
    """One output row per (condition, struct) pair that holds, from a single pass."""
    hits = F.array_compact(F.array(*[F.when(cond, row) for cond, row in pairs]))
    return df.select(F.inline(hits))


def _found(rule: str, resource: Column, score: Column, **shown: Column) -> Column:
    """A recommendation row; ``shown`` overrides the rule's texts with filled ones."""
    text = {k: F.lit(v) for k, v in texts.RECOMMENDATIONS[rule].items()} | shown
    return F.struct(
        F.col("workspace_name"),
        F.lit(rule).alias("rule_id"),
        resource.cast("string").alias("resource_id"),
        score.cast("double").alias("score"),
        *[
            text[k].alias(k)
            for k in (
                "category",
                "priority",
                "title",
                "description",
                "impact",
                "complexity",
                "action",
                "estimated_savings",
            )
        ],
    )


def _say(rule: str, field: str, *args: Column) -> Column:
    return F.format_string(texts.RECOMMENDATIONS[rule][field], *args)


def is_idle() -> Column:
    return F.col("is_idle")


def is_small_files(cfg: EngineConfig) -> Column:
    return F.col("has_small_files") & (F.col("size_gb") > cfg.small_files_high_gb)


def is_failing(cfg: EngineConfig) -> Column:
    return F.col("failure_rate") > cfg.failure_rate_high


def untouched_days() -> Column:
    return F.coalesce("days_since_accessed", "days_since_modified")


def recommendations(
    flags: DataFrame,
    tables: DataFrame,
    jobs: DataFrame,
    *,
    as_of: T.AsOf,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """The strongest findings of each rule in each workspace.

    Each inventory is read once. All findings share one ranking step, which
    trims every map partition before the shuffle.
    """
    c, t, j = F.col("cluster_name"), F.col("table_name"), F.col("job_name")
    full = F.col("full_table_name")
    clusters = matches(
        flags,
        (
            is_idle(),
            _found(
                "idle_cluster",
                F.col("cluster_id"),
                F.col("idle_hours"),
                title=_say("idle_cluster", "title", c),
                description=_say(
                    "idle_cluster", "description", F.col("cluster_id"), F.col("idle_hours")
                ),
            ),
        ),
    )
    stored = matches(
        tables,
        (
            F.col("is_abandoned"),
            _found(
                "abandoned_table",
                full,
                F.col("size_gb"),
                title=_say("abandoned_table", "title", t),
                description=_say("abandoned_table", "description", full, untouched_days()),
                estimated_savings=_say("abandoned_table", "estimated_savings", F.col("size_gb")),
            ),
        ),
        (
            is_small_files(cfg),
            _found(
                "small_files",
                full,
                F.col("size_gb"),
                title=_say("small_files", "title", t),
                description=_say(
                    "small_files",
                    "description",
                    full,
                    F.col("num_files"),
                    F.col("avg_file_size_mb"),
                ),
            ),
        ),
    )
    failing = matches(
        jobs,
        (
            is_failing(cfg),
            _found(
                "failing_job",
                F.col("job_id"),
                F.col("failure_rate"),
                title=_say("failing_job", "title", j),
                description=_say(
                    "failing_job",
                    "description",
                    F.col("job_id").cast("string"),
                    F.col("failure_rate") * 100,
                ),
            ),
        ),
    )
    ranked = top_n(
        clusters.unionByName(stored).unionByName(failing),
        cfg.top_recommendations,
        ["workspace_name", "rule_id"],
        [F.col("score").desc_nulls_last(), F.col("resource_id")],
    )
    return ranked.withColumn("process_timestamp", T.as_of_ts(as_of))


def conditions(
    flags: DataFrame, tables: DataFrame, jobs: DataFrame, *, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """(workspace, rule, resource, snapshot) rows for which a rule holds, and how badly.

    Appended at every run, this small table is the history that tells a
    regression from a finding that was never fixed. ``measure`` is what the rule's
    action lowers: idle worker hours (a driver counts as one), workers, size, files
    or failure rate.
    """
    idle_work = F.col("idle_hours") * F.greatest(F.coalesce("num_workers", F.lit(0)), F.lit(1))

    def row(rule: str, resource: str, measure: Column | str) -> Column:
        return F.struct(
            F.col("workspace_name"),
            F.lit(rule).alias("rule_id"),
            F.col(resource).cast("string").alias("resource_id"),
            F.col("process_timestamp").alias("snapshot_timestamp"),
            (F.col(measure) if isinstance(measure, str) else measure).cast("double").alias("measure"),
        )

    return (
        matches(
            flags,
            (is_idle(), row("idle_cluster", "cluster_id", idle_work)),
            (~F.col("has_autoscaling"), row("missing_autoscaling", "cluster_id", "num_workers")),
        )
        .unionByName(
            matches(
                tables,
                (F.col("is_abandoned"), row("abandoned_table", "full_table_name", "size_gb")),
                (is_small_files(cfg), row("small_files", "full_table_name", "num_files")),
            )
        )
        .unionByName(matches(jobs, (is_failing(cfg), row("failing_job", "job_id", "failure_rate"))))
    )
