"""What changed since a baseline: new resources and the fate of recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import texts, timeutil as T
from meterline.functions.frames import per_workspace
from meterline.operators import gold, rules, silver


# Key columns of each state table; maturity has one row per workspace.
STATE_KEYS = {
    "clusters": ("cluster_id",),
    "tables": ("full_table_name",),
    "jobs": ("job_id",),
    "recommendations": ("rule_id", "resource_id"),
    "maturity": (),
}


def state_at(
    history: Mapping[str, DataFrame], *, as_of: T.AsOf | None = None
) -> dict[str, DataFrame]:
    """Newest row of every resource as known at ``as_of``, or now.

    ``history`` maps names of ``STATE_KEYS`` to frames appended per assessment.
    """
    return {
        name: silver.latest_snapshot(df, list(STATE_KEYS[name]), as_of, "process_timestamp")
        for name, df in history.items()
    }


def version_intervals(bronze: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Snapshots folded into versions: rows of unchanged columns with valid_from and valid_to.

    A collection lists all resources of its workspace, so a version lasts until the
    workspace's next collection that lacks the resource or has it changed; valid_to
    is that collection's time, null while the version is current. Collections that
    repeat a resource as it was add no row. Rows that share key and time are copies.
    """
    stamp, own = "collect_timestamp", ["workspace_name", *keys]
    rest = [c for c in bronze.columns if c not in (*own, stamp)]
    # one row a collection: the windows over a workspace see its collections only
    in_order = Window.partitionBy("workspace_name").orderBy(stamp)
    times = (
        bronze.select("workspace_name", stamp)
        .distinct()
        .withColumns({"_no": F.row_number().over(in_order), "_next": F.lead(stamp).over(in_order)})
    )
    # nulls leave a hash as it is, so they are told apart by their places
    content = F.xxhash64(*rest, *[F.col(c).isNull() for c in rest])
    # by key first: a sort before the shuffle would hold all rows that a task reads, and every
    # later step keeps this one partitioning and order
    copies = bronze.repartition(*own).withColumn("_content", content)
    before = F.lag(stamp).over(Window.partitionBy(*own).orderBy(stamp, "_content"))
    first = copies.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(stamp)))
    seen = first.drop("_before").join(times, ["workspace_name", stamp])
    of_key = Window.partitionBy(*own).orderBy(stamp)
    goes_on = (F.col("_content") == F.lag("_content").over(of_key)) & (F.col("_no") == F.lag("_no").over(of_key) + 1)
    begins = F.when(goes_on, 0).otherwise(1)
    numbered = seen.withColumn("_begins", begins).withColumn("_version", F.sum("_begins").over(of_key))
    folded = numbered.groupBy(*own, "_version").agg(
        F.first(F.struct(*rest)).alias("_row"),
        F.min(stamp).alias("valid_from"),
        F.max_by("_next", "_no").alias("valid_to"),
    )
    return folded.select(*own, "_row.*", "valid_from", "valid_to")


def valid_at(intervals: DataFrame, *, as_of: T.AsOf) -> DataFrame:
    """Versions that held at ``as_of``: the workspace's newest collection then, without sorting snapshots."""
    at = T.as_of_ts(as_of)
    open_ended = F.col("valid_to").isNull() | (F.col("valid_to") > at)
    return intervals.filter((F.col("valid_from") <= at) & open_ended)


def appeared_since(intervals: DataFrame, key: str, *, baseline: T.AsOf) -> DataFrame:
    """``new_since`` from version intervals."""
    first = intervals.groupBy("workspace_name", key).agg(F.min("valid_from").alias("first_seen"))
    return first.filter(F.col("first_seen") > T.as_of_ts(baseline)).select("workspace_name", key)


def first_seen(bronze: DataFrame, key: str) -> DataFrame:
    return bronze.groupBy("workspace_name", key).agg(
        F.min("collect_timestamp").alias("first_seen")
    )


def new_since(bronze: DataFrame, key: str, *, baseline: T.AsOf) -> DataFrame:
    """Resources whose first appearance lies after the baseline.

    Same rows as an anti join of current ids against baseline ids, from one
    aggregation over one scan.
    """
    fresh = first_seen(bronze, key).filter(F.col("first_seen") > T.as_of_ts(baseline))
    return fresh.select("workspace_name", key)


def new_resources(
    clusters: DataFrame, tables: DataFrame, jobs: DataFrame, *, baseline: T.AsOf
) -> DataFrame:
    """Counts of new clusters, tables and jobs for every workspace."""

    def count_new(bronze: DataFrame, key: str, alias: str) -> DataFrame:
        is_new = F.col("first_seen") > T.as_of_ts(baseline)
        return first_seen(bronze, key).groupBy("workspace_name").agg(
            F.count_if(is_new).alias(alias)
        )

    names = ("new_clusters", "new_tables", "new_jobs")
    merged = per_workspace(
        count_new(clusters, "cluster_id", names[0]),
        count_new(tables, "full_table_name", names[1]),
        count_new(jobs, "job_id", names[2]),
    )
    return merged.select(
        "workspace_name", *[F.coalesce(n, F.lit(0)).cast("int").alias(n) for n in names]
    )


def table_version_count(tables: DataFrame) -> DataFrame:
    """Number of collected snapshots per table."""
    return tables.groupBy("workspace_name", "full_table_name").agg(
        F.count(F.lit(1)).alias("version_count")
    )


def run_stats_by_snapshot(
    runs: DataFrame, snapshots: Sequence[int], *, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Run statistics of each job as they stood at each instant in ``snapshots``.

    Runs are counted once, per (job, first snapshot that includes them); running
    sums over those few rows give every snapshot without copying the fact table.
    """
    marks = sorted(snapshots)
    slot = F.when(F.lit(False), F.lit(0))
    for i, ms in enumerate(marks):
        slot = slot.when(F.col("start_time") <= ms, F.lit(i))
    counted = (
        runs.withColumn("slot", slot)
        .filter(F.col("slot").isNotNull())
        .groupBy("workspace_name", "job_id", "slot")
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if("is_success").alias("successful_runs"),
            F.count_if("is_failed").alias("failed_runs"),
        )
    )
    # One row per job holding its slots, then one row per (job, snapshot).
    measures = ("total_runs", "successful_runs", "failed_runs")
    per_job = counted.groupBy("workspace_name", "job_id").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("slot") <= i, F.col(m))), F.lit(0)).alias(f"{m}_{i}")
            for i in range(len(marks))
            for m in measures
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.timestamp_millis(F.lit(ms).cast("bigint")).alias("collect_timestamp"),
                *[F.col(f"{m}_{i}").alias(m) for m in measures],
            )
            for i, ms in enumerate(marks)
        ]
    )
    spread = per_job.select("workspace_name", "job_id", F.inline(rows)).filter("total_runs > 0")
    return gold.with_rates(spread, cfg=cfg)


def run_stats_together(
    runs: DataFrame, slots: Sequence[tuple[int, int | None]], *, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Run statistics of each job in each of ``slots``, from one pass over the bronze runs.

    A slot (known, started) holds the runs as known at the instant ``known`` that had
    started by ``started``; null: all. The rows of slot number i have ``slot`` i; a job
    without runs in it has none. Runs are counted per job and set of slots that they
    belong to; the slots add up those few rows. Whoever wants one slot filters the
    result, all columns of which are computed for every reader, so that Spark sees the
    same plan each time and runs it once. Least, longest and total durations are left out.
    """
    belongs = [
        silver.newest_at(known) & (F.lit(True) if started is None else F.col("start_time") <= started)
        for known, started in slots
    ]
    sets = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(belongs)), F.lit(0))
    until = max(known for known, _ in slots)
    copies = silver.copies_by(runs, until).withColumn("_slots", sets).filter("_slots > 0")
    spent = F.col("duration_hours")
    counted = (
        silver.silver_job_runs(copies, as_of=until, cfg=cfg)
        .groupBy("workspace_name", "job_id", "_slots")
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.count_if("is_success").alias("successful_runs"),
            F.count_if("is_failed").alias("failed_runs"),
            F.count(spent).alias("timed_runs"),
            F.sum(spent).alias("hours"),
        )
    )
    measures = ("total_runs", "successful_runs", "failed_runs", "timed_runs", "hours")

    def within(i: int, measure: str) -> Column:
        return F.sum(F.when(F.col("_slots").bitwiseAND(1 << i) > 0, F.col(measure)))

    per_job = counted.groupBy("workspace_name", "job_id").agg(
        *[within(i, m).alias(f"{m}_{i}") for i in range(len(slots)) for m in measures]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("slot"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
            for i in range(len(slots))
        ]
    )
    spread = per_job.select("workspace_name", "job_id", F.inline(rows)).filter("total_runs > 0")
    average = F.when(F.col("timed_runs") > 0, F.col("hours") / F.col("timed_runs"))
    return gold.with_rates(spread.withColumn("avg_duration_hours", average), cfg=cfg).drop("timed_runs", "hours")


def condition_history(
    clusters: DataFrame,
    tables: DataFrame,
    jobs: DataFrame,
    runs: DataFrame | None,
    snapshots: Sequence[int],
    *,
    stats: DataFrame | None = None,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Rule conditions that held at each of the instants ``snapshots``.

    At each instant a workspace's newest collection is judged, as the stored daily
    run would have done; a resource that it lacks fulfils no rule. A deployment that
    appends ``rules.conditions`` daily reads that table instead. ``stats`` are the
    statistics of the runs by snapshot, if they are counted already; ``runs`` is not read then.
    """
    stamp = F.col("collect_timestamp")

    def kept(df: DataFrame) -> DataFrame:
        return silver.at_instants(df, snapshots)

    flags = gold.cluster_flags(silver.silver_clusters(kept(clusters), as_of=stamp, cfg=cfg), cfg=cfg)
    stored = silver.silver_tables(kept(tables), as_of=stamp, cfg=cfg)
    if stats is None:
        stats = run_stats_by_snapshot(runs, snapshots, cfg=cfg)
    judged_jobs = kept(jobs).join(
        stats, ["workspace_name", "job_id", "collect_timestamp"], "left"
    ).withColumn("process_timestamp", stamp)
    return rules.conditions(flags, stored, judged_jobs, cfg=cfg)


def recommendation_status(
    recommendations: DataFrame,
    conditions: DataFrame,
    snapshots: Sequence[int],
    *,
    baseline: int,
    as_of: int,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """What became of each baseline recommendation.

    ``conditions`` holds (workspace, rule, resource, snapshot) rows that were
    true, with their measure, the baseline's included; ``snapshots`` are the audited
    instants. Gone now: implemented. Present now but absent in a snapshot after the
    baseline: regression. Present throughout with a measure lower than the baseline's
    by ``cfg.partial_drop`` of it or more: partly implemented. Otherwise, or if either
    measure is unknown or the baseline's not above zero, still open.
    """
    after = sorted(ms for ms in snapshots if baseline < ms <= as_of)
    if not after or after[-1] != as_of:
        raise ValueError("as_of must be one of the snapshots after the baseline")
    at = [F.timestamp_millis(F.lit(ms).cast("bigint")) for ms in after]
    stamp, start = F.col("snapshot_timestamp"), F.timestamp_millis(F.lit(baseline).cast("bigint"))
    keys = ["workspace_name", "rule_id", "resource_id"]
    seen = (
        conditions.filter(stamp.isin(start, *at))
        .groupBy(*keys)
        .agg(
            F.count_distinct(F.when(stamp != start, stamp)).alias("times_true"),
            F.max(stamp == at[-1]).alias("true_now"),
            F.max(F.when(stamp == start, F.col("measure"))).alias("measured_then"),
            F.max(F.when(stamp == at[-1], F.col("measure"))).alias("measured_now"),
        )
    )
    open_now = F.coalesce("true_now", F.lit(False))
    left = F.when(F.col("measured_then") > 0, F.round(F.col("measured_now") / F.col("measured_then"), 12))
    status = (
        F.when(~open_now, texts.IMPLEMENTED)
        .when(F.col("times_true") < len(after), texts.REGRESSION)
        .when(left <= 1 - cfg.partial_drop, texts.PARTIAL)
        .otherwise(texts.NOT_IMPLEMENTED)
    )
    return recommendations.join(seen, keys, "left").select(
        *keys,
        F.col("title").alias("recommendation_title"),
        "category",
        "priority",
        status.alias("status"),
        T.as_of_ts(baseline).cast("date").cast("string").alias("baseline_date"),
        T.as_of_ts(as_of).alias("validation_timestamp"),
    )
