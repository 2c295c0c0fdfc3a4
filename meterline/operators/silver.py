"""Bronze to silver: newest row per resource, then per-row derivations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.functions import columns as C, timeutil as T
from meterline.functions.frames import latest

GIB = 1024.0**3
TIB = 1024.0**4
MIB = 1024.0**2


def seen_by(df: DataFrame, as_of: T.AsOf, stamp: str = "collect_timestamp") -> DataFrame:
    """Rows collected on or before ``as_of``."""
    return df.filter(F.col(stamp) <= T.as_of_ts(as_of))


def latest_snapshot(
    df: DataFrame, keys: list[str], as_of: T.AsOf | None = None, stamp: str = "collect_timestamp"
) -> DataFrame:
    """Resources of each workspace's newest collection, optionally as known at ``as_of``.

    A collection lists all resources of a workspace under one timestamp, so what the
    newest one lacks has been removed. Rows that share key and timestamp are copies.
    """
    rows = df if as_of is None else seen_by(df, as_of, stamp)
    newest = rows.groupBy(F.col("workspace_name").alias("_workspace")).agg(
        F.max(stamp).alias("_newest")
    )
    same = F.col("workspace_name").eqNullSafe(F.col("_workspace"))
    current = rows.join(newest, same & F.col(stamp).eqNullSafe(F.col("_newest")), "left_semi")
    return latest(current, [*keys, "workspace_name"], [F.col(stamp).desc()])


def at_instants(df: DataFrame, instants: Sequence[int]) -> DataFrame:
    """The newest collection of each workspace at or before each instant, stamped with it.

    Workspaces may be collected at different minutes; a collection can stand for
    several instants.
    """
    stamp = F.col("collect_timestamp")
    at = [F.timestamp_millis(F.lit(ms).cast("bigint")) for ms in instants]
    known = df.groupBy(F.col("workspace_name").alias("_workspace")).agg(
        *[F.max(F.when(stamp <= t, stamp)).alias(f"_{i}") for i, t in enumerate(at)]
    )
    pairs = F.array(
        *[F.struct(t.alias("_instant"), F.col(f"_{i}").alias("_newest")) for i, t in enumerate(at)]
    )
    chosen = known.select("_workspace", F.inline(pairs)).filter("_newest is not null")
    same = F.col("workspace_name").eqNullSafe(F.col("_workspace")) & (stamp == F.col("_newest"))
    rows = df.join(chosen, same).withColumn("collect_timestamp", F.col("_instant"))
    return rows.drop("_workspace", "_instant", "_newest")


def _newest_run_first() -> list[Column]:
    """Order of the copies of a run; ties are settled by every remaining figure.

    Figures that few readers want, texts among them, take part as a hash, so that a
    shuffle need not carry them; nulls leave a hash as it is and are told apart by place.
    """
    rest = ("setup_duration", "cleanup_duration", "cluster_instance", "error")
    return [
        F.col("collect_timestamp").desc_nulls_last(),
        F.col("start_time").desc_nulls_last(),
        F.col("job_id"),
        F.col("execution_duration"),
        F.col("result_state"),
        F.xxhash64(*rest, *[F.col(c).isNull() for c in rest]),
    ]


def _copies_of_a_run() -> WindowSpec:
    # The numeric id leads the keys: its sort prefix settles nearly every comparison.
    return Window.partitionBy("run_id", "workspace_name").orderBy(*_newest_run_first())


def latest_runs(df: DataFrame) -> DataFrame:
    """One row per run although runs are collected again every day; the newest wins.

    The choice does not depend on file order. Copies of a run lie in the files of
    different days, so sorting each task's rows before the shuffle as well, as a row
    number would, trims hardly any.
    """
    newer = df.withColumn("_newer", F.lag(F.lit(True)).over(_copies_of_a_run()))
    return newer.filter(F.col("_newer").isNull()).drop("_newer")


def copies_by(df: DataFrame, until: T.AsOf) -> DataFrame:
    """Copies of runs collected by ``until``, with ``_newer``: when the next newer copy was collected."""
    newer = F.lag("collect_timestamp").over(_copies_of_a_run())
    return seen_by(df, until).withColumn("_newer", newer)


def newest_at(at: T.AsOf) -> Column:
    """Of ``copies_by``: the newest copy known at ``at``; the next newer one, if any, was collected later."""
    then = T.as_of_ts(at)
    return (F.col("collect_timestamp") <= then) & (F.col("_newer").isNull() | (F.col("_newer") > then))


def runs_known_at(df: DataFrame, at: T.AsOf, *, until: T.AsOf | None = None) -> DataFrame:
    """``latest_runs`` of the copies collected by ``at``.

    Frames for several instants that name the same ``until``, the last of them, share
    one shuffle: nothing below it depends on ``at``.
    """
    return copies_by(df, at if until is None else until).filter(newest_at(at)).drop("_newer")


def recent_runs(runs: DataFrame, days: int, *, as_of: T.AsOf) -> DataFrame:
    """Newest copy of each run started in the last ``days`` days.

    The start of a run is in its first copy and never changes, so older rows go
    before the shuffle that finds the newest copies.
    """
    floor_ms = T.as_of_ms(as_of) - F.lit(days * T.MS_PER_DAY).cast("bigint")
    return latest_runs(runs.filter(F.col("start_time") >= floor_ms))


def silver_clusters(
    clusters: DataFrame, *, as_of: T.AsOf, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    started, ended = T.known_epoch("start_time"), T.known_epoch("terminated_time")
    active = T.known_epoch("last_activity_time")
    known = clusters.withColumns(
        {"start_time": started, "terminated_time": ended, "last_activity_time": active}
    )
    return known.withColumns(
        {
            "is_running": F.col("state").eqNullSafe("RUNNING"),
            "is_terminated": F.col("state").eqNullSafe("TERMINATED"),
            "has_autoscaling": C.is_present(F.col("autoscale")),
            "is_serverless": ~F.col("cluster_source").eqNullSafe("UI"),
            "uptime_hours": T.hours(F.col("terminated_time") - F.col("start_time")),
            "idle_hours": F.when(
                F.col("start_time").isNotNull(),
                T.hours(T.as_of_ms(as_of) - F.col("last_activity_time")),
            ),
            "memory_gb": F.col("cluster_memory_mb") / 1024,
            "estimated_cost_per_hour": F.lit(0.0),
            "process_timestamp": T.as_of_ts(as_of),
        }
    )


def silver_jobs(jobs: DataFrame, *, as_of: T.AsOf, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return jobs.withColumns(
        {
            "uses_existing_cluster": C.truthy(F.col("existing_cluster_id") != ""),
            "has_schedule": C.is_present(F.col("schedule")),
            "process_timestamp": T.as_of_ts(as_of),
        }
    )


def silver_job_runs(runs: DataFrame, *, as_of: T.AsOf, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per-run durations and outcome flags. ``start_month`` lets time filters skip folders."""
    spent, outcome = F.col("execution_duration"), F.col("result_state")
    started = F.timestamp_millis(T.known_epoch("start_time"))
    return runs.withColumns(
        {
            "duration_seconds": spent / T.MS_PER_SECOND,
            "duration_hours": T.hours(spent),
            "is_success": outcome.eqNullSafe("SUCCESS"),
            "is_failed": outcome.eqNullSafe("FAILED"),
            "is_cancelled": outcome.eqNullSafe("CANCELLED"),
            "has_error": C.is_present(F.col("error")),
            "start_month": F.trunc(started.cast("date"), "month"),
            "process_timestamp": T.as_of_ts(as_of),
        }
    )


def silver_tables(tables: DataFrame, *, as_of: T.AsOf, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Sizes, ages and storage flags. ``last_access`` is the last commit the source reports."""
    now, size = T.as_of_ts(as_of), F.col("size_in_bytes")
    sized = tables.withColumns(
        {
            "size_gb": size / GIB,
            "size_tb": size / TIB,
            "avg_file_size_mb": F.when(
                F.col("num_files") > 0, size / F.col("num_files") / MIB
            ).otherwise(0.0),
            "days_since_modified": F.datediff(now, F.col("last_modified")),
            "days_since_accessed": F.datediff(now, F.col("last_access")),
            "is_partitioned": C.listed_names(F.col("partition_columns")) >= 1,
            "is_delta": F.col("table_type").eqNullSafe("delta"),
        }
    )
    untouched = F.coalesce("days_since_accessed", "days_since_modified")
    return sized.withColumns(
        {
            "has_small_files": C.truthy(F.col("avg_file_size_mb") < cfg.small_file_mb),
            "is_cold_data": C.truthy(untouched > cfg.cold_days),
            "is_abandoned": C.truthy(untouched > cfg.abandoned_days),
            "process_timestamp": now,
        }
    )


def newest_collection(costs: DataFrame) -> DataFrame:
    """Billing lines of the newest collection of each workspace, cloud and day.

    Days are collected again for a month and appended; several true lines may share
    every key, so a whole day's collection replaces the one before: lines that were
    corrected or withdrawn go with it. A day is known to be collected by its lines.
    """
    day = ["workspace_name", "cloud", "date"]
    newest = costs.groupBy(*day).agg(F.max("collect_timestamp").alias("_newest")).select(
        *[F.col(c).alias(f"_{c}") for c in day], "_newest"
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in day]
    stamp = F.col("collect_timestamp").eqNullSafe(F.col("_newest"))
    on = same[0] & same[1] & same[2] & stamp
    return costs.join(newest, on, "left_semi")


def rates_on(days: DataFrame, fx: DataFrame) -> DataFrame:
    """currency, _day, _rate: the newest rate on or before each of ``days`` (currency, _day).

    Rates and distinct days are put in one order and the last rate is carried on.
    Both are bounded by the calendar for each currency, however many lines a day has,
    so no currency's lines are sorted in one task. Of several rates of a day the
    highest counts; days before the first rate have none.
    """
    rates = fx.groupBy("currency", F.col("valid_from").cast("date").alias("_day")).agg(
        F.max(F.col("rate").cast("double")).alias("rate")
    )
    both = rates.withColumn("asked", F.lit(0)).unionByName(
        days.withColumns({"rate": F.lit(None).cast("double"), "asked": F.lit(1)})
    )
    before = Window.partitionBy("currency").orderBy("_day", "asked")
    carried = both.withColumn("_rate", F.last("rate", ignorenulls=True).over(before))
    return carried.filter("asked = 1").select("currency", "_day", "_rate")


def silver_billing(
    costs: DataFrame,
    *,
    as_of: T.AsOf,
    fx: DataFrame | None = None,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Parsed dates and cost in USD.

    ``fx`` (currency, rate) converts foreign amounts. With a column ``valid_from`` the
    newest rate on or before the billing day applies. Without ``fx``, or where it has no
    rate, ``cfg.default_fx_rate`` applies.
    """
    rate = F.lit(cfg.default_fx_rate)
    priced = costs
    if fx is not None and "valid_from" in fx.columns:
        day = F.col("date").try_cast("date")
        priced = costs.withColumn("_day", day)
        foreign = priced.filter("currency <> 'USD' and _day is not null").select("currency", "_day")
        priced = priced.join(rates_on(foreign.distinct(), fx), ["currency", "_day"], "left").drop("_day")
        rate = F.coalesce(F.col("_rate"), rate)
    elif fx is not None:
        known = fx.select("currency", F.col("rate").cast("double").alias("_rate"))
        priced = costs.join(known, "currency", "left")
        rate = F.coalesce(F.col("_rate"), rate)
    parsed = priced.withColumns(
        {
            "cost_usd": F.when(F.col("currency") == "USD", F.col("cost")).otherwise(
                F.col("cost") * rate
            ),
            "date_parsed": F.col("date").try_cast("date"),
        }
    )
    return parsed.withColumns(
        {
            "year": F.year("date_parsed"),
            "month": F.month("date_parsed"),
            "day": F.dayofmonth("date_parsed"),
            "process_timestamp": T.as_of_ts(as_of),
        }
    ).drop("_rate")


def runs_since(runs: DataFrame, days: int, *, as_of: T.AsOf) -> DataFrame:
    """Runs started in the last ``days`` days; the month filter prunes partitions."""
    floor_ms = T.as_of_ms(as_of) - F.lit(days * T.MS_PER_DAY).cast("bigint")
    kept = runs.filter(F.col("start_time") >= floor_ms)
    if "start_month" in runs.columns:
        first_month = F.trunc(F.timestamp_millis(floor_ms).cast("date"), "month")
        kept = kept.filter(F.col("start_month") >= first_month)
    return kept
