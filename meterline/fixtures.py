"""Bronze inputs derived from the supplied star-schema tables.

Columns are deterministic projections of whole tables; three inventory snapshots
(60, 30 and 0 days before the fixed ``AS_OF``) give each resource a history.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.operators import (
    allocation,
    audit,
    baselines,
    benchmarks,
    cost,
    gold,
    history,
    reports,
    rules,
    savings,
    scores,
    silver,
)

DAY = 86_400_000
AS_OF = 996_624_000_000  # 2001-08-01T00:00:00Z
SNAPSHOTS = (AS_OF - 60 * DAY, AS_OF - 30 * DAY, AS_OF)
BASELINE = SNAPSHOTS[0]
RUN_SHIFT = 95  # days: the last run starts on the day of AS_OF

_CLOUD = "case ({k} % 25) % 3 when 0 then 'azure' when 1 then 'aws' else 'gcp' end as cloud"
_WS = "concat('ws_', cast({k} % 25 as string)) as workspace_name"
_URL = (
    "case ({k} % 25) % 3 when 0 then concat('https://adb-', {k} % 25, '.azuredatabricks.net') "
    "when 1 then concat('https://ws', {k} % 25, '.cloud.databricks.com') "
    "else concat('https://ws', {k} % 25, '.gcp.databricks.com') end as workspace_url"
)


class Bronze:
    """Bronze frames of one test data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def _with_snapshots(df: DataFrame) -> DataFrame:
        """Every row once per snapshot."""
        snaps = ", ".join(f"struct({i} as s, {ms}L as snap_ms)" for i, ms in enumerate(SNAPSHOTS))
        return df.selectExpr("*", f"inline(array({snaps}))")

    @cached_property
    def clusters(self) -> DataFrame:
        k = "c_custkey"
        return (
            self._with_snapshots(self.table("customer").select("c_custkey", "c_mktsegment"))
            .filter("(s = 2 or c_custkey % 17 <> 0) and (s < 2 or c_custkey % 29 <> 7)")
            .selectExpr(
                _WS.format(k=k),
                _URL.format(k=k),
                _CLOUD.format(k=k),
                "concat('c-', cast(c_custkey as string)) as cluster_id",
                "concat('cluster_', cast(c_custkey as string)) as cluster_name",
                "case when c_custkey % 4 = 0 then 'RUNNING' else 'TERMINATED' end as state",
                "cast(c_custkey % 21 as int) as num_workers",
                "case c_mktsegment when 'BUILDING' then 'UI' when 'MACHINERY' then 'JOB' "
                "else 'API' end as cluster_source",
                f"snap_ms - {DAY} * (30 + c_custkey % 10) as start_time",
                f"case when c_custkey % 4 = 0 then 0L else snap_ms - {DAY} * (c_custkey % 10) end "
                "as terminated_time",
                "case when c_custkey % 13 = 0 then 0L "
                "else snap_ms - 60000 * ((c_custkey * 7 + s * 311) % 960) end as last_activity_time",
                "cast(8192 * (c_custkey % 16 + 1) as double) as cluster_memory_mb",
                "case c_custkey % 3 when 0 then '{}' "
                """when 1 then '{"cost_center": "cc1", "BusinessUnit": "bu2"}' """
                """else '{"CostCenter": "cc2", "data_domain": "dd1", "owner": "o1"}' end """
                "as custom_tags",
                "case when (c_custkey + s) % 5 = 0 then '{}' when (c_custkey + s) % 5 = 1 then null "
                """else '{"min_workers": 1, "max_workers": 8}' end as autoscale""",
                "timestamp_millis(snap_ms) as collect_timestamp",
            )
        )

    @cached_property
    def jobs(self) -> DataFrame:
        k = "p_partkey"
        return (
            self._with_snapshots(self.table("part").select(k, "p_type", "p_name", "p_size"))
            .filter("(s = 2 or p_partkey % 19 <> 0) and (s < 2 or p_partkey % 31 <> 5)")
            .selectExpr(
                _WS.format(k=k),
                _URL.format(k=k),
                _CLOUD.format(k=k),
                "p_partkey as job_id",
                "concat(lower(p_type), '-', replace(p_name, ' ', '_')) as job_name",
                "cast(null as string) as job_type",
                "case p_size % 4 when 0 then '{}' when 1 then null "
                """else '{"cron": "0 0 0 * * ?"}' end as schedule""",
                "case when p_size % 5 = 0 then concat('c-', cast(p_partkey % 25 as string)) "
                "else '' end as existing_cluster_id",
                "case p_partkey % 4 when 0 then null when 1 then '{}' "
                """else '{"cost_center": "cc1", "owner": "o2"}' end as tags""",
                "timestamp_millis(snap_ms) as collect_timestamp",
            )
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Every line item is a run; each ninth was first collected while it was running."""
        k = "l_partkey"
        failed = "(l_orderkey * 31 + l_linenumber * 17) % 100 < l_partkey % 45"
        columns = (
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate",
        )
        # Days since the epoch need no session time zone.
        started = f"(cast(datediff(l_shipdate, date'1970-01-01') as bigint) - {RUN_SHIFT}) * {DAY}"
        caught = "(l_orderkey + l_linenumber) % 9 = 0"
        return (
            self.table("lineitem")
            .select(*columns)
            .selectExpr("*", f"explode(if({caught}, array(true, false), array(false))) as flying")
            .selectExpr(
                _WS.format(k=k),
                _CLOUD.format(k=k),
                "l_partkey as job_id",
                "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as run_id",
                "cast(null as string) as run_name",
                f"case when flying then 'RUNNING' when {failed} then 'FAILED' "
                "when (l_orderkey + l_linenumber) % 50 = 0 then 'CANCELLED' else 'SUCCESS' end "
                "as result_state",
                f"{started} as start_time",
                "l_suppkey * 1000 as setup_duration",
                "if(flying, 0L, cast(l_quantity as bigint) * (l_partkey % 12 + 1) * 60000) as execution_duration",
                "if(flying, 0L, cast(l_linenumber * 1500 as bigint)) as cleanup_duration",
                """concat('{"cluster_id": "c-', """
                """cast(l_partkey % 25 + 25 * (l_orderkey % 8) as string), '"}') """
                "as cluster_instance",
                f"""case when {failed} and not flying then concat('{{"code": "E', """
                """cast(l_suppkey % 12 as string), '"}') else '{}' end as error""",
                f"timestamp_millis({started} + if({caught} and not flying, {DAY}, 0)) as collect_timestamp",
            )
        )

    @cached_property
    def tables(self) -> DataFrame:
        k = "p_partkey"
        return (
            self._with_snapshots(self.table("part").select(k, "p_brand", "p_size"))
            .filter("(s = 2 or p_partkey % 23 <> 0) and (s < 2 or p_partkey % 37 <> 3)")
            .selectExpr(
                _WS.format(k=k),
                _URL.format(k=k),
                _CLOUD.format(k=k),
                "case when (p_partkey % 25) % 2 = 0 then 'unity_catalog' else 'hive' end "
                "as metastore_type",
                "cast(null as string) as catalog",
                "p_brand as schema",
                "concat('t_', cast(p_partkey as string)) as table_name",
                "concat(p_brand, '.t_', cast(p_partkey as string)) as full_table_name",
                "case when p_partkey % 7 = 0 then 'parquet' else 'delta' end as table_type",
                "cast((p_partkey * 13) % 5000 as int) as num_files",
                "cast(p_partkey % 997 + 1 as bigint) * p_size * 4000000 as size_in_bytes",
                "case p_partkey % 4 when 0 then '[]' when 1 then '[\\'dt\\']' "
                "else '[\\'dt\\', \\'region\\']' end as partition_columns",
                f"timestamp_millis(snap_ms - {DAY} * ((p_partkey * 7 + s * 37) % 400)) "
                "as last_modified",
                "case when p_partkey % 3 = 0 then null else "
                f"timestamp_millis(snap_ms - {DAY} * ((p_partkey * 5 + s * 151) % 400)) end "
                "as last_access",
                "timestamp_millis(snap_ms) as collect_timestamp",
            )
        )

    @cached_property
    def billing(self) -> DataFrame:
        """Every order is a billing line, collected on its day and again 20 days later.

        The first collection lacks some lines and has preliminary costs; the second
        corrects them and withdraws others.
        """
        k = "o_custkey"
        columns = (
            "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority",
        )
        seen = "if(again, o_orderkey % 13 <> 4, o_orderkey % 7 <> 3)"
        return (
            self.table("orders")
            .select(*columns)
            .selectExpr("*", "explode(array(false, true)) as again")
            .filter(seen)
            .selectExpr(
                _WS.format(k=k),
                _CLOUD.format(k=k),
                "cast(cast(o_orderdate as date) as string) as date",
                "concat('c-', cast(o_custkey as string)) as resource_id",
                "cast(null as string) as resource_type",
                "o_orderpriority as service",
                "o_totalprice / if(again or o_orderkey % 11 <> 5, 1000, 2000) as cost",
                "case when o_orderkey % 10 = 0 then 'EUR' else 'USD' end as currency",
                "timestamp_millis((cast(datediff(o_orderdate, date'1970-01-01') as bigint) "
                f"+ if(again, 20, 0)) * {DAY}) as collect_timestamp",
            )
        )

    @cached_property
    def rates(self) -> DataFrame:
        """Dated currency rates: one for every order day that begins a third of a month."""
        days = self.table("orders").select(F.col("o_orderdate").cast("date").alias("valid_from")).distinct()
        return days.filter(F.dayofmonth("valid_from").isin(1, 11, 21)).select(
            F.lit("EUR").alias("currency"), "valid_from", (1 + F.dayofyear("valid_from") % 40 / 100).alias("rate")
        )


class Estate:
    """All layers over one bronze source as they stood at ``as_of``; everything stays lazy."""

    def __init__(
        self,
        bronze: Bronze,
        as_of: int = AS_OF,
        cfg: EngineConfig = DEFAULT,
        before: "Estate | None" = None,
        until: int | None = None,
        figures: DataFrame | None = None,
    ) -> None:
        self.bronze, self.as_of, self.cfg = bronze, as_of, cfg
        self.before = before  # earlier assessment whose baseline the cost score compares with
        self.until = as_of if until is None else until  # last of the assessments that share a shuffle of the runs
        self.figures = figures  # run statistics of this assessment, if counted together with another's

    @cached_property
    def judged(self) -> list[int]:
        """The earlier assessment's instant and the snapshots since."""
        return [self.before.as_of, *(ms for ms in SNAPSHOTS if self.before.as_of < ms <= self.as_of)]

    @cached_property
    def figures_together(self) -> DataFrame:
        """Run statistics of both assessments, and now's as they stood at each judged instant."""
        slots = [(self.before.as_of, None), (self.as_of, None), *((self.as_of, ms) for ms in self.judged)]
        return history.run_stats_together(self.bronze.runs, slots, cfg=self.cfg)

    @cached_property
    def together(self) -> "Estate":
        """Both assessments with run statistics from one pass; for results that need more than one of them."""
        then, now = (self.figures_together.filter(F.col("slot") == i).drop("slot") for i in (0, 1))
        before = Estate(self.bronze, self.before.as_of, self.before.cfg, self.before.before, figures=then)
        return Estate(self.bronze, self.as_of, self.cfg, before, figures=now)

    # silver
    @cached_property
    def clusters(self) -> DataFrame:
        newest = silver.latest_snapshot(self.bronze.clusters, ["cluster_id"], self.as_of)
        return silver.silver_clusters(newest, as_of=self.as_of, cfg=self.cfg)

    @cached_property
    def jobs(self) -> DataFrame:
        newest = silver.latest_snapshot(self.bronze.jobs, ["job_id"], self.as_of)
        return silver.silver_jobs(newest, as_of=self.as_of, cfg=self.cfg)

    @cached_property
    def runs(self) -> DataFrame:
        newest = silver.runs_known_at(self.bronze.runs, self.as_of, until=self.until)
        return silver.silver_job_runs(newest, as_of=self.as_of, cfg=self.cfg)

    def recent(self, days: int) -> DataFrame:
        known = silver.seen_by(self.bronze.runs, self.as_of)
        newest = silver.recent_runs(known, days, as_of=self.as_of)
        return silver.silver_job_runs(newest, as_of=self.as_of, cfg=self.cfg)

    @cached_property
    def tables(self) -> DataFrame:
        newest = silver.latest_snapshot(self.bronze.tables, ["full_table_name"], self.as_of)
        return silver.silver_tables(newest, as_of=self.as_of, cfg=self.cfg)

    @cached_property
    def billing(self) -> DataFrame:
        known = silver.seen_by(self.bronze.billing, self.as_of)
        newest = silver.newest_collection(known)
        return silver.silver_billing(newest, as_of=self.as_of, cfg=self.cfg)

    @cached_property
    def billing_at_rates(self) -> DataFrame:
        known = silver.seen_by(self.bronze.billing, self.as_of)
        newest = silver.newest_collection(known)
        return silver.silver_billing(newest, as_of=self.as_of, fx=self.bronze.rates, cfg=self.cfg)

    @cached_property
    def job_versions(self) -> DataFrame:
        return history.version_intervals(self.bronze.jobs, ["job_id"])

    @cached_property
    def table_versions(self) -> DataFrame:
        return history.version_intervals(self.bronze.tables, ["full_table_name"])

    # gold
    @cached_property
    def flags(self) -> DataFrame:
        return gold.cluster_flags(self.clusters, cfg=self.cfg)

    @cached_property
    def gold_clusters(self) -> DataFrame:
        return gold.gold_clusters(self.clusters, cfg=self.cfg)

    @cached_property
    def run_stats(self) -> DataFrame:
        if self.figures is not None:
            return self.figures
        return gold.job_run_stats(self.runs, cfg=self.cfg)

    @cached_property
    def gold_jobs(self) -> DataFrame:
        return gold.gold_jobs(self.jobs, self.run_stats)

    @cached_property
    def gold_tables(self) -> DataFrame:
        return gold.gold_tables(self.tables, cfg=self.cfg)

    @cached_property
    def storage(self) -> DataFrame:
        return gold.storage_workspace_summary(self.tables, cfg=self.cfg)

    @cached_property
    def daily(self) -> DataFrame:
        return gold.daily_cost(self.billing)

    @cached_property
    def gold_billing(self) -> DataFrame:
        return gold.gold_billing(self.daily, as_of=self.as_of)

    # cost and allocation
    @cached_property
    def estimates(self) -> DataFrame:
        return cost.dbu_cost(self.clusters, as_of=self.as_of, cfg=self.cfg)

    @cached_property
    def allocation(self) -> DataFrame:
        return allocation.tag_allocation(
            self.clusters, self.jobs, self.estimates, as_of=self.as_of
        )

    @cached_property
    def pipelines(self) -> DataFrame:
        return allocation.pipeline_costs(
            self.jobs,
            self.recent(self.cfg.lookback_days),
            self.estimates,
            as_of=self.as_of,
            cfg=self.cfg,
        )

    # scores
    @cached_property
    def maturity(self) -> DataFrame:
        return scores.maturity_scores(
            clusters=self.clusters,
            jobs=self.gold_jobs,
            tables=self.tables,
            baselines=self.before.cost_baseline if self.before else None,
            as_of=self.as_of,
            cfg=self.cfg,
        )

    @cached_property
    def cost_baseline(self) -> DataFrame:
        """The part of this assessment's baseline that later cost scores read."""
        day = F.timestamp_millis(F.lit(self.as_of).cast("bigint")).cast("date")
        return (
            cost.workspace_dbu_cost(self.estimates)
            .select(
                "workspace_name",
                day.alias("baseline_date"),
                F.lit("").alias("baseline_id"),
                F.col("total_estimated_monthly_cost").alias("estimated_monthly_cost"),
            )
        )

    @cached_property
    def baseline(self) -> DataFrame:
        return baselines.create_baseline(
            self.maturity, self.estimates, self.flags, self.jobs, self.storage, as_of=self.as_of
        )

    @cached_property
    def benchmarks(self) -> DataFrame:
        return benchmarks.benchmarks(
            self.flags, self.gold_jobs, self.storage, self.estimates, as_of=self.as_of, cfg=self.cfg
        )

    @cached_property
    def reconciliation(self) -> DataFrame:
        return benchmarks.reconcile_billing(
            self.estimates, self.daily, as_of=self.as_of, cfg=self.cfg
        )

    # rules, audits, reports
    @cached_property
    def recommendations(self) -> DataFrame:
        return rules.recommendations(
            self.flags, self.gold_tables, self.gold_jobs, as_of=self.as_of, cfg=self.cfg
        )

    def issues_of(self, kinds: tuple[str, ...] = audit.ALL_KINDS) -> DataFrame:
        return audit.audit_all(
            flags=self.flags,
            tables=self.gold_tables,
            jobs=self.gold_jobs,
            plain_jobs=self.jobs,
            runs=self.recent(self.cfg.long_runs_days),
            as_of=self.as_of,
            cfg=self.cfg,
            kinds=kinds,
        )

    @cached_property
    def issues(self) -> DataFrame:
        return self.issues_of()

    @cached_property
    def statuses(self) -> DataFrame:
        """Fate of the earlier assessment's recommendations."""
        if self.before is None:
            raise ValueError("statuses need an earlier assessment")
        b = self.bronze
        at = F.create_map(*[F.lit(x) for i, ms in enumerate(self.judged, 2) for x in (i, ms)])
        stamp = F.timestamp_millis(at[F.col("slot")])
        stats = self.figures_together.filter("slot >= 2").withColumn("collect_timestamp", stamp).drop("slot")
        held = history.condition_history(b.clusters, b.tables, b.jobs, None, self.judged, stats=stats, cfg=self.cfg)
        return history.recommendation_status(
            self.together.before.recommendations,
            held,
            self.judged[1:],
            baseline=self.before.as_of,
            as_of=self.as_of,
            cfg=self.cfg,
        )

    @cached_property
    def new_resources(self) -> DataFrame:
        b = self.bronze
        baseline = self.before.as_of if self.before else BASELINE
        return history.new_resources(b.clusters, b.tables, b.jobs, baseline=baseline)

    @cached_property
    def roi(self) -> DataFrame:
        high = self.issues_of(reports.BACKLOG_KINDS)  # all other kinds are of medium severity
        return savings.total_roi(high, self.daily, as_of=self.as_of, cfg=self.cfg)

    @cached_property
    def workspaces(self) -> DataFrame:
        """Every workspace that some part of the report knows.

        Scores, recommendations and all issues but long runs come from the inventories.
        """
        b = self.bronze
        known = silver.seen_by(b.billing, self.as_of)
        long_runs = self.issues_of(("long_running_job",))
        names = [df.select("workspace_name") for df in (b.clusters, b.tables, b.jobs, known, long_runs)]
        return reduce(DataFrame.unionByName, names).distinct()

    def report_of(self, *parts: str) -> DataFrame:
        """The report of all workspaces with the named parts filled in, the others empty and not planned."""
        if self.before is None:
            raise ValueError("the report needs an earlier assessment")
        if unknown := set(parts) - set(REPORT_PARTS):
            raise ValueError(f"unknown parts: {unknown}")

        def wanted(part: str) -> DataFrame:
            counts_runs = "statuses" in parts and part in ("maturity", "issues")
            df = getattr(self.together if counts_runs else self, part)
            return df if part in parts else df.filter(F.lit(False))

        return reports.executive_report(
            **{part: wanted(part) for part in REPORT_PARTS},
            # the whole report lists them by its parts
            workspaces=None if set(parts) == set(REPORT_PARTS) else self.workspaces,
            baseline=self.before.as_of,
            as_of=self.as_of,
            cfg=self.cfg,
        )

    @cached_property
    def report(self) -> DataFrame:
        return self.report_of(*REPORT_PARTS)


REPORT_PARTS = ("maturity", "issues", "statuses", "new_resources", "daily")


def estate(spark: SparkSession, folder: str, cfg: EngineConfig = DEFAULT) -> Estate:
    """Current assessment with the one at ``BASELINE`` behind it."""
    bronze = Bronze(spark, folder)
    return Estate(bronze, AS_OF, cfg, before=Estate(bronze, BASELINE, cfg, until=AS_OF))
