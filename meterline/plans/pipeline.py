"""The four scheduled runs: collect, process, analyze, revalidate.

Each stage writes its tables and the next one reads them back, so no plan grows
with the number of stages and a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.config import DEFAULT, EngineConfig
from meterline.operators import (
    allocation,
    audit,
    automation,
    baselines,
    benchmarks,
    cost,
    gold,
    history,
    reports,
    rules,
    scores,
    silver,
)
from meterline.plans import incremental
from meterline.sources import layers


#: Inventory tables: key of a resource, and what derives silver from bronze.
INVENTORY = {
    "compute_clusters": ("cluster_id", silver.silver_clusters),
    "compute_jobs": ("job_id", silver.silver_jobs),
    "storage_tables": ("full_table_name", silver.silver_tables),
}


class Warehouse:
    """One warehouse folder at one instant."""

    def __init__(
        self, spark: SparkSession, path: str, as_of: int, cfg: EngineConfig = DEFAULT
    ) -> None:
        self.spark, self.path, self.as_of, self.cfg = spark, path, as_of, cfg

    def read(self, name: str) -> DataFrame:
        return layers.read(self.spark, name, self.path)

    def known(self, name: str) -> DataFrame:
        return layers.read_known(self.spark, name, self.path, as_of=self.as_of)

    def replace(self, df: DataFrame, name: str, workspaces: Sequence[str] | None = None) -> None:
        layers.replace(df, name, self.path, as_of=self.as_of, workspaces=workspaces)

    # ------------------------------------------------------------ stages

    def collect(self, bronze: dict[str, DataFrame]) -> None:
        """Store collected rows; keys are bronze table names without the layer."""
        for name, df in bronze.items():
            layers.append(df, f"bronze.{name}", self.path)

    def process(self) -> None:
        """Bronze to silver to gold, and the compute cost estimates."""
        at, cfg = self.as_of, self.cfg
        for name, (key, derive) in INVENTORY.items():
            newest = silver.latest_snapshot(self.known(f"bronze.{name}"), [key])
            self.replace(derive(newest, as_of=at, cfg=cfg), f"silver.{name}")
        runs = silver.latest_runs(self.known("bronze.compute_job_runs"))
        self.replace(silver.silver_job_runs(runs, as_of=at, cfg=cfg), "silver.compute_job_runs")
        costs = silver.newest_collection(self.known("bronze.billing_costs"))
        self.replace(silver.silver_billing(costs, as_of=at, cfg=cfg), "silver.billing_costs")

        runs, costs = self.read("silver.compute_job_runs"), self.read("silver.billing_costs")
        self._summarise(gold.job_run_stats(runs, cfg=cfg), gold.daily_cost(costs))

    def process_new(self) -> None:
        """``process`` for what was collected since the last time: only touched months are rewritten.

        Silver and gold end as ``process`` would leave them; rows of untouched months
        keep the time they were derived at. The first time takes in the whole history.
        """
        for name, (key, derive) in INVENTORY.items():
            incremental.fold_inventory(self, name, key, derive)
        incremental.fold_runs(self)
        incremental.fold_costs(self)
        self._summarise(incremental.run_stats(self), incremental.daily(self))

    def _summarise(self, stats: DataFrame, daily: DataFrame) -> None:
        """Gold from the silver inventories, the run statistics and the daily costs."""
        at, cfg = self.as_of, self.cfg
        clusters, tables = self.read("silver.compute_clusters"), self.read("silver.storage_tables")
        self.replace(gold.gold_clusters(clusters, cfg=cfg), "gold.compute_clusters_summary")
        self.replace(gold.gold_jobs(self.read("silver.compute_jobs"), stats), "gold.compute_jobs_summary")
        self.replace(gold.gold_tables(tables, cfg=cfg), "gold.storage_tables_summary")
        self.replace(
            gold.storage_workspace_summary(tables, cfg=cfg), "gold.storage_workspace_summary"
        )
        self.replace(gold.gold_billing(daily, as_of=at), "gold.billing_costs_summary")
        self.replace(cost.dbu_cost(clusters, as_of=at, cfg=cfg), "gold.costs_dbu_estimates")

    def analyze(self) -> None:
        """Scores, baseline, benchmarks, reconciliation, allocation, recommendations, actions."""
        at, cfg = self.as_of, self.cfg
        clusters, jobs = self.read("silver.compute_clusters"), self.read("silver.compute_jobs")
        flags = self.read("gold.compute_clusters_summary")
        gold_jobs = self.read("gold.compute_jobs_summary")
        gold_tables = self.read("gold.storage_tables_summary")
        storage = self.read("gold.storage_workspace_summary")
        estimates = self.read("gold.costs_dbu_estimates")
        daily = self.read("gold.billing_costs_summary")

        earlier = None
        if self._exists("gold.assessment_baselines"):
            known = self.known("gold.assessment_baselines")
            before = F.timestamp_millis(F.lit(at).cast("bigint")).cast("date")
            earlier = known.filter(F.col("baseline_date") < before)
        self.replace(
            scores.maturity_scores(
                clusters=clusters,
                jobs=gold_jobs.join(
                    jobs.select("workspace_name", "job_id", "tags"), ["workspace_name", "job_id"]
                ),
                tables=self.read("silver.storage_tables"),
                baselines=earlier,
                as_of=at,
                cfg=cfg,
            ),
            "gold.maturity_scores",
        )
        maturity = self.latest("gold.maturity_scores")
        self.replace(
            baselines.create_baseline(maturity, estimates, flags, gold_jobs, storage, as_of=at),
            "gold.assessment_baselines",
        )
        self.replace(
            benchmarks.benchmarks(flags, gold_jobs, storage, estimates, as_of=at, cfg=cfg),
            "gold.benchmarks",
        )
        self.replace(
            benchmarks.reconcile_billing(estimates, daily, as_of=at, cfg=cfg),
            "gold.billing_reconciliation",
        )
        self.replace(
            allocation.tag_allocation(clusters, jobs, estimates, as_of=at), "gold.cost_allocation"
        )
        self.replace(
            allocation.pipeline_costs(
                gold_jobs, self.read("silver.compute_job_runs"), estimates, as_of=at, cfg=cfg
            ),
            "gold.cost_allocation_pipelines",
        )
        self.replace(
            rules.recommendations(flags, gold_tables, gold_jobs, as_of=at, cfg=cfg),
            "gold.recommendations",
        )
        judged = F.timestamp_millis(F.lit(at).cast("bigint"))
        self.replace(
            rules.conditions(flags, gold_tables, gold_jobs, cfg=cfg).withColumn(
                "snapshot_timestamp", judged
            ),
            "gold.rule_conditions",
        )
        self.replace(
            automation.automation_actions(flags, as_of=at, cfg=cfg), "gold.automation_actions"
        )

    def revalidate(self, baseline: int, snapshots: Sequence[int]) -> None:
        """Audit once, then derive all reports from the stored issues.

        ``snapshots`` are the instants at which ``analyze`` ran, the baseline's
        and this one's included.
        """
        at, cfg = self.as_of, self.cfg
        self.replace(
            audit.audit_all(
                flags=self.read("gold.compute_clusters_summary"),
                tables=self.read("gold.storage_tables_summary"),
                jobs=self.read("gold.compute_jobs_summary"),
                runs=self.read("silver.compute_job_runs"),
                as_of=at,
                cfg=cfg,
            ),
            "gold.audit_issues",
        )
        issues = self.read("gold.audit_issues")
        self.replace(reports.technical_checklist(issues), "gold.technical_checklist")
        self.replace(reports.backlog_items(issues, cfg=cfg), "gold.prioritized_backlog")
        self.replace(reports.quick_wins(issues, cfg=cfg), "gold.quick_wins")

        stamp = F.timestamp_millis(F.lit(baseline).cast("bigint"))
        recommended = self.known("gold.recommendations").filter(
            F.col("process_timestamp") == stamp
        )
        statuses = history.recommendation_status(
            recommended,
            self.known("gold.rule_conditions"),
            snapshots,
            baseline=baseline,
            as_of=at,
            cfg=cfg,
        )
        fresh = history.new_resources(
            self.known("bronze.compute_clusters"),
            self.known("bronze.storage_tables"),
            self.known("bronze.compute_jobs"),
            baseline=baseline,
        )
        report = reports.executive_report(
            maturity=self.latest("gold.maturity_scores"),
            issues=issues,
            statuses=statuses,
            new_resources=fresh,
            daily=self.read("gold.billing_costs_summary"),
            baseline=baseline,
            as_of=at,
            cfg=cfg,
        )
        self.replace(report, "gold.executive_reports")

    # ------------------------------------------------------------ helpers

    def latest(self, name: str) -> DataFrame:
        """Rows of a history table written for this instant."""
        stamp = F.timestamp_millis(F.lit(self.as_of).cast("bigint"))
        return self.known(name).filter(F.col("process_timestamp") == stamp)

    def _exists(self, name: str) -> bool:
        return layers.exists(self.spark, name, self.path)
