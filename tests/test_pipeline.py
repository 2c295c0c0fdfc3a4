"""The stored pipeline equals the lazy plans, and running a day again changes nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meterline.fixtures import AS_OF, BASELINE, SNAPSHOTS, Bronze, Estate
from meterline.plans import kpis
from meterline.plans.pipeline import Warehouse
from meterline.schemas import TABLES
from meterline.sources import layers


class FewWorkspaces(Bronze):
    """Three workspaces, and facts stamped with the collection that first saw them."""

    def _kept(self, name):
        df = getattr(Bronze(self.spark, self.folder), name)
        df = df.filter(F.col("workspace_name").isin("ws_1", "ws_2", "ws_3"))
        if name not in ("runs", "billing"):
            return df
        at = F.unix_millis("collect_timestamp")
        seen = F.least(*[F.when(at <= ms, F.lit(ms)) for ms in SNAPSHOTS])
        return df.withColumn("collect_timestamp", F.timestamp_millis(seen))

    clusters = property(lambda self: self._kept("clusters"))
    jobs = property(lambda self: self._kept("jobs"))
    runs = property(lambda self: self._kept("runs"))
    tables = property(lambda self: self._kept("tables"))
    billing = property(lambda self: self._kept("billing"))


@pytest.fixture(scope="module")
def run(spark, tiny, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warehouse"))
    bronze = FewWorkspaces(spark, tiny)
    Warehouse(spark, path, AS_OF).collect(
        {
            "compute_clusters": bronze.clusters,
            "compute_jobs": bronze.jobs,
            "compute_job_runs": bronze.runs,
            "storage_tables": bronze.tables,
            "billing_costs": bronze.billing,
        }
    )
    for at in SNAPSHOTS:
        w = Warehouse(spark, path, at)
        w.process()
        w.analyze()
    w.revalidate(BASELINE, SNAPSHOTS)
    before = Estate(bronze, BASELINE)
    return w, before, Estate(bronze, AS_OF, before=before)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:2] == y[:2]
        assert x[2:] == pytest.approx(y[2:], nan_ok=True) or x == y


def test_gold_tables_equal_lazy_plans(run):
    w, _, now = run
    near(
        rows(w.read("gold.compute_clusters_summary"), "workspace_name", "cluster_id", "rank_by_uptime"),
        rows(now.gold_clusters, "workspace_name", "cluster_id", "rank_by_uptime"),
    )
    near(
        rows(w.read("gold.compute_jobs_summary").fillna(-1), "workspace_name", "job_id", "failure_rate"),
        rows(now.gold_jobs.fillna(-1), "workspace_name", "job_id", "failure_rate"),
    )
    near(
        rows(w.read("gold.billing_costs_summary"), "workspace_name", "date_parsed", "monthly_cost_usd"),
        rows(now.gold_billing, "workspace_name", "date_parsed", "monthly_cost_usd"),
    )


def test_history_is_kept_per_assessment(run):
    w, *_ = run
    assert w.read("gold.assessment_baselines").select("baseline_date").distinct().count() == 3
    assert kpis.q_score_history(w.read("gold.maturity_scores"), "ws_1").count() == 3


def test_issues_and_recommendations_equal_lazy_plans(run):
    w, _, now = run
    cols = ("workspace_name", "issue_type", "resource_id", "severity")
    assert rows(w.read("gold.audit_issues"), *cols) == rows(now.issues, *cols)
    cols = ("workspace_name", "rule_id", "resource_id", "title")
    assert rows(w.latest("gold.recommendations"), *cols) == rows(now.recommendations, *cols)


def test_report_statuses_equal_lazy_plans(run):
    w, _, now = run
    report = w.read("gold.executive_reports").drop(layers.DAY)
    got = rows(kpis.q_recommendation_status(report), "workspace_name", "recommendation_title", "status")
    want = rows(now.statuses, "workspace_name", "recommendation_title", "status")
    assert got == want
    assert report.schema["executive_summary"].dataType == TABLES["gold.executive_reports"].schema["executive_summary"].dataType


def test_report_schema_is_declared_schema(spark, tiny, run):
    _, _, now = run
    got = {f.name: f.dataType.simpleString() for f in now.report.schema}
    want = {f.name: f.dataType.simpleString() for f in TABLES["gold.executive_reports"].schema}
    assert got == want


def test_a_day_run_again_leaves_one_copy(run):
    w, *_ = run
    names = ("gold.maturity_scores", "gold.recommendations", "gold.rule_conditions", "silver.compute_clusters")
    before = {n: w.read(n).count() for n in names}
    w.process()
    w.analyze()
    assert {n: w.read(n).count() for n in names} == before


def test_one_workspace_does_not_overwrite_others(run, spark):
    w, *_ = run
    total = w.read("gold.costs_dbu_estimates").count()
    one = w.read("gold.costs_dbu_estimates").filter("workspace_name = 'ws_1'")
    kept = spark.createDataFrame(one.collect(), one.schema)
    w.replace(kept, "gold.costs_dbu_estimates", workspaces=["ws_1"])
    assert w.read("gold.costs_dbu_estimates").count() == total


def test_rows_that_are_gone_do_not_stay(run, spark, tmp_path):
    w, *_ = run
    wins = w.read("gold.costs_dbu_estimates")
    rows_ = spark.createDataFrame(wins.collect(), wins.schema)
    path = str(tmp_path)
    table = "gold.costs_dbu_estimates"
    names = lambda: {r[0] for r in layers.read(spark, table, path).select("workspace_name").distinct().collect()}
    layers.replace(rows_, table, path)
    assert names() == {"ws_1", "ws_2", "ws_3"}
    layers.replace(rows_.filter("workspace_name = 'none'"), table, path, workspaces=["ws_2"])
    assert names() == {"ws_1", "ws_3"}
    layers.replace(rows_.filter("workspace_name = 'ws_1'"), table, path)
    assert names() == {"ws_1"}


def test_a_history_day_run_again_loses_what_is_gone(run, spark, tmp_path):
    w, *_ = run
    rows_ = w.latest("gold.recommendations")
    rows_ = spark.createDataFrame(rows_.collect(), rows_.schema)
    path, table = str(tmp_path), "gold.recommendations"
    for at, kept in ((BASELINE, rows_), (AS_OF, rows_), (AS_OF, rows_.filter("workspace_name = 'ws_1'"))):
        layers.replace(kept, table, path, as_of=at)
    got = layers.read(spark, table, path).groupBy(layers.DAY).agg(F.count_distinct("workspace_name").alias("n")).collect()
    assert {str(r[0]): r.n for r in got} == {"2001-06-02": 3, "2001-08-01": 1}


def test_allocation_and_actions_keep_their_history(run):
    w, *_ = run
    for name in ("gold.cost_allocation", "gold.cost_allocation_pipelines", "gold.automation_actions"):
        assert w.read(name).select(layers.DAY).distinct().count() == 3


def test_removed_resources_are_not_current(run):
    w, _, now = run
    gone = {f"c-{k}" for k in range(2000) if k % 29 == 7}
    for df in (w.read("silver.compute_clusters"), now.clusters):
        assert not gone & {r[0] for r in df.select("cluster_id").collect()}


def test_as_of_read_skips_later_days(run):
    w, *_ = run
    early = layers.read_known(w.spark, "bronze.compute_clusters", w.path, as_of=BASELINE)
    plan = early._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan
    assert early.agg(F.max("collect_timestamp").cast("date").cast("string")).first()[0] == "2001-06-02"


def test_report_sql_as_text(run):
    w, *_ = run
    names = ["gold.compute_jobs_summary", "gold.executive_reports"]
    assert layers.register_views(w.spark, w.path, names) == ["gold_compute_jobs_summary", "gold_executive_reports"]
    got = w.spark.sql(
        "SELECT workspace_name, job_id FROM gold_compute_jobs_summary "
        "WHERE workspace_name = :ws AND total_runs > 10 ORDER BY failure_rate DESC, avg_duration_hours DESC, job_id LIMIT 20",
        {"ws": "ws_2"},
    )
    want = kpis.kpi_inefficient_jobs(w.read("gold.compute_jobs_summary"), "ws_2")
    assert rows(got, "workspace_name", "job_id") == rows(want, "workspace_name", "job_id")
    text = "SELECT r.status FROM gold_executive_reports LATERAL VIEW EXPLODE(recommendations_status) t AS r"
    assert w.spark.sql(text).count() > 0


def test_evolved_columns_can_be_read(run, spark, tmp_path):
    w, *_ = run
    old = w.read("bronze.compute_jobs").drop(layers.DAY).filter("workspace_name = 'ws_1'")
    path = str(tmp_path)
    layers.append(old, "bronze.compute_jobs", path)
    layers.append(old.withColumn("note", F.lit("n")), "bronze.compute_jobs", path, keep_extra=True)
    assert "note" in layers.read(spark, "bronze.compute_jobs", path, evolved=True).columns
    assert layers.read(spark, "bronze.compute_jobs", path).count() == 2 * old.count()


def test_unknown_table_is_refused(spark):
    with pytest.raises(KeyError):
        layers.read(spark, "gold.nothing", "/nowhere")
