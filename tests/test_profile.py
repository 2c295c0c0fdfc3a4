"""Known figures of the fixtures and invariants over whole layers."""

from __future__ import annotations

import dataclasses
import datetime
from collections import Counter, defaultdict

import pytest
from compare import duck
from pyspark.sql import functions as F

from meterline.config import EngineConfig
from meterline.fixtures import AS_OF, DAY, Bronze, Estate, estate
from meterline.operators import gold, history, scores, silver


@pytest.fixture(scope="module")
def e(spark, small):
    return estate(spark, small)


@pytest.fixture(scope="module")
def base(small):
    """Rows of the supplied tables as plain Python."""
    con = duck(small)
    return lambda text: con.execute(text).fetchall()


def idle_minutes(k, s):
    """Minutes since the last activity of cluster k at snapshot s; None if unknown or absent."""
    there = (s == 2 or k % 17) and not (s == 2 and k % 29 == 7)
    return (k * 7 + s * 311) % 960 if there and k % 13 else None


def test_cluster_profile(e, base):
    keys = [k for (k,) in base("select c_custkey from customer")]
    now = [k for k in keys if k % 29 != 7]
    assert e.bronze.clusters.count() == len(now) + 2 * sum(k % 17 != 0 for k in keys)
    row = e.flags.agg(
        F.count(F.lit(1)),
        F.count_if("is_idle"),
        F.count_if("is_overprovisioned"),
        F.count_if(~F.col("has_autoscaling") & (F.col("num_workers") > 5)),
        F.count_if(F.col("idle_hours").isNull()),
    ).first()
    idle = {k: idle_minutes(k, 2) for k in now}
    assert tuple(row) == (
        len(now),
        sum((idle[k] or 0) > 240 for k in now),
        sum((idle[k] or 0) > 120 and k % 21 > 10 for k in now),
        sum((k + 2) % 5 < 2 and k % 21 > 5 for k in now),
        sum(idle[k] is None for k in now),
    )


def test_run_profile(e, base):
    rows = base("select l_orderkey, l_linenumber, l_partkey from lineitem")
    failed = [(o * 31 + n * 17) % 100 < p % 45 for o, n, p in rows]
    copies = sum((o + n) % 9 == 0 for o, n, _ in rows)
    assert e.bronze.runs.count() == len(rows) + copies
    row = e.bronze.runs.agg(
        *[F.count_if(F.col("result_state") == x) for x in ("FAILED", "CANCELLED", "RUNNING")]
    ).first()
    cancelled = sum(not f and (o + n) % 50 == 0 for f, (o, n, _) in zip(failed, rows))
    assert tuple(row) == (sum(failed), cancelled, copies)
    assert e.bronze.runs.select("run_id").distinct().count() == len(rows) == e.runs.count()


def test_table_profile(e, base):
    rows = [(k, size) for k, size in base("select p_partkey, p_size from part") if k % 37 != 3]
    gb = {k: (k % 997 + 1) * size * 4_000_000 / 2**30 for k, size in rows}
    files = {k: k * 13 % 5000 for k in gb}
    days = {k: (k * 5 + 302) % 400 if k % 3 else (k * 7 + 74) % 400 for k in gb}
    small = [k for k in gb if k % 7 and gb[k] > 10 and (not files[k] or gb[k] * 1024 / files[k] < 128)]
    row = e.tables.agg(
        F.count(F.lit(1)),
        F.count_if("is_cold_data"),
        F.count_if("is_abandoned"),
        F.count_if(F.col("size_gb") > 100),
        F.count_if(F.col("is_delta") & F.col("has_small_files") & (F.col("size_gb") > 10)),
    ).first()
    assert tuple(row) == (
        len(rows),
        sum(d > 90 for d in days.values()),
        sum(d > 180 for d in days.values()),
        sum(g > 100 for g in gb.values()),
        len(small),
    )


def test_billing_profile(e, base):
    day = datetime.date(2001, 8, 1)
    lines = defaultdict(lambda: ([], []))
    for key, customer, price, at in base("select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders"):
        first, second = lines[customer % 25, at.date()]
        if key % 7 != 3:
            first.append(price / (2000 if key % 11 == 5 else 1000))
        if key % 13 != 4 and at.date() + datetime.timedelta(20) <= day:
            second.append(price / 1000)
    kept = [second or first for first, second in lines.values() if second or first]
    row = e.billing.agg(F.count(F.lit(1)), F.sum("cost_usd")).first()
    assert row[0] == sum(map(len, kept)) and row[1] == pytest.approx(sum(map(sum, kept)))
    assert e.daily.count() == len(kept)


def test_new_resources_profile(e, base):
    row = e.new_resources.agg(F.sum("new_clusters"), F.sum("new_tables"), F.sum("new_jobs")).first()
    clusters, parts = base("select c_custkey from customer"), base("select p_partkey from part")
    assert tuple(row) == (
        sum(k % 17 == 0 and k % 29 != 7 for (k,) in clusters),
        sum(k % 23 == 0 and k % 37 != 3 for (k,) in parts),
        sum(k % 19 == 0 and k % 31 != 5 for (k,) in parts),
    )


def test_three_snapshot_history_of_idle_clusters(spark, small, base):
    cfg = EngineConfig(top_recommendations=100_000)
    bronze = Bronze(spark, small)
    before = Estate(bronze, AS_OF - 60 * DAY, cfg)
    now = Estate(bronze, AS_OF, cfg, before=before)
    counts = {
        r.status: r.n
        for r in now.statuses.filter("rule_id = 'idle_cluster'")
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    want = Counter()
    for (k,) in base("select c_custkey from customer"):
        was, between, still = ((idle_minutes(k, s) or 0) > 240 for s in range(3))
        if was:
            want["não_implementada" if still and between else "regressão" if still else "implementada"] += 1
    assert counts == want and len(want) == 3


def test_days_add_up_to_months(e):
    days = e.daily.agg(F.sum("daily_cost_usd")).first()[0]
    months = gold.monthly_cost(e.daily).agg(F.sum("monthly_cost_usd")).first()[0]
    assert days == pytest.approx(months)


def test_domain_totals_equal_cluster_cost(e):
    from meterline.operators.allocation import cost_by_domain

    total = e.estimates.agg(F.sum("estimated_monthly_cost")).first()[0]
    for row in cost_by_domain(e.allocation).groupBy("dimension").agg(
        F.sum("total_monthly_cost").alias("t")
    ).collect():
        assert row.t == pytest.approx(total)


def test_scores_stay_in_range_and_runs_add_up(e):
    m = e.maturity
    for d in (*scores.DIMENSIONS, "maturity"):
        assert m.filter(~F.col(f"{d}_score").between(0, 1)).count() == 0
    assert e.run_stats.filter("successful_runs + failed_runs > total_runs").count() == 0


def test_new_and_baseline_clusters_are_disjoint(e):
    fresh = history.new_since(e.bronze.clusters, "cluster_id", baseline=AS_OF - 60 * DAY)
    old = silver.seen_by(e.bronze.clusters, AS_OF - 60 * DAY)
    assert fresh.join(old, ["workspace_name", "cluster_id"], "left_semi").count() == 0


def test_workspaces_do_not_influence_each_other(spark, small):
    class OnlyOne(Bronze):
        pass

    for name in ("clusters", "jobs", "runs", "tables", "billing"):
        setattr(
            OnlyOne,
            name,
            property(lambda self, n=name: getattr(Bronze(self.spark, self.folder), n).filter("workspace_name = 'ws_3'")),
        )
    alone = Estate(OnlyOne(spark, small), AS_OF).maturity.collect()
    together = Estate(Bronze(spark, small), AS_OF).maturity.filter("workspace_name = 'ws_3'").collect()
    assert alone == together


def test_config_rejects_unknown_charge_mode():
    with pytest.raises(ValueError):
        dataclasses.replace(EngineConfig(), charge_mode="other")


def test_prorated_cost_never_exceeds_cluster_cost(spark, small):
    cfg = EngineConfig(charge_mode="prorated")
    e = Estate(Bronze(spark, small), AS_OF, cfg)
    charged = e.pipelines.agg(F.sum("estimated_dbu_cost")).first()[0]
    used = (
        silver.runs_since(e.runs, 30, as_of=AS_OF)
        .select("workspace_name", F.get_json_object("cluster_instance", "$.cluster_id").alias("cluster_id"))
        .distinct()
    )
    full = used.join(e.estimates, ["workspace_name", "cluster_id"]).agg(
        F.sum("estimated_dbu_cost")
    ).first()[0]
    # runs of removed jobs take their share of a cluster and are charged to nobody
    assert 0.9 * full < charged <= full
