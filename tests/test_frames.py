"""Helpers against brute force, with one key holding a third of the rows."""

from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from meterline.functions.frames import per_workspace, spread_rank, top_n

SCHEMA = "workspace_name string, cluster_id string, uptime_hours double"


def _rank_both(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    w = Window.partitionBy("workspace_name").orderBy(F.col("uptime_hours").desc_nulls_last())
    want = {(r.workspace_name, r.cluster_id): r.r for r in df.withColumn("r", F.rank().over(w)).collect()}
    got = {
        (r.workspace_name, r.cluster_id): r.rk
        for r in spread_rank(df, "workspace_name", "uptime_hours", 1.0, "rk").collect()
    }
    return got, want


def test_spread_rank_with_hot_workspace_and_hot_value(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        ws = "hot" if i % 3 == 0 else f"ws_{i % 50}"
        up = None if i % 7 == 0 else 720.0 if i % 3 == 0 else round(rnd.uniform(-5, 900), 2)
        rows.append((ws, f"c-{i}", up))
    got, want = _rank_both(spark, rows)
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b"]),
            st.one_of(st.none(), st.sampled_from([0.0, 0.5, 0.999, 1.0, 1.5, 2.0, 100.0])),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_spread_rank_property(spark, values):
    got, want = _rank_both(spark, [(w, f"c-{i}", v) for i, (w, v) in enumerate(values)])
    assert got == want


def test_top_n_takes_whole_groups_below_n(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, v int")
    rows = top_n(df, 3, ["k"], [F.col("v").desc()]).collect()
    assert sorted((r.k, r.v) for r in rows) == [("a", 2), ("a", 3), ("a", 4), ("b", 9)]


def test_per_workspace_keeps_every_workspace(spark):
    a = spark.createDataFrame([("w1", 1), ("w2", 2)], "workspace_name string, x int")
    b = spark.createDataFrame([("w2", "y"), ("w3", "z")], "workspace_name string, t string")
    rows = {r.workspace_name: (r.x, r.t) for r in per_workspace(a, b).collect()}
    assert rows == {"w1": (1, None), "w2": (2, "y"), "w3": (None, "z")}
