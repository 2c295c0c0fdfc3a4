"""Fate of recommendations over three snapshots, against the definition applied row by row."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from meterline.config import EngineConfig
from meterline.operators import history

DAY = 86_400_000
THEN, MIDDLE, NOW = DAY, 2 * DAY, 3 * DAY
MEASURES = (None, 0.0, 3.0, 4.0, 8.0)  # None: the rule does not hold


def expected(then, middle, now, drop):
    if now is None:
        return "implementada"
    if middle is None:
        return "regressão"
    if then and now <= (1 - drop) * then:
        return "parcial"
    return "não_implementada"


@pytest.mark.parametrize("drop", [0.25, 0.5])
def test_all_histories_of_a_finding(spark, drop):
    cases = list(itertools.product(MEASURES, repeat=3))
    recs = spark.createDataFrame(
        [("w", "idle_cluster", str(i), "t", "compute", "high") for i in range(len(cases))],
        "workspace_name string, rule_id string, resource_id string, title string, category string, priority string",
    )
    held = [
        ("w", "idle_cluster", str(i), at, m)
        for i, case in enumerate(cases)
        for at, m in zip((THEN, MIDDLE, NOW), case)
        if m is not None
    ]
    held += [("w", "other_rule", "0", NOW, 9.0), ("v", "idle_cluster", "0", NOW, 9.0), held[0]]
    rows = spark.createDataFrame(
        held, "workspace_name string, rule_id string, resource_id string, ms long, measure double"
    ).withColumn("snapshot_timestamp", F.timestamp_millis("ms"))
    got = history.recommendation_status(
        recs, rows, [THEN, MIDDLE, NOW], baseline=THEN, as_of=NOW, cfg=EngineConfig(partial_drop=drop)
    )
    status = {int(r.resource_id): r.status for r in got.collect()}
    assert status == {i: expected(*case, drop) for i, case in enumerate(cases)}


def test_an_unknown_measure_is_no_partial_work(spark):
    recs = spark.sql("select 'w' workspace_name, 'r' rule_id, 'x' resource_id, 't' title, 'c' category, 'high' priority")
    held = spark.sql(
        "select 'w' workspace_name, 'r' rule_id, 'x' resource_id, timestamp_millis(ms) snapshot_timestamp, "
        f"cast(m as double) measure from values ({THEN}L, null), ({NOW}L, 1) v(ms, m)"
    )
    got = history.recommendation_status(recs, held, [THEN, NOW], baseline=THEN, as_of=NOW)
    assert got.first().status == "não_implementada"
