"""Inventories from transaction logs in their published layout."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from meterline.schemas import struct_of
from meterline.sources import table_log as L

T0 = 1_700_000_000_000


def add(path, size, at=0):
    return {"add": {"path": path, "size": size, "modificationTime": T0 + at, "dataChange": True}}


def commit(at, operation="WRITE"):
    return {"commitInfo": {"timestamp": T0 + at, "operation": operation, "isBlindAppend": True}}


def write(root, table, version, *actions):
    folder = root / table / "_delta_log"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{version:020d}.json").write_text("".join(json.dumps(a) + "\n" for a in actions))


META = {"metaData": {"format": {"provider": "parquet"}, "partitionColumns": ["day"]}}


def found(spark, root, checkpoints=False, **more):
    commits = L.read_log(spark, f"{root}/*/{L.COMMITS}")
    state = L.read_log(spark, f"{root}/*/{L.CHECKPOINTS}", checkpoints=True) if checkpoints else None
    rows = L.inventory(commits, state, **more).collect()
    return {r.location.rsplit("/", 1)[1]: r for r in rows}


def logs(root):
    write(root, "a", 0, commit(0), META, add("x", 10), add("y", 20))
    write(root, "a", 1, commit(1000), {"remove": {"path": "x", "deletionTimestamp": T0 + 1}}, add("z", 5, 1000))
    write(root, "a", 2, commit(2000, "MERGE"), {"remove": {"path": "y"}}, add("y", 21, 2000))  # rewritten under its name
    write(root, "a", 10, commit(9000, "RESTORE"), add("x", 10, 9000))  # added again
    write(root, "b", 0, commit(500), META)
    write(root, "b", 1, commit(600, "DELETE"), {"remove": {"path": "never"}}, {"protocol": {"minReaderVersion": 1}})
    (root / "a" / "_delta_log" / "_last_checkpoint").write_text("{}")
    (root / "a" / "_delta_log" / "notes.json").write_text("{}\n")


def test_newest_action_of_each_file_counts(spark, tmp_path):
    logs(tmp_path)
    got = found(spark, tmp_path)
    a, b = got["a"], got["b"]
    assert (a.num_files, a.size_in_bytes, a.version, a.partition_columns, a.last_operation) == (3, 36, 10, '["day"]', "RESTORE")
    assert (b.num_files, b.size_in_bytes, b.version, b.last_modified, b.table_type) == (0, 0, 1, None, "parquet")


def test_as_of_stops_at_a_version(spark, tmp_path):
    logs(tmp_path)
    got = found(spark, tmp_path, as_of=T0 + 1500)
    assert (got["a"].num_files, got["a"].size_in_bytes, got["a"].version) == (2, 25, 1)
    assert "b" in got and found(spark, tmp_path, as_of=T0 + 100).keys() == {"a"}


def test_checkpoint_stands_for_older_commits(spark, tmp_path):
    logs(tmp_path)
    whole = found(spark, tmp_path)["a"]
    state = [json.dumps(x) for x in (META, add("z", 5, 1000), add("y", 21, 2000), {"remove": {"path": "x"}})]
    rows = spark.read.schema(struct_of(L.ACTIONS)).json(spark.sparkContext.parallelize(state))
    rows.coalesce(1).write.parquet(str(tmp_path / "tmp"))
    part = next((tmp_path / "tmp").glob("*.parquet"))
    log = tmp_path / "a" / "_delta_log"
    part.rename(log / f"{2:020d}.checkpoint.parquet")
    assert found(spark, tmp_path, checkpoints=True)["a"] == whole  # commits before it may still be there
    (log / f"{0:020d}.json").unlink()
    (log / f"{1:020d}.json").unlink()
    assert found(spark, tmp_path, checkpoints=True)["a"] == whole


def test_no_logs(spark):
    empty = spark.createDataFrame([], struct_of(L.ACTIONS)).withColumns({"location": F.lit(""), "version": F.lit(0).cast("bigint")})
    assert L.inventory(empty).count() == 0
