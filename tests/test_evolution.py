"""Columns that change their type between appends; the common type of two."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F, types as T

from meterline.sources import evolution, layers

TABLE = "bronze.compute_jobs"


def parsed(text):
    return T.StructType.fromDDL(f"x {text}")["x"].dataType


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("int", "int", "int"),
        ("int", "bigint", "bigint"),
        ("tinyint", "smallint", "smallint"),
        ("int", "float", "double"),
        ("float", "double", "double"),
        ("bigint", "decimal(12,2)", "decimal(21,2)"),
        ("decimal(10,4)", "decimal(12,2)", "decimal(14,4)"),
        ("bigint", "decimal(38,20)", "double"),
        ("decimal(5,1)", "double", "double"),
        ("date", "timestamp", "timestamp"),
        ("int", "string", "string"),
        ("boolean", "int", "string"),
        ("struct<a:int>", "string", "string"),
        ("struct<a:int>", "struct<A:bigint,b:string>", "struct<a:bigint,b:string>"),
        ("array<int>", "array<double>", "array<double>"),
        ("map<string,int>", "map<string,bigint>", "map<string,bigint>"),
    ],
)
def test_common_type(spark, a, b, want):
    for x, y in ((a, b), (b, a)):
        got = evolution.common_type(parsed(x), parsed(y)).simpleString().lower()
        assert got == parsed(want).simpleString()


def day(spark, path, at, sql):
    rows = spark.sql(sql).withColumn("job_id", F.lit(at)).withColumn("collect_timestamp", F.timestamp_seconds(F.lit(at * 86_400)))
    layers.append(rows.withColumn("workspace_name", F.lit("7")), TABLE, path, keep_extra=True)


def test_every_change_of_type(spark, tmp_path):
    path = str(tmp_path)
    day(spark, path, 1, "select 1 as n, 'a' as t, named_struct('p', 1) as s, array(1) as l, map('k', 1) as m")
    day(spark, path, 2, "select 2 as n, 5 as t, named_struct('p', 2L, 'q', 'x') as s, array(2.5D) as l, map('k', 2L) as m")
    day(spark, path, 2, "select 3000000000L as n, 'c' as t, cast(null as struct<p:int>) as s, cast(null as array<int>) as l, map('k', 3) as m")
    day(spark, path, 3, "select 4 as n, named_struct('z', 1) as t, array(9) as l, true as fresh")
    got = layers.read(spark, TABLE, path, evolved=True)
    kinds = dict(got.dtypes)
    assert (kinds["n"], kinds["t"], kinds["s"], kinds["l"]) == ("bigint", "string", "struct<p:bigint,q:string>", "array<double>")
    assert kinds["workspace_name"] == "string" and layers.DAY not in kinds
    rows = {r.n: r for r in got.collect()}
    assert set(rows) == {1, 2, 3_000_000_000, 4}
    assert [rows[k].t for k in (1, 2, 3_000_000_000, 4)] == ["a", "5", "c", '{"z":1}']
    assert tuple(rows[1].s) == (1, None) and tuple(rows[2].s) == (2, "x") and rows[3_000_000_000].s is None
    assert rows[1].l == [1.0] and rows[2].l == [2.5] and rows[3_000_000_000].l is None
    assert rows[3_000_000_000].m == {"k": 3} and rows[4].m is None
    assert [rows[k].fresh for k in (1, 4)] == [None, True]


def test_one_change_leaves_few_scans(spark, tmp_path):
    path = str(tmp_path)
    for at in range(1, 9):
        day(spark, path, at, f"select {at}{'L' if at > 5 else ''} as n")
    found = evolution.generations(spark, layers._table(TABLE).path(path))
    assert [len(parts) for parts, _ in found] == [5, 3]
    got = layers.read(spark, TABLE, path, evolved=True)
    plan = got.filter("n > 6").select("n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("PushedFilters: [IsNotNull(n)") == 2
    assert sorted(r.n for r in got.filter("n > 6").collect()) == [7, 8]


def test_names_that_differ_in_case_only_are_one_column(spark, tmp_path):
    path = str(tmp_path)
    day(spark, path, 1, "select 1 as Note")
    day(spark, path, 2, "select 2L as note")
    got = layers.read(spark, TABLE, path, evolved=True)
    assert sorted(r[0] for r in got.select("note").collect()) == [1, 2]


def test_a_table_without_files_has_its_declared_columns(spark, tmp_path):
    got = layers.read(spark, TABLE, str(tmp_path), evolved=True)
    assert got.count() == 0 and "job_id" in got.columns
