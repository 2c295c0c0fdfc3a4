"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(folder: str) -> "duckdb.DuckDBPyConnection":
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(spark_df, con, text: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    got = spark_df.collect()
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(set(spark_df.columns) ^ set(names))}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = _rows(spark_df.columns, got), _rows(names, want)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)} of {len(a)} rows, columns {sorted(names)}: {bad[0][0]} vs {bad[0][1]}"
    return None
