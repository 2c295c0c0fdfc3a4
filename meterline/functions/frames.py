"""DataFrame helpers that keep hot groups from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

WORKSPACE = "workspace_name"


def top_n(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First ``n`` rows of each group under a total order.

    ``row_number() <= n`` lets Spark cut each map partition to ``n`` rows per
    group before the shuffle, so a hot group never travels whole.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Newest row of each key; ``order`` must be total and newest first."""
    return top_n(df, 1, keys, order)


def per_workspace(*frames: DataFrame, key: str = WORKSPACE) -> DataFrame:
    """Put one-row-per-workspace frames side by side.

    A union followed by one aggregation replaces a chain of full outer joins:
    every frame holds at most one row per workspace, so the only non-null value
    of a column is the wanted one, and one shuffle of tiny rows is enough.
    """
    cols = [c for f in frames for c in f.columns if c != key]
    if len(cols) != len(set(cols)):
        raise ValueError("frames share column names")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def spread_rank(
    df: DataFrame, by: str, value: str, bucket_width: float, alias: str
) -> DataFrame:
    """``rank()`` of ``value`` (descending, nulls last) inside ``by`` for groups of any size.

    A plain window would sort a whole workspace in one task. Here equal values
    collapse to one counted row first (map-side), the counted rows are ranked
    inside value buckets, and bucket totals give each bucket's offset, so no
    window partition grows with the number of rows. The join back has one row
    per value on its right side; adaptive skew handling may split the left side.
    """
    counted = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_bucket", F.floor(F.col(value) / F.lit(bucket_width)))

    before = (Window.unboundedPreceding, -1)
    in_bucket = (
        Window.partitionBy(by, "_bucket").orderBy(F.col(value).desc_nulls_last()).rowsBetween(*before)
    )
    across = Window.partitionBy(by).orderBy(F.col("_bucket").desc_nulls_last()).rowsBetween(*before)

    offsets = (
        counted.groupBy(by, "_bucket")
        .agg(F.sum("_n").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(across), F.lit(0)))
        .select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), "_offset")
    )
    ranked = (
        counted.withColumn("_inner", F.coalesce(F.sum("_n").over(in_bucket), F.lit(0)))
        .join(
            offsets,
            F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_b")),
        )
        .select(
            F.col(by).alias("_by"),
            F.col(value).alias("_value"),
            (F.col("_inner") + F.col("_offset") + 1).cast("int").alias(alias),
        )
    )
    return df.join(
        ranked,
        F.col(by).eqNullSafe(F.col("_by")) & F.col(value).eqNullSafe(F.col("_value")),
        "left",
    ).drop("_by", "_value")
