"""Output folders of micro-batches, and compacted copies that stand for the oldest of them.

A batch is stored under its number, so a batch that is retried replaces itself. A
compacted copy names the last batch it covers. Readers take the newest complete
copy and the complete batches after it; a folder is complete once its job has
committed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

NUMBER = "batch_id"
_NAME = re.compile(r"(batch_id|upto)=(\d+)")


def store(batch: DataFrame, target: str, number: int) -> None:
    """Write one batch; its rows carry the number."""
    rows = batch.withColumn(NUMBER, F.lit(number).cast("bigint"))
    rows.write.mode("overwrite").parquet(f"{target}/batch_id={number:010d}")


def complete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _found(spark: SparkSession, target: str) -> tuple[int, str | None, dict[int, str]]:
    """Last compacted batch, its folder, and the folders of later batches."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
    kinds: dict[str, dict[int, str]] = {"batch_id": {}, "upto": {}}
    for name in names:
        if (m := _NAME.fullmatch(name)) and complete(spark, f"{target}/{name}"):
            kinds[m[1]][int(m[2])] = f"{target}/{name}"
    last = max(kinds["upto"], default=-1)
    return last, kinds["upto"].get(last), {n: f for n, f in kinds["batch_id"].items() if n > last}


def load(spark: SparkSession, target: str) -> DataFrame | None:
    """Rows of all stored batches with their number; None before the first one."""
    _, compacted, later = _found(spark, target)
    folders = [compacted, *later.values()] if compacted else list(later.values())
    # batch folders hold their number as a column too; reading leaves alone takes that one
    return spark.read.parquet(*folders) if folders else None


def compact(spark: SparkSession, target: str, merge: Callable[[DataFrame], DataFrame]) -> int:
    """Write what ``merge`` makes of all stored rows as one copy; the last batch it covers.

    ``merge`` keeps the number column. Nothing changes for readers but the files they
    open. A copy that fails leaves the batches in place; running it again replaces it.
    """
    last, _, later = _found(spark, target)
    if not later:
        return last
    upto = max(later)
    merge(load(spark, target)).write.mode("overwrite").parquet(f"{target}/upto={upto:010d}")
    return upto
