"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.session import shared_folder

#: ASCII white space: what separates words.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once a session.

    Tasks import it, and a cluster's machines need not have it installed.
    """
    context = spark.sparkContext
    if getattr(context, "_meterline_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="meterline-")) / "meterline.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    context._meterline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back.

    Later readers start from these files: they neither repeat the work nor
    depend on an executor that may be lost.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def per_row(
    df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple | None]]
) -> DataFrame:
    """One output row for each input row, computed in Python inside the task.

    ``make`` runs once a task and gives the function of a row; that function gets
    the row's columns in order and returns the output columns (None: no row).
    Batches go out as they come in, so a task holds one batch at a time.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = [r for r in map(row, *columns) if r is not None]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def where_text(docs: DataFrame, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text passes the predicate that
    ``make`` gives each task. Nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            yield batch.filter(pa.array([bool(keep(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of documents that no model learns from."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


class _Numbered(dict):
    """Gives each new key the next number and notes it in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, key):
        self[key] = no = len(self)
        self.fresh.append(key)
        return no


class WordTable:
    """Numbers (hashes, token ids) of distinct words, and their concatenation for a text.

    ``learn`` gives the numbers of a list of new words. A task's table starts
    afresh beyond ``limit`` words, so its memory does not grow with the input.
    """

    def __init__(self, learn: Callable[[list[bytes]], list], dtype, limit: int = 400_000) -> None:
        self.learn, self.dtype, self.limit = learn, dtype, limit
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbered()
        self.at = np.zeros(1 << 12, np.int64)  # where word i begins; word i + 1 ends it
        self.flat = np.zeros(1 << 13, self.dtype)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """A number of each word; until the next call, equal numbers mean equal words."""
        if len(self.number) > self.limit:
            self._clear()
        no = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if new := self.number.fresh:
            self.number.fresh = []
            values = self.learn(new)
            ends = self.at[no] + np.cumsum(np.fromiter(map(len, values), np.int64, len(new)))
            while len(self.at) < no + len(new) + 1:
                self.at = np.concatenate((self.at, np.zeros_like(self.at)))
            while len(self.flat) < ends[-1]:
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.at[no + 1 : no + len(new) + 1] = ends
            self.flat[self.at[no] : ends[-1]] = np.fromiter(chain.from_iterable(values), self.dtype, ends[-1] - self.at[no])
        return found

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The words' values one after the other."""
        first = self.at[numbers]
        size = self.at[numbers + 1] - first
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, self.dtype)
        return self.flat[np.arange(ends[-1]) + np.repeat(first - ends + size, size)]
