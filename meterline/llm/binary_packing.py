"""Packing by power-of-two decomposition: no sequence crosses documents, none is padded.

A document's ids are split into as many full pieces as it holds and then into
pieces whose lengths are the powers of two of what is left, in falling order. Each
piece is a sequence by itself. Sequences of equal length form a bucket, where they
are numbered without gaps, so a trainer can cut a bucket into batches of a fixed
number of tokens.

Documents are read once and nothing but the numbers of pieces is written. Tasks
number the pieces of a bucket by themselves; what precedes a task in a bucket
comes from the counts of the tasks, one row a task and bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.common import WordTable, cut, table
from meterline.llm.vector_packing import MEMORY, WordIds

#: Longest sequence (a power of two) and the id that ends a document.
CAPACITY, END = 4096, 2
#: Tokens of a batch of equal sequences.
BATCH = 1 << 16


def decompose(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, then the binary digits of the rest."""
    whole = n // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    start, bit = whole * capacity, capacity >> 1
    while start < n:
        if (n - start) & bit:
            out.append((start, bit))
            start += bit
        bit >>= 1
    return out


def pieces(
    docs: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    path: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """``keys``, start, length, ids_crc32, doc_tokens, bucket, task, no [, ids] of every row's pieces.

    A row's ids are those of its text (null: none) and then ``end``. ``bucket`` is the
    binary logarithm of the length; ``no`` numbers a task's pieces of a bucket from 0.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kinds = dict(docs.dtypes)
    new = ["start", "length", "ids_crc32", "doc_tokens", "bucket", "task", "no"]
    if taken := {*new, "ids"} & set(keys):
        raise ValueError(f"key columns {sorted(taken)} have names of the result")
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    schema += "start long, length long, ids_crc32 long, doc_tokens long, bucket int, task long, no long"
    types = {"bucket": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(WordIds(path), np.uint32, MEMORY)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        below = [decompose(n, capacity) for n in range(capacity)]
        count = [0] * capacity.bit_length()
        for batch in batches:
            of, rows, ids_of = [], [], []
            for at, text in enumerate(batch.column(len(keys)).to_pylist()):
                ids = words.gather(words.numbers((text or "").encode().split()))
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                n, flat = len(ids), ids.tobytes()
                cuts = below[n] if n < capacity else decompose(n, capacity)
                for start, length in cuts:
                    bucket = length.bit_length() - 1
                    crc = zlib.crc32(flat[4 * start : 4 * (start + length)])
                    rows.append((start, length, crc, n, bucket, task, count[bucket]))
                    count[bucket] += 1
                    if with_ids:
                        ids_of.append(ids[start : start + length].astype(np.int32))
                of += [at] * len(cuts)
            if rows:
                own = batch.select(range(len(keys))).take(pa.array(of)).columns
                made = [pa.array(c, types.get(k, pa.int64())) for k, c in zip(new, zip(*rows))]
                more = [pa.array(ids_of, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*own, *made, *more], names=[*keys, *new] + ["ids"] * with_ids)

    return docs.select(*keys, "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)


def number(found: DataFrame, batch: int = BATCH) -> DataFrame:
    """``found`` (see ``pieces``) without task and no, with sequence_id, offset, place and batch.

    ``place`` numbers the sequences of a bucket from 0 without gaps; ``batch`` numbers
    groups of them that hold ``batch`` tokens (at least one sequence). Sequence ids
    hold the bucket in their lowest six bits. Empty in, empty out.
    """
    found = cut(found, "binary-pieces")
    counts = found.groupBy("bucket", "task").agg(F.max("no").alias("__last"))
    before = Window.partitionBy("bucket").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        "bucket", "task", F.coalesce(F.sum(F.col("__last") + 1).over(before), F.lit(0)).alias("__first")
    )
    kept = [c for c in found.columns if c not in ("task", "no")]
    size = F.greatest(F.lit(1), F.floor(F.lit(batch) / F.col("length"))).cast("long")
    return (
        found.join(first, ["bucket", "task"])
        .withColumn("place", F.col("__first") + F.col("no"))
        .select(
            *kept,
            (F.shiftleft("place", 6) + F.col("bucket")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
            "place",
            F.floor(F.col("place") / size).cast("long").alias("batch"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces; each is a sequence whose length is a power of two.

    A null or empty text is the end id alone. Repeated rows are split each by
    itself; null ids are kept. Other columns are not read. An empty table gives no
    row. A task holds one text's ids, 4 bytes an id, and about 60 bytes for each of
    its words, whatever the number of texts.
    """
    return number(pieces(table(spark, sf_dir, "documents")))
