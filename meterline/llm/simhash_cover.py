"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit SimHash. A covering family of 31 bit masks finds
all pairs within four bits: each bit position carries a non-zero vector of five
bits, and the mask of a vector v keeps the positions whose vector has an odd
product with v. Four differing positions give four linear conditions on v, so at
least one of the 31 non-zero v is orthogonal to all of them: under that mask the
two fingerprints are equal. No pair within the radius is lost, whatever its bits.

Equal fingerprints are collapsed first, so copies cost nothing further. Inside a
bucket the links are compared in the task and only a spanning forest leaves it,
never the pairs. Buckets over ``bucket_limit`` fingerprints are not compared at
all: their members meet at the points within two bits of each of them. Two
fingerprints share such a point exactly if they differ in four bits or fewer, so
this is linear in the members and as exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import cut, per_row, table
from meterline.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Most fingerprints of a bucket that are compared with each other in one task.
BUCKET_LIMIT = 8192
#: Parts into which a component's fingerprints are dealt when they learn its smallest id.
SALTS = 64


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of a whole text; 0 without words (null, empty, blank)."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, ASCII spaces split
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())),
        np.uint64,
        n,
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def masks() -> list[int]:
    """The 31 covering masks as unsigned 64-bit numbers, about half of the bits each."""
    vectors = [i % (2 ** (RADIUS + 1) - 1) + 1 for i in range(BITS)]
    odd = lambda x: x.bit_count() & 1
    return [
        sum(odd(vectors[i] & v) << i for i in range(BITS)) for v in range(1, 2 ** (RADIUS + 1))
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (the SimHash's bits as a signed long) of every row."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", fp long"
    return per_row(
        docs.select(*keys, text),
        schema,
        lambda: lambda *row: (*row[:-1], _signed(fingerprint(row[-1]))),
    )


def links(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, four bits apart at most,
    whose components are those of all links."""
    tables = F.explode(
        F.array(*[F.struct(F.lit(i).alias("no"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks())])
    )
    keyed = (
        prints.select("fp", tables.alias("t"))
        .select(F.col("t.no").alias("no"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp")
        .repartition("no", "key")
        .sortWithinPartitions("no", "key", "fp")
    )
    found = cut(keyed.mapInArrow(_Buckets(bucket_limit), "a long, b long"), "simhash-links")
    large = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    return found.filter("b is not null").unionByName(_meeting(large))


class _Buckets:
    """Streams sorted rows; each bucket gives a spanning forest of its links, or,
    beyond the limit, its members with a null partner."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # members so far of the bucket that is open
        size, large, last = 0, False, None
        for batch in batches:
            no, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fp):
                continue
            edge = np.flatnonzero((no[1:] != no[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *edge.tolist(), len(fp)]
            out_a, out_b = [], []
            for at, to in zip(bounds, bounds[1:]):
                if (mark := (no[at], key[at])) != last:
                    if size > 1 and not large:
                        self._close(held, out_a, out_b)
                    held, size, large, last = [], 0, False, mark
                size += to - at
                held.append(fp[at:to])
                if size > self.limit:  # its members go on one by one; nothing is kept
                    large = True
                    for part in held:
                        out_a += part.tolist()
                        out_b += [None] * len(part)
                    held = []
            if out_a:
                yield self._batch(out_a, out_b)
        out_a, out_b = [], []
        if size > 1 and not large:
            self._close(held, out_a, out_b)
        if out_a:
            yield self._batch(out_a, out_b)

    @staticmethod
    def _batch(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
        )

    @staticmethod
    def _close(held: list[np.ndarray], out_a: list, out_b: list) -> None:
        fps = np.concatenate(held)
        if len(fps) == 2:
            if np.bitwise_count(fps.view(np.uint64)[0] ^ fps.view(np.uint64)[1]) <= RADIUS:
                out_a.append(int(fps[0]))
                out_b.append(int(fps[1]))
            return
        # Breadth first: each member is compared once with those not reached yet.
        bits, left = fps.view(np.uint64), np.arange(len(fps))
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = np.bitwise_count(bits[left] ^ bits[at]) <= RADIUS
                new = left[near]
                if len(new):
                    out_a += [int(fps[at])] * len(new)
                    out_b += fps[new].tolist()
                    queue += new.tolist()
                    left = left[~near]


def _meeting(large: DataFrame) -> DataFrame:
    """Links of the members of large buckets through points two bits away at most."""
    flips = [0] + [
        _signed(sum(1 << i for i in which))
        for n in range(1, RADIUS // 2 + 1)
        for which in combinations(range(BITS), n)
    ]
    points = large.select(
        "fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"))
    return (
        points.join(hubs, "point").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    keys: tuple[str, ...] = (),
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keys``, ``fp``, ``root`` and ``component_id``, the
    smallest fingerprint and the smallest id reachable over links of four bits or fewer.

    A null or blank text has fingerprint zero and is linked like any other.
    Repeated rows each get a row. Rows with a null id count as no smaller id than
    any other; a component of null ids only has a null component_id. Other
    columns of ``docs`` are neither read nor returned. Empty in, empty out.
    """
    rows = cut(fingerprints(docs, [id_col, *keys], text), "simhash")
    prints = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-prints")
    roots = components(links(prints.select("fp"), bucket_limit))
    placed = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "root")
    placed = cut(placed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS))), "simhash-roots")
    # a large component's rows are spread over (root, salt); each of these is told once
    linked = placed.filter("root is not null")
    parts = linked.groupBy("root", "salt").agg(F.min("least").alias("least"))
    small = parts.groupBy("root").agg(F.min("least").alias("component_id"))
    told = linked.join(parts.select("root", "salt").join(small, "root"), ["root", "salt"])
    alone = placed.filter("root is null").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    named = told.select("fp", "root", "component_id").unionByName(alone)
    return rows.join(named, "fp").select(id_col, *keys, "fp", "root", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component of near-duplicates: that of the smallest id.

    Of rows that share that id, the one with the smallest hash of id and text stays,
    once; null ids come after all others. All columns of ``docs`` are kept, whatever
    their names. Empty in, empty out.
    """
    mark, own = (next(n for n in (f"__{c}{i or ''}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("row", "id"))
    keyed = docs.withColumn(mark, F.xxhash64(id_col, text))
    found = near_duplicates(keyed.select(id_col, text, mark), id_col, text, keys=(mark,))
    order = F.struct(F.col(id_col).isNull(), id_col, mark)
    first = found.groupBy("root").agg(F.min_by(F.struct(id_col, mark), order).alias("first"))
    chosen = cut(first.select(F.col(f"first.`{id_col}`").alias(own), F.col(f"first.`{mark}`").alias(mark)), "kept")
    rows = keyed.join(chosen, mark).filter(F.col(id_col).eqNullSafe(F.col(own)))
    return rows.dropDuplicates([mark, id_col]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
