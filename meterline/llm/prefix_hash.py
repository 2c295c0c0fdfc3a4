"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds, for two bases modulo 2^31 - 1, the hash of every prefix of a
text. From it the hash of any span is one subtraction and one product, two spans
are equal if their hashes are, and the longest common extension of two positions
is found by binary search. Hashes of concatenations follow from those of the
parts, so an edited text needs no arrays of its own. Long texts are hashed chunk
by chunk: 12 bytes a code point stay, the rest is as large as a chunk.

A fingerprint is the length and hash of the whole text and a sketch: the smallest
mixed hashes of its spans of ``SPAN`` code points. Likeness of two fingerprints is
the share of common spans that the sketches estimate (1 if the texts are equal).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.common import arrow_schema, cut, per_row, table

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 739_982_445)
SPAN, SKETCH = 16, 48
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Code points that are hashed at a time.
CHUNK = 1 << 18
_P, _S = np.uint64(PRIME), np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^62."""
    x = (x & _P) + (x >> _S)
    x = (x & _P) + (x >> _S)
    return np.where(x >= _P, x - _P, x)


class Powers:
    """Powers of the bases and of their inverses for one chunk of code points."""

    def __init__(self) -> None:
        n = CHUNK + SPAN
        self.inverse = [pow(b, -1, PRIME) for b in BASES]
        self.up = [self._table(b, n) for b in BASES]
        self.down = [self._table(b, n) for b in self.inverse]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate((out, _mod(out * np.uint64(pow(base, len(out), PRIME)))))
        return out[:n].copy()


class Prefix:
    """Prefix hashes of one text; ``powers`` is shared by all texts of a task.

    The arrays hold, for each chunk of ``CHUNK`` code points, the hashes of its own
    prefixes (4 bytes a code point and base); ``starts`` holds the hash of all that
    precedes each chunk. So the tables of powers are as long as a chunk, whatever
    the length of the text.
    """

    def __init__(self, text: str, powers: Powers) -> None:
        self.powers, self.n = powers, len(text)
        self.sums = [np.empty(self.n, np.uint32) for _ in BASES]
        self.starts = [[0] for _ in BASES]
        self.spans = np.empty(max(0, self.n - SPAN + 1), np.uint32)
        for at in range(0, self.n, CHUNK):
            end = min(at + CHUNK, self.n)
            part = text[at : end + SPAN - 1].encode("utf-32-le", "replace")
            codes = np.frombuffer(part, np.uint32).astype(np.uint64) + np.uint64(1)
            mixed = np.zeros(max(0, len(codes) - SPAN + 1), np.uint64)
            for k, (up, down) in enumerate(zip(powers.up, powers.down)):
                sums = np.zeros(len(codes) + 1, np.uint64)
                np.cumsum(_mod(codes * up[: len(codes)]), out=sums[1:])
                sums = _mod(sums)
                self.sums[k][at:end] = sums[1 : end - at + 1]
                shift = pow(BASES[k], at, PRIME)
                self.starts[k].append((self.starts[k][-1] + int(sums[end - at]) * shift) % PRIME)
                value = _mod((sums[SPAN:] + _P - sums[: len(mixed)]) * down[: len(mixed)])
                mixed = (mixed ^ value) * MIX[k]
                mixed ^= mixed >> np.uint64(32)
            self.spans[at : at + len(mixed)] = mixed

    def prefix(self, k: int, end: int) -> int:
        """Hash of the first ``end`` code points for base ``k``."""
        chunk, rest = divmod(end, CHUNK)
        if not rest:
            return self.starts[k][chunk]
        return (self.starts[k][chunk] + int(self.sums[k][end - 1]) * pow(BASES[k], chunk * CHUNK, PRIME)) % PRIME

    def span(self, start: int, end: int) -> int:
        """Hash of [start, end) as one number of 62 bits; equal spans, equal numbers."""
        out = 0
        for k, inverse in enumerate(self.powers.inverse):
            value = self.prefix(k, end) - self.prefix(k, start)
            out = out << 31 | value * pow(inverse, start, PRIME) % PRIME
        return out

    def joined(self, end: int, other: "Prefix", to: int) -> int:
        """Hash of this text's first ``end`` code points and the other's first ``to``."""
        out = 0
        for k, base in enumerate(BASES):
            out = out << 31 | (self.prefix(k, end) + pow(base, end, PRIME) * other.prefix(k, to)) % PRIME
        return out


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest common extension of a from i and b from j."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def smallest(spans: list[np.ndarray], whole: int, n: int) -> np.ndarray:
    """Sketch of the span hashes in ``spans``; a text shorter than a span is one span itself."""
    least = np.zeros(0, np.uint32)
    for part in spans:
        for at in range(0, len(part), CHUNK):
            more = part[at : at + CHUNK]
            if len(least) == SKETCH:
                more = more[more < least[-1]]
            more = np.sort(np.concatenate((least, more)))
            least = more[np.concatenate((np.ones(min(1, len(more)), bool), more[1:] != more[:-1]))][:SKETCH]
    if not len(least):
        return np.array([whole * 0x9E3779B97F4A7C15 >> 16 & 0xFFFFFFFF], np.uint32)[: min(n, 1)]
    return least


def pack(n: int, whole: int, sketch: np.ndarray) -> bytes:
    return n.to_bytes(8, "big") + whole.to_bytes(8, "big") + sketch.astype(">u4").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: estimated share of common spans of two packed fingerprints."""
    if a[:16] == b[:16]:
        return 1.0
    x, y = np.frombuffer(a, ">u4", offset=16), np.frombuffer(b, ">u4", offset=16)
    both = np.sort(np.concatenate((x, y)).astype(np.uint32))
    if not len(both):
        return 1.0
    same = both[1:] == both[:-1]
    union = both[np.concatenate(([True], ~same))]
    # a sketch that is not full holds all spans of its text
    top = union[min(len(union), SKETCH) - 1]
    return float((both[1:][same] <= top).sum() / min(len(union), SKETCH))


class Document:
    """A text with its arrays, span hashes and packed fingerprint."""

    def __init__(self, text: str | None, powers: Powers) -> None:
        self.text = text or ""
        self.prefix = Prefix(self.text, powers)
        self.n, self.whole = self.prefix.n, self.prefix.span(0, self.prefix.n)
        self.print = pack(self.n, self.whole, smallest([self.prefix.spans], self.whole, self.n))

    def edited(self, after: "Document") -> tuple[str, bytes]:
        """Text and fingerprint with the last half replaced by the next text's beginning."""
        half = self.n // 2
        keep, to = self.n - half, min(half, after.n)
        text = self.text[:keep] + after.text[:to]
        whole = self.prefix.joined(keep, after.prefix, to)
        # spans over the seam come from a short text of their own
        seam = Prefix(text[max(0, keep - SPAN + 1) : keep + SPAN - 1], self.prefix.powers)
        kept, more = self.prefix.spans[: max(0, keep - SPAN + 1)], after.prefix.spans[: max(0, to - SPAN + 1)]
        return text, pack(len(text), whole, smallest([kept, seam.spans, more], whole, len(text)))

    def row(self, after: "Document") -> tuple:
        text, packed = self.edited(after)
        return (
            self.n,
            hashlib.sha256(text.encode("utf-8", "replace")).digest(),
            self.print,
            packed,
            likeness(self.print, packed),
            likeness(self.print, after.print),
            common_extension(self.prefix, 0, after.prefix, 0),
        )


RESULT = "n_chars long, sha binary, print binary, edited binary, near_edited double, near_next double, common_start long"
_EMPTY = (None,) * 7


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, ``RESULT``, kind, pid, text: one shuffle of the texts, in order of doc_id.

    In ascending order the next document of descending order is the one just
    passed, so each task needs one document besides the current one. Rows of a
    task's first id have it in another task: they come out as kind 1 with their
    text, and each task's last document as kind 2.
    """
    kind_of = dict(docs.dtypes)["doc_id"]
    schema = f"kind int, pid int, doc_id {kind_of}, {RESULT}, text string"

    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, powers = TaskContext.get().partitionId(), Powers()
        last = current = key = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow
            )

        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                doc = Document(text, powers)
                if current is None or doc_id != key:
                    last, current, key = current, doc, doc_id
                if last is None:
                    rows.append((1, pid, doc_id, *_EMPTY, doc.text))
                else:
                    rows.append((0, pid, doc_id, *doc.row(last), None))
            if rows:
                yield batch_of(rows)
        if current is not None:
            yield batch_of([(2, pid, None, *_EMPTY, current.text)])

    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return cut(ordered.mapInArrow(run, schema), "prefix-hash")


def _over_edges(found: DataFrame) -> DataFrame:
    """Rows of kind 1 with the last document of the partition before (or the last of all)."""
    ends = found.filter("kind = 2").select(F.col("pid").alias("end"), F.col("text").alias("after"))
    # one number for each partition
    order = ends.select(
        F.col("end").alias("pid"),
        F.coalesce(F.lag("end").over(Window.orderBy("end")), F.max("end").over(Window.partitionBy())).alias("end"),
    )
    pairs = found.filter("kind = 1").select("pid", "doc_id", "text").join(order, "pid").join(ends, "end")

    def make():
        powers = Powers()
        return lambda doc_id, text, after: (doc_id, *Document(text, powers).row(Document(after, powers)))

    kind_of = dict(found.dtypes)["doc_id"]
    return per_row(pairs.select("doc_id", "text", "after"), f"doc_id {kind_of}, {RESULT}", make)


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The next document is that of the next smaller doc_id, after the smallest that
    of the largest. Null texts count as empty; two empty texts are alike (1).
    Rows of equal doc_id each get a row, and the smallest of their texts stands
    for them as a next document. A null doc_id is smaller than all others. A
    single document is its own next one. Other columns are not read. An empty table
    gives no row. A task holds a very long text, the one before it and the edited
    one with 12 bytes a code point each of the first two (texts of 25 million code
    points: 0.6 GB); a cell of over 2 GB is beyond what Spark hands to Python.
    """
    found = fingerprints(docs)
    names = [c for c in found.columns if c not in ("kind", "pid", "text")]
    rows = found.filter("kind = 0").select(*names).unionByName(_over_edges(found))

    def shown(c: str):
        text = F.lower(F.hex(c))
        return F.concat_ws("-", F.substring(text, 1, 16), F.substring(text, 17, 16), F.substring(text, 33, 8 * SKETCH))

    return rows.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        shown("print").alias("fingerprint"),
        shown("edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "common_start",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))
