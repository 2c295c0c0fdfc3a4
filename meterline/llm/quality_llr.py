"""Quality rules: base counts of every text, and a hashed n-gram likelihood ratio.

Words are cut into runs of letters and digits and runs of other characters; the
tokens and pairs of neighbouring tokens are hashed into ``BUCKETS`` buckets. Two
multinomials are counted over them: the trusted target (documents labelled of
quality 1) and the raw corpus (every document). A document's score is the mean
log ratio of its n-grams under both, so long and short texts compare; the same
fixed threshold decides every document. Both counts are smoothed by the same
pseudo count after the raw one is scaled to the target's size: where a bucket has
seen little, its ratio stays near one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import WHITE, WordTable, per_row, table

BUCKETS = 1 << 17
#: Neighbouring buckets whose sums a task sends as one row. A row for each bucket would
#: be a hundred thousand rows a task, however little text the task has read.
SHARE = 64
#: Pseudo count of every bucket in both multinomials.
SMOOTH = 20.0
#: Documents whose mean log ratio is below this are not kept.
MIN_SCORE = -0.2
#: Bound of the sample of trusted documents; those of the smallest hash of doc_id.
MAX_TRUSTED = 50_000

# Characters that count as symbols; words under which, and share of
# repeated words (in hundredths) over which, the base rules fail a document.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

_TOKEN = re.compile(r"[^\W_]+|[\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[bytes]) -> list[list[int]]:
    return [[zlib.crc32(t.encode()) for t in _TOKEN.findall(w.decode().lower())] for w in words]


def token_table() -> WordTable:
    """Hashed tokens of each distinct word."""
    return WordTable(_hashes, np.uint64)


def buckets(tokens: np.ndarray) -> np.ndarray:
    """Buckets of the single tokens and of the pairs of neighbours of a text."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    one = tokens * _MIX
    two = (one[:-1] ^ (one[1:] >> np.uint64(7))) * _MIX
    return (np.concatenate((one, two)) >> shift).astype(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at the six ASCII spaces only


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    numbers = numbers.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for i in range(window):
            key = (key ^ (key >> np.uint64(29))) * _MIX + numbers[i : i + n] * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(twice), 1)
    np.add.at(inside, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(inside) > 0).sum())


def base_counts(text: str | None, words: list[bytes], numbers: np.ndarray) -> tuple:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(WHITE):
            seen.add(line)
    return (
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        repeats,
        repeated_words(numbers),
    )


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> list[int]:
    """At most ``most`` ids of documents labelled of quality 1, by the hash of the id."""
    ids = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    rows = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return [r[0] for r in rows]


def _rows(shares: Iterable[int], sums: Iterable[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shares, pa.int32()), pa.array([s.astype("<i8").tobytes() for s in sums], pa.binary())],
        names=["share", "sums"],
    )


def bucket_sums(docs: DataFrame, trusted: frozenset[int]) -> DataFrame:
    """share, sums: the n-grams in each bucket of a share, of trusted and of all documents.

    One pass over all texts; a task sends ``BUCKETS // SHARE`` rows at most, and a
    task that adds them up holds one row of each share dealt to it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = token_table(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                at = buckets(tokens.gather(tokens.numbers(_words(text))))
                if len(at) > BUCKETS // 8:
                    sums[1] += (new := np.bincount(at, minlength=BUCKETS))
                    if doc_id in trusted:
                        sums[0] += new
                else:
                    np.add.at(sums[1], at, 1)
                    if doc_id in trusted:
                        np.add.at(sums[0], at, 1)
        some = np.flatnonzero(sums[1].reshape(-1, SHARE).any(axis=1))
        yield _rows(some, sums.reshape(2, -1, SHARE).transpose(1, 0, 2)[some])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for share, sums in zip(*(c.to_pylist() for c in batch.columns)):
                total[share] = total.get(share, 0) + np.frombuffer(sums, "<i8")
        yield _rows(list(total), total.values())

    kinds = "share int, sums binary"
    counted = docs.select("doc_id", "text").mapInArrow(count, kinds)
    return counted.repartition("share").mapInArrow(add, kinds)


def ratios(docs: DataFrame, labels: DataFrame, most: int = MAX_TRUSTED) -> np.ndarray:
    """Log ratio of each bucket; the driver gets the sums of all buckets, whatever the input."""
    sums = np.zeros((BUCKETS // SHARE, 2, SHARE))
    for share, row in bucket_sums(docs, frozenset(trusted_ids(labels, most))).collect():
        sums[share] = np.frombuffer(row, "<i8").reshape(2, SHARE)
    target, raw = sums.transpose(1, 0, 2).reshape(2, BUCKETS)
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTH) / (raw * (target.sum() / raw.sum()) + SMOOTH))


class Judge:
    """Base counts, score and verdict of texts; one for each task."""

    def __init__(self, ratio: np.ndarray, min_score: float) -> None:
        self.tokens, self.ratio, self.min_score = token_table(), ratio, min_score

    def __call__(self, text: str | None) -> tuple:
        words = _words(text)
        numbers = self.tokens.numbers(words)
        base = base_counts(text, words, numbers)
        failed = len(words) < LEAST_WORDS or 100 * base[-1] > MOST_REPEATED * len(words)
        at = buckets(self.tokens.gather(numbers))
        score = float(self.ratio[at].mean()) if len(at) else 0.0
        return (len(words), *base, failed, score, not failed and score >= self.min_score)


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    min_score: float = MIN_SCORE,
    most_trusted: int = MAX_TRUSTED,
) -> DataFrame:
    """``keys``, the base counts, base_failed, score and kept of every row of ``docs``.

    A null, empty or blank text has no words and fails the base rules. Rows
    repeat in the result as in ``docs``; null ids are judged like others. Without
    documents of quality 1 every score is 0. A text whose words give no n-gram has
    score 0. Other columns are not read. Empty in, empty out.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(ratios(docs, labels, most_trusted))

    def make():
        of = Judge(ratio.value, min_score)
        return lambda *values: (*values[:-1], *of(values[-1]))

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + COLUMNS
    return per_row(docs.select(*keys, "text"), schema, make)


def keeper(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE):
    """For ``where_text``: texts that ``judge`` would keep, by the counts of ``docs``."""
    ratio = docs.sparkSession.sparkContext.broadcast(ratios(docs, labels))

    def make():
        of = Judge(ratio.value, min_score)
        return lambda text: of(text)[-1]

    return make


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
