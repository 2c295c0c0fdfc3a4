"""Spelling variants: words of a corpus one edit apart, grouped under their frequent forms.

Near words are found by dynamic programming over sorted lists. A list is scanned in
order for a word; row d of the banded edit matrix holds the three cells around the
diagonal for the first d code points of a listed word. The next listed word reuses
the rows of the prefix that it shares with the one before. If no cell of row d is
one or less, all following words that share those d code points are skipped.

Lists are made so that tasks share nothing. Two words one edit apart, the shorter
of m code points, agree on all but one of ``SEGMENTS`` segments of m: left of the
edit counted from the start, right of it from the end. So each word is listed once
for each segment and for m its own length and one less, under what stands outside
the segment, and only the segment is compared. A pair is taken from the list of
the segment where the words first differ, so it is found once. Lists of more than
``LIST_LIMIT`` words are split again into segments of one code point; what is left
of those is one or two code points long, so their size is bounded by the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import LOWER, UPPER, arrow_schema, cut, table

#: Letters of a word, least code points, least occurrences.
LETTERS, LEAST_LENGTH, LEAST_COUNT = "A-Za-zÀ-ÿ", 7, 2
#: One in so many (document, word) pairs loses a code point where asked for.
EDITED = 31
#: How many times as frequent as a word its form is.
RATIO = 10
SEGMENTS, LIST_LIMIT = 3, 4096
#: Distinct words that a task counts before it hands them on.
MEMORY = 300_000

_LOWER = str.maketrans(UPPER, LOWER)
FAR = 2


def edited(word: str, h: int) -> str:
    """``word`` without one code point if ``EDITED`` divides the hash."""
    if h % EDITED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    edit: bool = False,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """word, n of the distinct letter runs of all texts, A-Z lower-cased.

    Tasks send counts of distinct words, never occurrences. With ``edit`` one in
    ``EDITED`` pairs of row id and word loses a code point (none where the id is null).
    """
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")
    schema = "word string, n long"
    arrow = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], schema=arrow
            )

        for part in batches:
            for key, value in zip(*(c.to_pylist() for c in part.columns)):
                if not value:
                    continue
                seed = zlib.crc32(f"{key}:".encode()) if edit and key is not None else None
                for word, n in Counter(run.findall(value)).items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    if seed is not None:
                        word = edited(word, zlib.crc32(word.encode(), seed))
                        if len(word) < least_length:
                            continue
                    seen[word] = seen.get(word, 0) + n
            if len(seen) > MEMORY:
                yield batch()
                seen.clear()
        if seen:
            yield batch()

    counted = docs.select(id_col, text).mapInArrow(count, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def listed(words: DataFrame, parts) -> DataFrame:
    """Rows of ``words`` under the key of each of ``parts`` segments of their open stretch.

    The stretch leaves out ``lo`` code points at the start and ``rest`` at the end of a
    word; ``m`` is the length of a list's shorter words, ``last`` tells whether the
    stretch goes on to their end.
    """
    size = F.col("m") - F.col("lo") - F.col("rest")
    cuts = words.withColumn("__size", size).withColumn("__parts", parts(F.col("__size")))
    cuts = cuts.withColumn("__no", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    at = lambda no: (F.col("lo") + F.floor(F.col("__size") * no / F.col("__parts"))).cast("int")
    cuts = cuts.select(
        "word",
        "n",
        "m",
        at(F.col("__no")).alias("lo"),
        (F.col("m") - at(F.col("__no") + 1)).alias("rest"),
        (F.col("last") & (F.col("__no") + 1 == F.col("__parts"))).alias("last"),
    )
    key = F.concat_ws(
        ":",
        "m",
        "lo",
        F.substring("word", F.lit(1), F.col("lo")),
        F.substring("word", F.length("word") - F.col("rest") + 1, F.col("rest")),
    )
    return cuts.withColumn("key", key)


def scan(words: list[str], size: int, last: bool) -> Iterator[tuple[int, int]]:
    """Index pairs of the sorted distinct ``words``, one edit apart, the first of ``size``
    code points and the second of as many or one more.

    Pairs of equal length come once, the smaller word first. A word that goes on
    where the other ends comes only from the ``last`` stretch.
    """
    n = len(words)
    shared = [0] * n
    for j in range(1, n):
        a, b = words[j - 1], words[j]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        shared[j] = k
    rows = [(FAR, 0, 1)] * (size + 2)  # cells d - 1, d and d + 1 of row d
    for i, query in enumerate(words):
        if len(query) != size:
            continue
        known, j = 0, 0  # rows of the word before that still hold
        while j < n:
            word = words[j]
            known = min(known, shared[j])
            d = known
            x, y, z = rows[d]
            length = len(word)
            while d < length:
                c = word[d]
                if d:
                    x = x if c == query[d - 1] else x + 1
                x = x if x <= y else y + 1
                if d < size:
                    y = y if c == query[d] else y + 1
                    y = min(y, z + 1, x + 1)
                    z = (z if c == query[d + 1] else z + 1) if d + 1 < size else FAR
                    z = z if z <= y else y + 1
                else:
                    y = z = FAR  # the word is longer than the query: only cell d - 1 is left
                d += 1
                if x > 1 and y > 1 and z > 1:
                    break
                rows[d] = (x, y, z)
            else:
                known = length
                if length == size:
                    if y == 1 and j > i:
                        yield i, j
                elif x == 1 and (last or not word.startswith(query)):
                    yield i, j
                j += 1
                continue
            known = d - 1
            j += 1
            while j < n and shared[j] >= d:
                j += 1


PAIRS = "a string, a_n long, b string, b_n long"


def _scanned(lists: DataFrame) -> DataFrame:
    """``PAIRS`` of all lists; a task holds one list at a time."""
    arrow = arrow_schema(PAIRS)

    def pairs(held: list[tuple], mark: tuple) -> Iterator[tuple]:
        m, lo, rest, last = mark
        cells = sorted((w[lo : len(w) - rest], w, n) for w, n in held)
        for i, j in scan([c[0] for c in cells], m - lo - rest, last):
            yield *cells[i][1:], *cells[j][1:]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key, mark, out = [], None, None, []
        for part in batches:
            for key, word, n, *of in zip(*(c.to_pylist() for c in part.columns)):
                if key != open_key:
                    if len(held) > 1:
                        out += pairs(held, mark)
                    held, open_key, mark = [], key, of
                held.append((word, n))
            if len(out) > 10_000:
                yield batch(out)
                out = []
        if len(held) > 1:
            out += pairs(held, mark)
        if out:
            yield batch(out)

    sent = lists.select("key", "word", "n", "m", "lo", "rest", "last").repartition("key").sortWithinPartitions("key")
    return sent.mapInArrow(run, PAIRS)


def near_pairs(
    words: DataFrame, segments: int = SEGMENTS, list_limit: int = LIST_LIMIT, least_length: int = LEAST_LENGTH
) -> DataFrame:
    """a, a_n, b, b_n of all pairs of ``words`` (word, n; distinct, ``least_length`` or longer)
    that differ by one inserted, deleted or replaced code point. Each pair comes once."""
    length = F.length("word")
    both = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    open_words = both.filter(F.col("m") >= least_length).select(
        "*", F.lit(0).alias("lo"), F.lit(0).alias("rest"), F.lit(True).alias("last")
    )
    lists = listed(open_words, lambda size: F.least(size, F.lit(segments)))
    # counts are combined in the tasks, so no frequent key is sent as rows here
    large = cut(lists.groupBy("key").count().filter(F.col("count") > list_limit).select("key"), "long-lists")
    again = lists.join(large, "key", "left_semi").drop("key")
    return _scanned(lists.join(large, "key", "left_anti")).unionByName(_scanned(listed(again, lambda size: size)))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent near word of each word, if it
    is ``ratio`` times as frequent; ties go to the smallest in code-point order."""
    side = lambda own, n, near, near_n: pairs.select(
        F.col(own).alias("word"),
        F.col(n).alias("n"),
        F.lit(1).cast("long").alias("one"),
        F.struct((-F.col(near_n)).alias("rank"), F.col(near).alias("form")).alias("near"),
    )
    alone = words.select("word", "n", F.lit(0).cast("long").alias("one"), F.lit(None).cast("struct<rank:long,form:string>").alias("near"))
    rows = alone.unionByName(side("a", "a_n", "b", "b_n")).unionByName(side("b", "b_n", "a", "a_n"))
    found = rows.groupBy("word").agg(
        F.max("n").alias("n"), F.sum("one").alias("n_near"), F.min("near").alias("near")
    )
    frequent = -F.col("near.rank") >= F.col("n") * ratio
    return found.select(
        "word",
        "n",
        "n_near",
        F.when(frequent, F.col("near.form")).alias("form"),
        F.when(frequent, -F.col("near.rank")).alias("form_n"),
    )


def rooted(found: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``found`` (see ``forms``, stored) with root, where the forms lead from each word.

    A form is ``ratio`` times as frequent as its word, so the logarithm of the largest
    count bounds the steps. A form has no more words than it has near words.
    """
    links = found.filter("form is not null").select("word", "form", "form_n")
    counts = found.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    steps, n = 0, (counts.least or 1) * ratio
    while counts.most and n <= counts.most:
        steps, n = steps + 1, n * ratio
    roots = links.select("word", F.col("form").alias("root"))
    following = links.select(F.col("word").alias("root"), F.col("form").alias("__next"))
    for _ in range(steps - 1):
        roots = roots.join(following, "root", "left").select("word", F.coalesce("__next", "root").alias("root"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    edit: bool = False,
    segments: int = SEGMENTS,
    list_limit: int = LIST_LIMIT,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of all texts.

    Null texts and texts without letters have no words. Repeated rows count each.
    Other columns are neither read nor returned. Empty in, empty out. A very long
    text is searched whole in the task that has it; only its distinct words of
    ``LEAST_LENGTH`` or more are held besides.
    """
    words = cut(vocabulary(docs, id_col, text, edit), "vocabulary")
    pairs = cut(near_pairs(words, segments, list_limit), "near-words")
    return rooted(cut(forms(words, pairs), "forms")).select("word", "form", "root", "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among all documents' words after the contract's edit."""
    return variants(table(spark, sf_dir, "documents"), edit=True)
