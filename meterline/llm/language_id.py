"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text,
everything but letters being one space. Document frequencies cover all training
documents. The weights are fitted by follow-the-regularised-leader (per
coordinate step sizes, L1 and L2 penalties) on a bounded sample of them; a
temperature, fitted on training documents that gave no gradient, then makes the
scores honest. Documents of the held-out fifth are never read while fitting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.common import cut, held_out, per_row, table

BUCKETS, ORDERS = 1 << 16, 3
#: Bound of the fitted sample: distinct rows of each language, those of the smallest hash of id and text.
SAMPLE = 800
#: Follow-the-regularised-leader: step size, its offset, penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.05, 0.05, 3
UNKNOWN = "und"
_SHIFT = np.uint32(32 - (BUCKETS.bit_length() - 1))


def _fold_table() -> np.ndarray:
    """Lower-case letter of each code point, the space of all others."""
    fold = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            fold[c] = ord(low) if len(low := s.lower()) == 1 else c
    return fold


class Grams:
    """Bucket counts of a text's character n-grams."""

    def __init__(self) -> None:
        self.fold = _fold_table()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Buckets and counts; None if the text has no letter."""
        if not text:
            return None
        x = self.fold[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        space = x == 32
        if space.all():
            return None
        x = np.concatenate(([32], x[~space | np.concatenate(([True], ~space[:-1]))], [32])).astype(np.uint32)
        sums, key = np.zeros(BUCKETS, np.int64), x
        for order in range(ORDERS):
            if order:
                key = key[:-1] * np.uint32(0x01000193) + x[order:]
            mixed = key * np.uint32(0x9E3779B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            sums += np.bincount(mixed >> _SHIFT, minlength=BUCKETS)
        at = np.flatnonzero(sums)
        return at, sums[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, float32
    temperature: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        value = np.log1p(counts) * self.idf[at]
        return value / (np.sqrt((value**2).sum()) or 1.0)

    def probabilities(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _softmax(self.vector(at, counts) @ self.weights[at] / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int) -> np.ndarray:
    """Weights after ``PASSES`` passes over (buckets, values) with their classes."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def current(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(PASSES):
        for (at, value), label in zip(rows, labels):
            z_at, n_at = z[at], n[at]
            w = current(z_at, n_at)
            error = _softmax(value @ w)
            error[label] -= 1.0
            g = value[:, None] * error
            more = n_at + g * g
            z[at] = z_at + g - (np.sqrt(more) - np.sqrt(n_at)) / ALPHA * w
            n[at] = more
    return current(z, n).astype(np.float32)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, on a fine geometric grid.

    Targets are smoothed as if one more document were wrong, so a fold without
    errors does not make every score one.
    """
    n, classes = logits.shape
    if not n or classes < 2:
        return 1.0
    target = np.full((n, classes), 1 / (n + 2) / (classes - 1))
    target[np.arange(n), labels] = 1 - 1 / (n + 2)
    grid = np.geomspace(0.02, 20.0, 200)
    cost = [-(target * np.log(_softmax(logits / t) + 1e-12)).sum() for t in grid]
    return float(grid[int(np.argmin(cost))])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from text and non-null lang of documents outside the held-out fifth;
    None if there is no such document with a letter."""
    train = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    rows = train.select("doc_id", "lang", "text", fold.alias("fold"), F.xxhash64("doc_id", "text").alias("order"))
    # Of each language's hashes only the lowest share, four times what is needed, gets to
    # the ranking: its size depends on the sample, not on the input or its partitions.
    # Repeated rows count once and are merged before they are sent. The sizes are
    # written first: a table known to be small joins without a shuffle.
    sizes = cut(rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("n")), "language-sizes")
    share = F.col("order") / F.lit(2.0**64) + 0.5
    by_lang = Window.partitionBy("lang").orderBy("order", "doc_id")
    sampled = cut(
        rows.join(sizes, "lang")
        .filter(share * F.col("n") <= 4 * sample + 100)
        .groupBy("lang", "order", "doc_id")
        .agg(F.min("fold").alias("fold"), F.min("text").alias("text"))
        .withColumn("no", F.row_number().over(by_lang))
        .filter(F.col("no") <= sample)
        .select("order", "doc_id", "lang", "fold", "text"),
        "language-sample",
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums, n = Grams(), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if found := grams(text):
                    sums[found[0]] += 1
                    n += 1
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*some.tolist(), -1]), pa.array([*sums[some].tolist(), n])], names=["bucket", "docs"]
        )

    counted = (
        train.select("text")
        .mapInArrow(frequencies, "bucket long, docs long")
        .groupBy("bucket")
        .agg(F.sum("docs").alias("docs"))
        .toPandas()  # one row a bucket at most
    )
    total = int(counted.docs[counted.bucket == -1].sum())
    if not total:
        return None
    frequency = np.zeros(BUCKETS)
    some = counted[counted.bucket >= 0]
    frequency[some.bucket] = some.docs
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows = Grams(), []
        for batch in batches:
            for order, doc_id, lang, fold, text in zip(*(c.to_pylist() for c in batch.columns)):
                if found := grams(text):
                    rows.append((fold, (order, doc_id), lang, found))
        if not rows:
            return
        # an order that mixes languages and does not depend on how rows arrived
        rows.sort(key=lambda r: r[1:3])
        languages = sorted({r[2] for r in rows})
        model = Model(languages, idf, np.zeros((1, 1)), 1.0)
        data = [(r[3][0], model.vector(*r[3])) for r in rows]
        labels = [languages.index(r[2]) for r in rows]
        used = [i for i, r in enumerate(rows) if r[0] != 1] or list(range(len(rows)))
        w = follow_the_leader([data[i] for i in used], [labels[i] for i in used], len(languages))
        kept = [i for i, r in enumerate(rows) if r[0] == 1]
        logits = np.array([data[i][1] @ w[data[i][0]] for i in kept]).reshape(len(kept), len(languages))
        t = temperature(logits, np.array([labels[i] for i in kept], np.int64))
        at, of = np.nonzero(w)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*[languages[i] for i in of.tolist()], *languages, None]),
                pa.array([*at.tolist(), *[-1] * len(languages), -2]),
                pa.array([*w[at, of].astype(float).tolist(), *[0.0] * len(languages), t]),
            ],
            names=["lang", "bucket", "weight"],
        )

    # only the sample's rows, ``sample`` a language, meet in one task
    fitted = sampled.repartition(1).mapInArrow(learn, "lang string, bucket long, weight double").toPandas()
    if not len(fitted):
        return None
    languages = sorted(fitted.lang[fitted.bucket == -1])
    weights = np.zeros((BUCKETS, len(languages)), np.float32)
    of = {name: i for i, name in enumerate(languages)}
    real = fitted[fitted.bucket >= 0]
    weights[real.bucket, real.lang.map(of)] = real.weight
    return Model(languages, idf, weights, float(fitted.weight[fitted.bucket == -2].iloc[0]))


def predict(docs: DataFrame, model: Model | None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, lang_pred and score of every row of ``docs``, from its whole text.

    A null text or one without a letter is ``und`` with score 0, and so is every
    text if nothing could be learnt. Repeated rows each get a row, null ids too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the languages

    def make():
        grams, model = Grams(), sent.value

        def row(*values):
            found = grams(values[-1]) if model else None
            if found is None:
                return (*values[:-1], UNKNOWN, 0.0)
            p = model.probabilities(*found)
            best = int(p.argmax())
            return (*values[:-1], model.languages[best], float(p[best]))

        return row

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "lang_pred string, score double"
    return per_row(docs.select(*keys, "text"), schema, make)


def certain(spark: SparkSession, model: Model | None, least: float):
    """For ``where_text``: texts whose predicted language scores ``least`` or more."""
    sent = spark.sparkContext.broadcast(model)

    def make():
        grams, model = Grams(), sent.value

        def keep(text: str | None) -> bool:
            found = grams(text) if model else None
            return found is not None and float(model.probabilities(*found).max()) >= least

        return keep

    return make


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; see ``fit`` and ``predict``."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
