"""Small tables with the odd rows that every operator must handle."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"

WORDS = "the quick brown fox jumps over a lazy dog while seven green birds sing loud songs about rivers".split()


def prose(n: int, shift: int = 0) -> str:
    of = random.Random(shift)
    return " ".join(of.choice(WORDS) + ("." if i % 11 == 10 else "") for i in range(n))


TEXTS = [
    (7, prose(120, 1)),
    (3, prose(120, 1)),  # a copy
    (5, prose(120, 1) + " end"),  # a near copy
    (9, None),
    (1, ""),
    (2, " \n\t "),
    (None, prose(40, 3)),
    (4, prose(30, 5)),
    (4, prose(30, 5)),  # a repeated row
    (6, "Émile wrote “naïve café” x = 12 🙂 ŒUVRE"),
    (8, "word " * 3000 + prose(5000, 2)),  # very long
]


def documents(spark, rows=TEXTS):
    data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(data, DOCS)


def clashing(df):
    """The same rows with columns named like those that operators make."""
    names = ("fp", "root", "score", "kept", "piece", "block", "word", "kind", "pid", "payload", "host", "tokens", "first", "ids")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
