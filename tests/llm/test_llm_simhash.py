from __future__ import annotations

import random

import pytest
import xxhash
from llm_cases import DOCS, TEXTS, clashing, documents, prose
from meterline.llm import simhash_cover as S
from meterline.llm.components import components
from pyspark.sql import functions as F


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [slow_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, prints[i], least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_masks_cover_every_pair_within_the_radius():
    masks, rnd = S.masks(), random.Random(1)
    for _ in range(3000):
        flip = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4)))
        assert any(not flip & m for m in masks)


@pytest.mark.parametrize("limit", [S.BUCKET_LIMIT, 2])
def test_equals_brute_force(spark, limit):
    rows = TEXTS + [(100 + i, prose(60, 4) + f" tail{i}") for i in range(12)]
    got = S.near_duplicates(clashing(documents(spark, rows)), bucket_limit=limit).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == brute(rows)


def test_dense_cluster_beyond_the_limit(spark):
    rnd = random.Random(5)
    fps = {sum(1 << b for b in rnd.sample(range(60), rnd.randint(0, 3))) for _ in range(150)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for limit in (4, 1000):
        found = {r.node: r.root for r in components(S.links(df, limit)).collect()}
        assert {found.get(f, f) for f in fps} == {min(fps)}


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_survivors_keep_every_column(spark):
    docs = clashing(documents(spark)).withColumn("__row", F.col("doc_id")).withColumn("__id", F.lit("x"))
    got = S.survivors(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert sorted(rows, key=repr) == sorted({min(g, key=lambda i: (i is None, i)) for g in groups(spark)}, key=repr)
    assert all(r["__row"] == i and r["__id"] == "x" for i, r in rows.items())


def groups(spark):
    """Ids of each component of the odd documents."""
    out = {}
    for r in S.near_duplicates(documents(spark)).collect():
        out.setdefault(r.root, set()).add(r.doc_id)
    return out.values()
