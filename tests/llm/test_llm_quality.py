from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log

import numpy as np
import pytest
from llm_cases import DOCS, LABELS, TEXTS, clashing, documents, prose
from meterline.llm import quality_llr as Q

MASK = 2**64 - 1


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def slow_buckets(text):
    mix = 0x9E3779B97F4A7C15
    one = [
        zlib.crc32(t.encode()) * mix & MASK
        for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for t in re.findall(r"[^\W_]+|[\W_]+", w.lower())
    ]
    two = [(a ^ (b >> 7)) * mix & MASK for a, b in zip(one, one[1:])]
    return [h >> 47 for h in one + two]


def slow(rows, good):
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(slow_buckets(t))
        if i in good:
            target.update(slow_buckets(t))
    share = sum(target.values()) / sum(raw.values()) if target else 0
    out = []
    for i, t in rows:
        b = slow_buckets(t)
        s = sum(log((target[x] + Q.SMOOTH) / (raw[x] * share + Q.SMOOTH)) for x in b) / len(b) if b and target else 0.0
        base = slow_base(t)
        out.append((i, *base, s, not base[-1] and s >= Q.MIN_SCORE))
    return sorted(out, key=repr)


JUNK = [(50 + i, " ".join(w + "###" for w in prose(60 + i, i).split())) for i in range(6)] + [
    (60, "a b c d e a b c d e a b c d e f"),
    (61, "same line here\nsame line here\n \n \nother line of some more words here now yes no"),
    (62, "x\u00a0y\u2028z\x1cq | <b> a b c d e f g h i j k"),
]


@pytest.mark.parametrize("good", [{7, 3, 4, 8}, set()])
def test_equals_brute_force(spark, good):
    rows = TEXTS + JUNK
    labels = spark.createDataFrame([(i, 1, 0) for i in good] * 2 + [(50, 0, 1), (None, 1, 0), (51, None, None)], LABELS)
    got = sorted((tuple(r) for r in Q.judge(clashing(documents(spark, rows)), labels).collect()), key=repr)
    want = slow(rows, good)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(abs(a[7] - b[7]) < 1e-9 and a[8] == b[8] for a, b in zip(got, want))


def test_counts_on_given_documents(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:7] for r in Q.query(spark, tiny).collect()}
    assert got == {i: slow_base(t) for i, t in rows}


def test_labelled_documents_are_told_apart(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = Q.query(spark, small).collect()
    good = [r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in got if labels.get(r.doc_id) == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)


def test_tasks_send_a_row_for_each_share_of_the_buckets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(7)
    sums = Q.bucket_sums(docs, frozenset(range(0, 1000, 3)))
    rows = sums.collect()
    assert len(rows) == len({r.share for r in rows}) <= Q.BUCKETS // Q.SHARE
    got = {(r.share, i): n for r in rows for i, n in enumerate(np.frombuffer(r.sums, "<i8")) if n}
    want = Counter()
    for i, t in docs.select("doc_id", "text").collect():
        for b in slow_buckets(t):
            share, at = divmod(b, Q.SHARE)
            want[share, Q.SHARE + at] += 1
            want[share, at] += i in range(0, 1000, 3)
    assert got == {k: n for k, n in want.items() if n}
    plan = sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "HashAggregate" not in plan and plan.count("Exchange hashpartitioning(share") == 1


def test_empty(spark):
    assert Q.judge(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
