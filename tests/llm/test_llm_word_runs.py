from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, TEXTS, clashing, documents, prose
from meterline.llm import word_runs as W


def slow_runs(words):
    """Every stretch of equal words p apart, for every p."""
    n, out, seen = len(words), [], set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if length >= max(6, 4 * p) and (start, length) not in seen:
                seen.add((start, length))
                out.append((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def shown(rows):
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    return sorted((tuple(r[c] for c in names) for r in rows), key=repr)


def test_the_cover_meets_every_difference():
    assert {(a - b) % W.V for a in W.COVER for b in W.COVER} == set(range(W.V))
    for a in range(W.V):
        for b in range(W.V):
            step = W.STEPS[a, b]
            assert (a + step) % W.V in W.COVER and (b + step) % W.V in W.COVER


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=400), st.integers(1, 60))
def test_extensions_equal_plain_comparison(codes, unit):
    codes = np.array((codes[:unit] * 9 + codes) if unit % 2 else codes, np.int32)
    n, lce = len(codes), W.Extensions(codes)
    rnd = random.Random(n)
    pairs = [(i, j) for i, j in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(60)) if i != j]
    if not pairs:
        return
    i, j = (np.array(x) for x in zip(*pairs))
    want = []
    for a, b in pairs:
        k = 0
        while max(a, b) + k < n and codes[a + k] == codes[b + k]:
            k += 1
        want.append(k)
    assert lce.lce(i, j).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=8))
def test_runs_equal_plain_enumeration(parts):
    codes = [c for unit, times in parts for c in unit * times]
    assert W.find_runs(np.array(codes, np.int32)) == slow_runs(codes)


def test_runs_of_texts_beyond_the_prepared_grid(monkeypatch):
    rnd = random.Random(5)
    codes = [rnd.randrange(3) for _ in range(1500)] + [1, 2, 3, 4, 5, 6, 7] * 90 + [0] * 700
    want = slow_runs(codes)
    assert W.find_runs(np.array(codes, np.int32)) == want
    monkeypatch.setattr(W, "PREPARED", 64)
    monkeypatch.setattr(W, "CHUNK", 500)
    assert W.find_runs(np.array(codes, np.int32)) == want


def test_a_very_long_text_of_one_word():
    n = 400_000
    assert W.find_runs(np.zeros(n, np.int32)) == [(0, n, 1)]


def test_query_equals_brute_force(spark, tmp_path):
    more = [(i, prose(30 + i % 7, i) + " go go go go go go now" * (i % 3)) for i in range(100, 400)]
    clashing(documents(spark, TEXTS + more)).write.parquet(str(tmp_path / "documents.parquet"))
    got = W.query(spark, str(tmp_path)).collect()
    want = [slow_row(i, t) for i, t in TEXTS[:-1] + more]
    assert shown(r for r in got if r.doc_id != 8) == sorted(want, key=repr)
    long = next(r for r in got if r.doc_id == 8)
    assert (long.start, long.length, long.period, long.exponent_milli) == (0, 3000, 1, 3_000_000)


def test_query_on_the_given_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) <= 1500}
    got = shown(r for r in W.query(spark, tiny).collect() if r.doc_id in short)
    assert got == sorted((slow_row(i, t) for i, t in short.items()), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in short) > 5


def test_runs_are_listed(spark):
    got = W.runs(documents(spark, [(1, "a b " * 6 + "c"), (2, None), (3, "x")])).collect()
    assert [tuple(r) for r in got] == [(1, 0, 12, 2)]


def test_empty(spark):
    assert W.word_runs(spark.createDataFrame([], DOCS)).count() == 0
