from __future__ import annotations

import hashlib
import os
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, TEXTS, clashing, documents
from meterline.llm import prefix_hash as P

WORDS = st.text("abß🙂", max_size=60)


@settings(max_examples=60, deadline=None)
@given(WORDS, WORDS, st.integers(0, 60), st.integers(0, 60))
def test_spans_and_extensions(a, b, i, j):
    powers = P.Powers()
    x, y = P.Prefix(a, powers), P.Prefix(b, powers)
    i, j = min(i, len(a)), min(j, len(b))
    assert P.common_extension(x, i, y, j) == len(os.path.commonprefix([a[i:], b[j:]]))
    assert x.joined(i, y, j) == P.Prefix(a[:i] + b[:j], powers).span(0, i + j)


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=90), st.text("abc", max_size=90))
def test_edited_fingerprint_is_that_of_the_edited_text(a, b):
    powers = P.Powers()
    text, packed = P.Document(a, powers).edited(P.Document(b, powers))
    half = len(a) // 2
    assert text == a[: len(a) - half] + b[:half]
    assert packed == P.Document(text, powers).print


@settings(max_examples=60, deadline=None)
@given(st.text("abß🙂", max_size=120), st.text("ab🙂", max_size=120), st.integers(1, 40), st.integers(0, 120))
def test_chunks_change_nothing(a, b, chunk, i):
    powers, i = P.Powers(), min(i, len(a))
    x = P.Document(a, powers)
    row, spans = x.row(P.Document(b, powers)), [x.prefix.span(i, n) for n in range(i, len(a) + 1)]
    whole = P.CHUNK
    P.CHUNK = chunk
    try:
        small = P.Powers()
        u, v = P.Document(a, small), P.Document(b, small)
        assert u.row(v) == row
        assert [u.prefix.span(i, n) for n in range(i, len(a) + 1)] == spans
        assert P.common_extension(u.prefix, i, v.prefix, 0) == len(os.path.commonprefix([a[i:], b]))
    finally:
        P.CHUNK = whole


def test_memory_of_a_very_long_text():
    text = "abcdefgh ijklmnop " * (3 * P.CHUNK // 18)
    tracemalloc.start()
    try:
        doc = P.Document(text, P.Powers())
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert doc.prefix.span(0, 18 * 9) == doc.prefix.span(18 * 30_000, 18 * 30_009)
    assert kept < 13 * len(text) + 40 * P.CHUNK and peak < kept + 100 * P.CHUNK


def expected(rows):
    rows = [(i, t or "") for i, t in rows]
    order = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i), reverse=True)
    text = {i: min(t for k, t in rows if k == i) for i in order}
    out = []
    for i, t in rows:
        after = text[order[(order.index(i) + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), len(os.path.commonprefix([t, after]))))
    return sorted(out, key=repr)


def test_rows_over_partitions(spark):
    got = P.compare_with_edited(clashing(documents(spark))).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.common_start) for r in got), key=repr) == expected(TEXTS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].fingerprint == by_id[3].fingerprint != by_id[5].fingerprint
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert by_id[1].near_edited == 1.0


def test_single_and_empty(spark):
    one = P.compare_with_edited(documents(spark, [(1, "abc")])).first()
    assert (one.near_next, one.common_start) == (1.0, 3)
    assert P.compare_with_edited(spark.createDataFrame([], DOCS)).count() == 0


def test_likeness_follows_common_spans():
    powers = P.Powers()
    a = "".join(chr(97 + i * i % 23) for i in range(2000)) + "q" * 40
    b = a[:1000] + "".join(chr(97 + i * i * i % 19) for i in range(1000))
    spans = [{t[i : i + P.SPAN] for i in range(len(t) - P.SPAN + 1)} for t in (a, b)]
    want = len(spans[0] & spans[1]) / len(spans[0] | spans[1])
    assert abs(P.likeness(P.Document(a, powers).print, P.Document(b, powers).print) - want) < 0.25
