from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, TEXTS, clashing, documents
from meterline.llm import vector_packing as V
from tokenizers import Tokenizer

ODD = "It's o'clock I'LL 'S'T x'd 12a3 _a_ İstanbul ŸÀ ﬁ e\u0301 \u00a0x ½² Σς ΟΔΟΣ <|endoftext|> ĸŉſ ×÷ “q” 日本 \x7f\x01 a\x85b"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def slow_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_equal_the_library(spark, tokenizer):
    rows = TEXTS + [(70, ODD)]
    got = V.pieces(clashing(documents(spark, rows)), capacity=50, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = slow_ids(tokenizer, t)
        for k in range(0, len(ids), 50):
            part = ids[k : k + 50]
            want.append((i, k // 50, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=repr) == sorted(want, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.sampled_from(["norm", "dot"]), st.integers(1, 6), st.integers(100, 500))
def test_bins_hold_every_constraint(lengths, rule, documents, attention):
    bins, offsets = V.fit(np.array(lengths, np.int64), (24, documents, attention), rule=rule)
    inside = defaultdict(list)
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
        inside[b].append((o, n))
    for of in inside.values():
        of.sort()
        assert [o for o, _ in of] == np.cumsum([0, *[n for _, n in of]])[:-1].tolist()
        sizes = [n for _, n in of]
        assert len(of) == 1 or sum(sizes) <= 24 and len(of) <= documents and sum(n * n for n in sizes) <= attention


def slow_fit(lengths, most, weights):
    """Best fit by the residual's norm, bin by bin."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left, where = [], {}
    for i in order:
        need = (lengths[i], 1, lengths[i] ** 2)
        fits = [
            (sum((w * (r - n) / m) ** 2 for w, r, n, m in zip(weights, rest, need, most)), b)
            for b, rest in enumerate(left)
            if all(r >= n for r, n in zip(rest, need))
        ]
        b = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(most)
        left[b] = tuple(r - n for r, n in zip(left[b], need))
        where[i] = b
    return [where[i] for i in range(len(lengths))]


def test_best_fit_is_the_plain_one():
    rnd = np.random.default_rng(3)
    for most in ((100, 100, 10_000), (100, 4, 3000)):
        lengths = rnd.integers(1, 90, 300).tolist()
        assert len(set(V.fit(np.array(lengths), most)[0].tolist())) == len(set(slow_fit(lengths, most, V.WEIGHTS)))


@pytest.mark.parametrize("group", [V.GROUP, 20])
def test_sequences_are_gapless_and_full(spark, tiny, group):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = V.pack(V.pieces(docs), group=group).collect()
    assert len(rows) == V.pieces(docs).count()
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    for of in inside.values():
        of.sort()
        assert [o for o, _ in of] == np.cumsum([0, *[n for _, n in of]])[:-1].tolist()
        assert sum(n for _, n in of) <= V.CAPACITY
    bound = -(-sum(r.length for r in rows) // V.CAPACITY)
    assert len(inside) <= bound + 1 + len(rows) // group * 2


def test_empty(spark):
    assert V.pack(V.pieces(spark.createDataFrame([], DOCS))).count() == 0
