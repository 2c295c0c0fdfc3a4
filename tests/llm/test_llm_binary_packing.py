from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from llm_cases import DOCS, TEXTS, clashing, documents, prose
from meterline.llm import binary_packing as B
from tokenizers import Tokenizer

LONG = (80, prose(90_000, 4))  # over 20 full sequences


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


@given(st.integers(1, 100_000), st.sampled_from([1, 2, 64, 4096]))
def test_lengths_are_the_binary_digits(n, capacity):
    cuts = B.decompose(n, capacity)
    lengths = [length for _, length in cuts]
    assert [s for s, _ in cuts] == np.cumsum([0, *lengths])[:-1].tolist() and sum(lengths) == n
    rest = [x for x in lengths if x < capacity]
    assert lengths == [capacity] * (n // capacity) + rest
    assert rest == [1 << i for i in reversed(range(20)) if n % capacity >> i & 1]


def test_no_ids_no_pieces():
    assert B.decompose(0) == []


@pytest.mark.parametrize("capacity", [B.CAPACITY, 32])
def test_pieces_equal_the_library(spark, tokenizer, capacity):
    rows = TEXTS + [LONG]
    got = B.pieces(clashing(documents(spark, rows)), capacity=capacity, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [B.END]
        for start, length in B.decompose(len(ids), capacity):
            part = ids[start : start + length]
            want.append((i, start, length, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted(((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32, r.ids) for r in got), key=repr) == sorted(
        want, key=repr
    )


def test_sequences_are_whole_and_numbered_in_their_bucket(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").repartition(5)
    rows = B.number(B.pieces(docs), batch=8192).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)  # a piece is a sequence
    assert all(r.offset == 0 and r.length == 1 << r.bucket for r in rows)
    per_doc, places, batches = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in rows:
        per_doc[r.doc_id, r.doc_tokens].append((r.start, r.length))
        places[r.bucket].append(r.place)
        batches[r.bucket, r.batch].add(r.place)
    for (_, n), cuts in per_doc.items():
        assert sorted(cuts) == B.decompose(n)
    for of in places.values():
        assert sorted(of) == list(range(len(of)))
    assert all(len(of) <= 8192 >> bucket for (bucket, _), of in batches.items())


def test_query_keeps_odd_rows(spark, tmp_path):
    clashing(documents(spark)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = B.query(spark, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in rows) == len(TEXTS)
    assert [(r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == 9] == [(0, 1, 1)]


def test_names_of_the_result_are_no_keys(spark):
    with pytest.raises(ValueError):
        B.pieces(documents(spark).withColumnRenamed("n_chars", "start"), keys=("start",))


def test_empty(spark):
    assert B.number(B.pieces(spark.createDataFrame([], DOCS))).count() == 0
