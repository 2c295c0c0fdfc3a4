from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, TEXTS, clashing, documents
from meterline.llm import byte_bpe as B
from pyspark.errors import PythonException
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.ranks(PATH), special_tokens={})


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=40))
def test_varints_round_trip(values):
    data, sizes = B.varints(np.array(values, np.int64))
    back, _ = B.from_varints(data)
    assert back.tolist() == values and sizes.sum() == len(data)


@pytest.mark.parametrize("options", [{}, {"block": 50, "frequent": 2}])
def test_ids_equal_the_library(spark, encoding, options):
    got = B.encode_ids(clashing(documents(spark)), **options).collect()
    want = [(i, encoding.encode_ordinary(t or "")) for i, t in TEXTS]
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(want, key=repr)


def test_decode_joins_the_table(spark):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    tokens = B.token_table(spark)
    got = {r.doc_id: bytes(r.bytes) for r in B.decode(B.encode_ids(docs), tokens).collect()}
    assert got == {i: (t or "").encode() for i, t in TEXTS if i is not None}
    odd = spark.createDataFrame([(1, [0, 10**6])], "doc_id long, ids array<int>")
    assert B.decode(odd, tokens).first().bytes is None


@pytest.mark.parametrize("options", [{}, {"block": 50, "frequent": 2, "shards": 3}])
def test_bytes_of_words_come_from_the_joined_table(spark, encoding, options):
    def whole(ids_of, spelt, words):
        return ((b"".join([spelt[w] for w in of.tolist()]),) for of in words)

    tokens = B.token_table(spark)
    marked = F.when(F.col("id") % 2 == 0, F.concat(F.lit("<").cast("binary"), F.col("bytes"))).otherwise(F.col("bytes"))
    docs = clashing(documents(spark))
    got = B.encode(docs, whole, "bytes binary", tokens=tokens.withColumn("bytes", marked), **options).collect()
    spell = encoding.decode_single_token_bytes
    want = [
        (i, b"".join(b"<" * (x % 2 == 0) + spell(x) for x in encoding.encode_ordinary(t or ""))) for i, t in TEXTS
    ]
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in got), key=repr) == sorted(want, key=repr)
    lacking = B.encode(docs, whole, "bytes binary", tokens=tokens.filter("id > 300"), **options)
    with pytest.raises(PythonException, match="lacks id"):
        lacking.collect()


def test_decoding_adds_no_shuffle(spark, tiny):
    plan = B.query(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastHashJoin" in plan


def test_query_digests(spark, encoding, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in B.query(spark, tiny).collect()}
    for doc_id, text in docs:
        ids = encoding.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert B.encode_ids(nothing).count() == 0
    assert B.encode(nothing, B._digests, "n long, a string, b string", tokens=B.token_table(spark)).count() == 0
    assert B.encode_ids(documents(spark).filter(F.col("text").isNull())).first().ids == []
