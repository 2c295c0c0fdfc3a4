from __future__ import annotations

import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from compare import difference, duck
from llm_cases import PAGES, clashing
from meterline.llm import warc as W
from meterline.session import shared_folder

LONG, ROWS = "é" * 80, [
    (5, "http://a/x y\r\nz", "é" * 80),
    (3, None, "é" * 80),
    (3, "http://b", "é" * 80),
    (None, "http://c", "é" * 80),
    (9, "http://d", "short"),
    (8, "http://e", "short"),
    (1, "http://f", None),
    (2, "http://g", ""),
    (4, "http://h", "\x1f\x8b\x08" * 50),
    (6, "http://i", "x" * 300_000),
]


def expected():
    out = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        same = [p for p, _, h in ROWS if p is not None and (h or "").encode() == body]
        first = min(same) if same and len(body) >= 100 else None
        again = first is not None and page != first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def pages(spark):
    return spark.createDataFrame(ROWS, PAGES)


@pytest.mark.parametrize("range_bytes", [97, 4096, 1 << 24])
def test_every_split_gives_every_record_once(spark, range_bytes):
    manifest = W.write(W.with_revisits(clashing(pages(spark))), shared_folder(spark, "warc"), file_bytes=700, level=1)
    got = W.read(manifest, range_bytes, with_payload=True).collect()
    assert manifest.agg({"records": "sum"}).first()[0] == len(got) == len({(r.file, r.offset) for r in got})
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected()
    assert {bytes(r.payload) for r in got if r.page_id == 6} == {b"x" * 300_000}
    assert {r.target_uri for r in got if r.page_id == 5} == {"http://a/x%20y%0D%0Az"}


def test_false_magic_is_not_taken(spark):
    payload = W._MAGIC * 3 + gzip.compress(b"no record") + b"x" * 50
    member = gzip.compress(W.record(1, None, payload, hashlib.sha256(payload).hexdigest(), None), 0)
    data = member * 3
    archive = W.Archive(pa.BufferReader(data), len(data))
    for at in range(0, len(data), 7):
        got = [o for o, _, _ in archive.records(at, len(data))]
        assert got == [o for o in (0, len(member), 2 * len(member)) if o >= at]


def test_damage_is_loud():
    data = gzip.compress(W.record(1, None, b"a", hashlib.sha256(b"a").hexdigest(), None)) + b"garbage"
    with pytest.raises(ValueError):
        list(W.Archive(pa.BufferReader(data), len(data)).records(0, len(data)))


def test_ranges_are_read_by_many_tasks(spark):
    rows = [(i, None, random.Random(i).randbytes(300).hex()) for i in range(200)]
    manifest = W.write(W.with_revisits(spark.createDataFrame(rows, PAGES)), shared_folder(spark, "warc"))
    got = W.read(manifest, 1000)
    ranges = sum(-(-r.bytes // 1000) for r in manifest.collect())
    assert ranges > 30 and got.rdd.getNumPartitions() == ranges
    assert sorted(r.page_id for r in got.collect()) == list(range(200))


def test_headers_of_any_length(spark):
    url = "http://long/" + random.Random(1).randbytes(1 << 20).hex()  # 2 MiB, hardly compressible
    rows = [(1, None, "a" * 200), (2, url, "b" * 200), (3, None, "c" * 200)]
    manifest = W.write(W.with_revisits(spark.createDataFrame(rows, PAGES).coalesce(1)), shared_folder(spark, "warc"))
    for range_bytes in (100_003, 1 << 24):  # alone at the start of a range, and in step
        got = {r.page_id: r for r in W.read(manifest, range_bytes).collect()}
        assert sorted(got) == [1, 2, 3] and got[2].target_uri == url
    record = gzip.compress(W.record(2, url, b"b", hashlib.sha256(b"b").hexdigest(), None))
    data = gzip.compress(W.record(1, None, b"a", hashlib.sha256(b"a").hexdigest(), None))
    archive = W.Archive(pa.BufferReader(data + record), len(data + record))
    assert [o for o, _, _ in archive.records(len(data) - 5, len(data) + 5)] == [len(data)]


def test_equals_sql(spark, small):
    assert difference(W.query(spark, small), duck(small), W.SQL) is None


def test_empty(spark):
    manifest = W.write(W.with_revisits(spark.createDataFrame([], PAGES)), shared_folder(spark, "warc"))
    assert W.read(manifest).count() == 0
