from __future__ import annotations

import subprocess
import sys
import zlib
from pathlib import Path

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest
from llm_cases import DOCS, LABELS, TEXTS, clashing, documents, prose
from meterline.llm import secret_scan as X
from test_llm_packing import slow_ids
from test_llm_quality import JUNK, slow
from test_llm_simhash import brute
from tokenizers import Tokenizer

ROOT = Path(__file__).resolve().parents[2]
ROWS = TEXTS + JUNK + [(80 + i, prose(50 + 7 * i, i)) for i in range(8)] + [(99, prose(70, 6) + ' token = "abcdefgh12"')]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    documents(spark, ROWS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 50), 0) for i, _ in ROWS if i is not None]
    spark.createDataFrame(labels, LABELS).coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    language, quality, copies, secrets, packing = (f for _, f in C.STAGES)

    kept = language(spark, docs, folder)
    want = [(i, t) for i, t in ROWS if t and any(c.isalpha() for c in t)]
    assert sorted(texts(kept), key=repr) == sorted(want, key=repr)

    good = {i for i, _ in ROWS if i is not None and i < 50}
    fine = quality(spark, kept, folder)
    keep = {r[0] for r in slow(want, good) if r[-1]}
    want = [(i, t) for i, t in want if i in keep]
    assert sorted(texts(fine), key=repr) == sorted(want, key=repr)

    single = copies(spark, fine, folder)
    component = {r[0]: r[2] for r in brute(want)}
    first = {i for i in component if i == component[i]}
    want = sorted({(i, t) for i, t in want if i in first}, key=repr)
    assert sorted(texts(single), key=repr) == want and len(want) < len(keep)

    clean = secrets(spark, single, folder)
    want = [(i, X.redact(t)) for i, t in want]
    assert sorted(texts(clean), key=repr) == sorted(want, key=repr) and any("[assign]" in t for _, t in want)
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert clean.columns == docs.columns

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for i, t in want:
        ids = np.array(slow_ids(tokenizer, t), "<u4")
        pieces += [(i, k // 2048, zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    packed = packing(spark, clean, folder)
    assert sorted(((r.doc_id, r.piece, r.ids_crc32) for r in packed.collect()), key=repr) == sorted(pieces, key=repr)
    got = C.run(spark, folder).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(pieces, key=repr)


def test_stages_keep_odd_columns_and_empty_tables(spark, folder):
    more = clashing(documents(spark, ROWS))
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, more, folder).columns == more.columns
    for _, stage in C.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), folder).count() == 0


def test_null_ids_share_one_survivor(spark, folder):
    rows = [(None, prose(40, 2)), (None, prose(40, 2)), (None, prose(40, 2) + " x"), (3, prose(40, 9))]
    got = texts(C.remove_near_duplicates(spark, documents(spark, rows), folder))
    ids = [r[2] for r in brute(rows)]
    assert len(got) == 1 + (1 if len({repr(i) for i in ids}) == 2 else 0)


@pytest.mark.parametrize("gone", ["meterline.llm", "corpus_pipeline", "tiktoken", "tokenizers", "public_tokenizers"])
def test_entry_without_the_subpackage(tmp_path, gone):
    """The other queries load where the subpackage, the pipeline or a dependency is gone."""
    for name in ("__spark_entry__.py", "meterline", "oracle"):
        (tmp_path / name).symlink_to(ROOT / name)
    hide = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name.startswith('{gone}'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'gold_jobs' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-B", "-c", hide], cwd=tmp_path, check=True, timeout=120)
