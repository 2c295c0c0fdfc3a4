from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, TEXTS, clashing, documents
from meterline.llm import spelling_variants as S


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def slow_near(words):
    """Near words of every word from all deletions: words that share one, then compared."""
    gone = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            gone.setdefault(key, []).append(w)
    out = {w: set() for w in words}
    for group in gone.values():
        for a in group:
            out[a].update(b for b in group if near(a, b))
    return out


def slow_variants(rows):
    words = slow_words(rows)
    by = slow_near(words)
    form = {}
    for w, n in words.items():
        best = min(by[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(by[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


word = st.text("abé", min_size=0, max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.sets(word, max_size=25), st.integers(1, 4), st.booleans())
def test_scan_finds_every_pair_once(words, size, last):
    words = sorted(w for w in words if len(w) in (size, size + 1))
    want = sorted(
        (i, j)
        for i, a in enumerate(words)
        for j, b in enumerate(words)
        if len(a) == size and near(a, b) and (j > i if len(b) == size else last or not b.startswith(a))
    )
    assert sorted(S.scan(words, size, last)) == want


def corpus(seed, n=400):
    """Words of few letters, many of them one edit apart, some very frequent."""
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abAé") for _ in range(rnd.randint(6, 10))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(30):
            w = stems[min(int(rnd.expovariate(0.1)), 59)]
            if rnd.random() < 0.3:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice(["", "a", "zz", "É"]) + w[at + rnd.randint(0, 1) :]
            words.append(w)
        rows.append((i, rnd.choice([" ", ", ", "-"]).join(words)))
    return rows


@pytest.mark.parametrize("segments, limit", [(3, 4096), (3, 5), (2, 1), (1, 40), (7, 2)])
def test_pairs_do_not_depend_on_the_lists(spark, segments, limit):
    words = slow_words(corpus(1, 120))
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = S.near_pairs(df, segments, limit).collect()
    found = [tuple(sorted((r.a, r.b))) for r in got]
    assert len(found) == len(set(found))
    assert set(found) == {tuple(sorted((a, b))) for a, of in slow_near(words).items() for b in of}
    assert all(words[r.a] == r.a_n and words[r.b] == r.b_n for r in got)


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus(2) + TEXTS + [(9000 + i, "Winterabend " * 40 + "winterabent" + " wnterabent" * (i < 2)) for i in range(30)]
    clashing(documents(spark, rows)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in S.query(spark, str(tmp_path)).collect()), key=lambda r: r[0])
    want = slow_variants(rows)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want)  # some forms have forms


def test_query_on_the_given_documents(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in S.query(spark, tiny).collect()), key=lambda r: r[0])
    assert got == slow_variants(rows) and len(got) > 100


def test_tasks_hand_on_full_tables(spark, monkeypatch):
    rows = corpus(3, 50)
    want = slow_words([(None, t) for _, t in rows])
    docs = documents(spark, rows)
    monkeypatch.setattr(S, "MEMORY", 10)
    assert {r.word: r.n for r in S.vocabulary(docs).collect()} == want


def test_empty(spark):
    assert S.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert S.variants(documents(spark, [(1, None), (2, ""), (3, "x 1 2")])).count() == 0
