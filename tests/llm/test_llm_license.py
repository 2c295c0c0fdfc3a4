from __future__ import annotations

import random
import time

from llm_cases import DOCS, TEXTS, clashing, documents, prose
from meterline.llm import license_scan as L

NOTICE = L.TEMPLATES["apache-2.0-notice"]


def slow_common(a, b):
    """Longest common subsequence, all cells."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment_equals_the_full_table():
    words = L.normal(NOTICE)
    number = {w: i + 1 for i, w in enumerate(sorted(set(words)))}
    ids = [number[w] for w in words]
    for edit in (ids, ids[:10] + ids[12:], ids[:20] + [0, 0] + ids[20:], [0] + ids[:5] + [0] + ids[6:]):
        assert L.align(ids, edit, 0)[0] == slow_common(ids, edit)


def test_winnowing_keeps_one_of_each_window():
    hashes = L.gram_hashes(L.Index(L.TEMPLATES).words[0])
    kept = set(L.winnow(hashes))
    assert all(kept & set(range(i, i + L.WINDOW)) for i in range(len(hashes) - L.WINDOW + 1))


def test_finds_spans(spark):
    line = "Released under the MIT License."
    edited = NOTICE.replace("express or implied", "whether express or implied").replace("file except", "thing except")
    rows = TEXTS + [
        (20, prose(30, 1) + " " + line + " " + prose(30, 2) + "\n" + line),
        (21, prose(9, 1) + "\nÉ🙂 " + edited + "\n" + prose(9, 2)),
        (21, prose(9, 1) + "\nÉ🙂 " + edited + "\n" + prose(9, 2)),
        (22, "Licensed under CC BY-NC 4.0."),
        (23, "the MIT License"),
    ]
    text = dict(rows)
    got = L.scan(clashing(documents(spark, rows))).collect()
    found = sorted((r.doc_id, r.license, text[r.doc_id][r.start : r.end]) for r in got)
    assert [f for f in found if f[0] != 21] == [
        (20, "mit", line[:-1]),
        (20, "mit", line[:-1]),
        (22, "cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ]
    notices = [r for r in got if r.doc_id == 21 and r.license == "apache-2.0-notice"]
    assert len(notices) == 2 and all(0.95 < r.coverage < 1 for r in notices)
    assert {text[21][r.start : r.end] for r in notices} == {edited[: -len(".")]}


def test_every_changed_word_and_every_copy_is_found():
    scanner = L.Scanner(L.Index(L.TEMPLATES))
    for name, template in L.TEMPLATES.items():
        words = L.normal(template)
        lost = len(words) - L.least(len(words), L.MIN_COVERAGE)
        step = max(1, len(words) // (lost + 1))
        for shift in range(min(step, len(words))):
            places = list(range(shift, len(words), step))[:lost]
            edited = ["zzz" if i in places else w for i, w in enumerate(words)]
            got = scanner("before " + " ".join(edited) + " after")
            near = [k for k, c, *_ in got if c >= 1 - lost / len(words) - 1e-9]
            assert near, (name, edited)
            assert name in near or L.normal(template)[0] in edited or len(words) > 5, (name, edited)
    assert [r[0] for r in scanner("Licensed under the MIT License")] == ["mit"]
    for line, name in (("All rights reserved.", "reserved"), ("Released under the MIT License.", "mit"), ("Licensed under CC BY 4.0.", "cc-by-4.0")):
        text = " ".join([line] * 5)
        assert [(k, a, b) for k, _, _, a, b in scanner(text) if k == name] == [
            (name, i * (len(line) + 1), i * (len(line) + 1) + len(line) - 1) for i in range(5)
        ]
    mixed = "Released under zzz MIT License. Released under the MIT License. Released under the MIT zzz."
    assert [r[2] for r in scanner(mixed) if r[0] == "mit"] == [4, 5, 4]


def test_whole_texts_tell_families_apart():
    scanner = L.Scanner(L.Index(L.TEMPLATES))
    for name in ("agpl-3.0", "agpl-3.0-notice", "bsd-2-clause", "bsd-3-clause", "gpl-2.0-notice", "gpl-3.0-notice", "isc", "lgpl-2.1-notice", "lgpl-3.0-notice", "mit-notice", "mpl-2.0"):
        text = L.TEMPLATES[name]
        assert [(k, c) for k, c, *_ in scanner("Copyright 2020 A. B.\n\n" + text + "\nend")] == [(name, 1.0)]
    for name in ("bsd-2-clause", "mit-notice"):  # an opening sentence alone is not the license
        assert not scanner(" ".join(L.TEMPLATES[name].split()[:24]))


def test_given_lines_are_all_found(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    lines = {k: L.TEMPLATES[k] for k in ("apache-2.0", "cc-by-nc-4.0", "gpl-3.0", "mit")}
    want = {(i, k) for i, t in docs for k, line in lines.items() if line in t}
    got = {(r.doc_id, r.license) for r in L.query(spark, small).collect() if r.license in lines}
    assert want and got == want


def test_overlaps_are_settled_as_by_comparing_all():
    rnd = random.Random(8)
    for _ in range(200):
        found = []
        for _ in range(rnd.randrange(60)):
            start = rnd.randrange(300)
            found.append((rnd.choice("abc"), rnd.choice([0.8, 0.9, 1.0]), rnd.randrange(3, 9), start, start + rnd.randrange(1, 80), rnd.random() < 0.5))
        found = list({(r[0], r[3], r[4]): r for r in found}.values())
        kept = []
        for row in sorted(found, key=lambda r: (-r[1], -r[2], r[4] - r[3], r[3], r[0])):
            if not any(L._better(other, row) for other in kept):
                kept.append(row)
        assert sorted(L.best_of(found)) == sorted(kept)


def test_a_megabyte_of_notices():
    line, n = "Licensed under CC BY 4.0. ", 20_000
    found = [("a", 1.0, 5, i * 26, i * 26 + 24, False) for i in range(100_000)]
    began = time.process_time()
    assert len(L.best_of(found)) == 100_000
    assert time.process_time() - began < 5
    got = L.Scanner(L.Index(L.TEMPLATES))(line * n)
    assert len(got) == n and {g[0] for g in got} == {"cc-by-4.0"}


def test_identifiers():
    scanner = L.Scanner(L.Index(L.TEMPLATES))
    for name in ("MIT", "GPL-3.0-or-later", "0BSD", "CC0-1.0", "EPL-2.0"):
        for line in (f"// SPDX-License-Identifier: {name}", f"# spdx-license-identifier:{name}\nx = 1"):
            assert [g[0] for g in scanner(line)] == [f"spdx-{name.lower()}"], line
    assert not scanner("SPDX-License-Identifier: Unknown-1.0") and not scanner("MIT")


def test_nothing_is_missed_against_every_place():
    """All templates at every place of small texts, by the longest common subsequence of whole windows."""
    templates = {"one": "alpha beta gamma delta epsilon", "two": "beta gamma zeta eta", "id": "Key: MIT", "long": " ".join(f"w{i}" for i in range(30))}
    index = L.Index(templates)
    scanner, rnd = L.Scanner(index), random.Random(2)
    for _ in range(150):
        words = []
        for _ in range(rnd.randrange(1, 5)):
            words += [f"x{rnd.randrange(9)}" for _ in range(rnd.randrange(12))]
            of = L.normal(rnd.choice(list(templates.values())))
            lost = len(of) - L.least(len(of), L.MIN_COVERAGE)
            gone = set(rnd.sample(range(len(of)), rnd.randint(0, lost)))
            words += ["zz" if i in gone else w for i, w in enumerate(of)]
        text = " ".join(words)
        got = {g[0] for g in scanner(text)}
        for name, template in templates.items():
            of = L.normal(template)
            exact = max(
                (sum(a == b for a, b in zip(of, words[i : i + len(of)])) for i in range(len(words) - len(of) + 1)), default=0
            )
            if exact >= L.least(len(of), L.MIN_COVERAGE):
                rivals = {"one", "two"} if name in ("one", "two") else {name}
                assert got & rivals, (name, text)


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], DOCS)).count() == 0
    assert L.scan(documents(spark), templates={}).count() == 0
