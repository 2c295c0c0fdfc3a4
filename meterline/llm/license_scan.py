"""License scan: winnowed template fingerprints, then banded alignment.

Templates are normalised to words (letters, digits, inner dots and hyphens, lower
case). ``GRAM`` words are a gram, fewer for a template in which the least coverage could
leave shorter runs only. Grams are winnowed (of every window of neighbouring hashes the
smallest stays, so any run of ``GRAM + WINDOW - 1`` words that a text shares with a
template holds a fingerprint) where that coverage always leaves such a run, else all are
kept, so words changed in place never hide a template. An inverted index leads from a
fingerprint to templates and places. All grams of a text are looked up; hits on nearby
diagonals are one candidate, and hits that go back in the template part its copies. A
banded alignment of the whole template against that part of the text gives the words in
common, the coverage and the span.

The set of templates is a parameter of fixed size, so it is sent to all tasks; the
texts are read once and nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meterline.llm.common import WordTable, arrow_schema, table

GRAM, WINDOW, BAND = 3, 3, 6
#: Least share of a template's words that a report covers.
MIN_COVERAGE = 0.8

# Whole standard notices and short license texts, without the copyright line,
# and the one-line statements that stand for a license. Texts of many pages (Apache, GPL,
# LGPL, AGPL, MPL, Creative Commons) are found by their notices.
_SOFTWARE = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)


def _gnu(name: str, version: str) -> str:
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        f"{name} as published by the Free Software Foundation, either version {version} of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        f"GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. "
        "If not, see <https://www.gnu.org/licenses/>."
    )


TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-notice": _gnu("Affero General Public License", "3"),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "bsd-2-clause": _BSD + _SOFTWARE,
    "bsd-3-clause": (
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission. " + _SOFTWARE
    ),
    "bsl-1.0-notice": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0-notice": _gnu("General Public License", "2"),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": _gnu("General Public License", "3"),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "lgpl-2.1-notice": _gnu("Lesser General Public License", "2.1"),
    "lgpl-3.0-notice": _gnu("Lesser General Public License", "3"),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "reserved": "All rights reserved.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}

# Identifiers of the public license list; each stands in a line of its own.
SPDX = """
0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0
CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0
GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only
LGPL-3.0-or-later MIT MIT-0 MPL-2.0 MulanPSL-2.0 OFL-1.1 PostgreSQL Python-2.0 Unlicense WTFPL Zlib
"""
TEMPLATES |= {f"spdx-{i.lower()}": f"SPDX-License-Identifier: {i}" for i in SPDX.split()}

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_RUN = re.compile(r"[^\x20\x09-\x0D]+")


def normal(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def gram_hashes(ids: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of each run of ``size`` word numbers."""
    n = len(ids) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    return out * np.uint64(0xD6E8FEB86659FD93)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the smallest hash (the last of equal ones) of each window."""
    if len(hashes) <= window:
        return [int(len(hashes) - 1 - hashes[::-1].argmin())] if len(hashes) else []
    at = {i + window - 1 - int(hashes[i : i + window][::-1].argmin()) for i in range(len(hashes) - window + 1)}
    return sorted(at)


def sure_run(words: int, min_coverage: float) -> int:
    """Words in a row that are left at least when a template keeps its least coverage."""
    lost = words - least(words, min_coverage)
    return -(-(words - lost) // (lost + 1))


def least(words: int, min_coverage: float) -> int:
    """Fewest matched words of that coverage."""
    return next((n for n in range(1, words) if n / words >= min_coverage), words)


@dataclass
class Index:
    """Word numbers of the templates (0: any other word) and their fingerprints by gram size."""

    templates: dict[str, str]
    min_coverage: float = MIN_COVERAGE
    names: list[str] = field(init=False)
    vocabulary: dict[str, int] = field(init=False)
    words: list[np.ndarray] = field(init=False)
    grams: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = field(init=False)

    def __post_init__(self) -> None:
        self.names = sorted(self.templates)
        split = [normal(self.templates[n]) for n in self.names]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for words in split for w in words}))}
        self.words = [np.array([self.vocabulary[w] for w in words], np.int64) for words in split]
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for no, ids in enumerate(self.words):
            run = sure_run(len(ids), self.min_coverage)
            size = max(1, min(GRAM, run))
            hashes = gram_hashes(ids, size)
            for at in winnow(hashes) if run >= GRAM + WINDOW - 1 else range(len(hashes)):
                found.setdefault(size, {}).setdefault(int(hashes[at]), []).append((no, at))
        self.grams = {size: (np.array(sorted(of), np.uint64), [of[h] for h in sorted(of)]) for size, of in found.items()}


def align(template: list[int], part: list[int], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(words in common, first, last place in ``part``) of the best alignment of the
    template whose place j meets places j + shift - band .. j + shift + band of the part;
    of equal ones the shortest, then the one nearest to the shift."""
    # best[d]: (matches, first, -last) of alignments that end at diagonal d
    none = (0, 0, 1)
    best = [none] * (2 * band + 1)
    for j, word in enumerate(template):
        new = []
        for d in range(2 * band + 1):
            at = j + shift - band + d
            score = best[d]  # both advance
            if 0 <= at < len(part) and part[at] == word:
                score = (score[0] + 1, score[1] if score[0] else at, -at)
            if d and new[-1] > score:  # the part's word is skipped
                score = new[-1]
            if d < 2 * band and best[d + 1] > score:  # the template's word is skipped
                score = best[d + 1]
            new.append(score)
        best = new
    matches, _, _, first, last = max((m, a + b, -abs(d - band), a, -b) for d, (m, a, b) in enumerate(best))
    return matches, first, last


def candidates(index: Index, ids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(template, diagonal, low, high) of clusters of fingerprint hits, and the part of the
    text each may use: all of it, and again what neighbouring copies leave."""
    known = np.flatnonzero(ids)
    hits: dict[int, list[tuple[int, int, int]]] = {}
    for size, (of, places) in index.grams.items():
        if len(known) < size:
            continue
        starts = known[: len(known) - size + 1]
        starts = starts[known[size - 1 :] - starts == size - 1]
        if not len(starts):
            continue
        hashes = gram_hashes_at(ids, starts, size)
        at = np.minimum(np.searchsorted(of, hashes), len(of) - 1)
        for i in np.flatnonzero(of[at] == hashes).tolist():
            for no, place in places[at[i]]:
                hits.setdefault(no, []).append((int(starts[i]), place, size))
    for no, of in hits.items():
        diagonals = sorted({start - place for start, place, _ in of})
        first = diagonals[0]
        for d, after in zip(diagonals, [*diagonals[1:], None]):
            if after is None or after - first > BAND:
                yield no, (first + d) // 2, 0, len(ids)
                first = after
        copies: list[list[tuple[int, int, int]]] = []
        for hit in sorted(of):
            last = copies[-1][-1] if copies else None
            if last is None or hit[1] <= last[1] or abs(hit[0] - hit[1] - copies[-1][0][0] + copies[-1][0][1]) > BAND:
                copies.append([])
            copies[-1].append(hit)
        for before, own, after in zip([None, *copies], copies, [*copies[1:], None]) if len(copies) > 1 else ():
            of_own = [start - place for start, place, _ in own]
            low = before[-1][0] + before[-1][2] if before else 0
            yield no, (min(of_own) + max(of_own)) // 2, low, after[0][0] if after else len(ids)


def gram_hashes_at(ids: np.ndarray, starts: np.ndarray, size: int = GRAM) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + ids[starts + i].astype(np.uint64) + np.uint64(1)
    return out * np.uint64(0xD6E8FEB86659FD93)


class Scanner:
    """Finds templates in texts; one for each task."""

    def __init__(self, index: Index, min_coverage: float = MIN_COVERAGE) -> None:
        self.index, self.min_coverage = index, min_coverage
        self.least = [least(len(words), min_coverage) for words in index.words]
        of = index.vocabulary
        self.table = WordTable(lambda ws: [[of.get(w, 0) for w in normal(b.decode())] for b in ws], np.int64)

    def __call__(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start, end) by start, then license."""
        split = (text or "").encode().split()
        numbers = self.table.numbers(split)
        ids = self.table.gather(numbers)
        found: dict[tuple[int, int, int], tuple] = {}
        spans = None
        for no, diagonal, low, high in dict.fromkeys(candidates(self.index, ids)):
            template = self.index.words[no]
            low = max(low, diagonal - BAND)
            part = ids[low : max(low, min(high, diagonal + len(template) + BAND))]
            if np.isin(template, part).sum() < self.least[no]:
                continue
            matches, first, last = align(template.tolist(), part.tolist(), diagonal - low)
            coverage = matches / len(template)
            if coverage < self.min_coverage:
                continue
            if spans is None:  # where each normalised word stands in the text
                spans = [
                    (run.start() + w.start(), run.start() + w.end())
                    for run in _RUN.finditer(text)
                    for w in _WORD.finditer(run[0])
                ]
            start, end = spans[low + first][0], spans[low + last][1]
            key = (no, start, end)
            found[key] = (self.index.names[no], coverage, matches, start, end, last - first >= matches)
        return [r[:5] for r in sorted(best_of(found.values()), key=lambda r: (r[3], r[0], r[4]))]


def best_of(found: Iterable[tuple]) -> list[tuple]:
    """Matches that no better one overlaps, the best first.

    Those kept lie in order of their start; only those that start less than the
    longest of them before a match's start, or inside it, can overlap it.
    """
    kept: list[tuple] = []
    starts: list[int] = []
    longest = 0
    for row in sorted(found, key=lambda r: (-r[1], -r[2], r[4] - r[3], r[3], r[0])):
        low, high = bisect_left(starts, row[3] - longest), bisect_left(starts, row[4])
        if not any(_better(other, row) for other in kept[low:high]):
            at = bisect_right(starts, row[3])
            kept.insert(at, row)
            starts.insert(at, row[3])
            longest = max(longest, row[4] - row[3])
    return kept


def _better(a: tuple, b: tuple) -> bool:
    """True if a overlaps b and is of its template, or covers more of its own and no fewer words,
    or as much and more words where b skips some (GPL in AGPL)."""
    more = a[1] > b[1] and a[2] >= b[2] or a[1] == b[1] and a[2] > b[2] and b[5]
    return a[3] < b[4] and b[3] < a[4] and (a[0] == b[0] or more)


COLUMNS = "license string, coverage double, matched_words long, start long, end long"


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    keys: tuple[str, ...] = ("doc_id",),
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """``keys`` and ``COLUMNS`` of every template found in a row's whole text.

    Places are code points, end exclusive. A text may match several templates and
    one template in several places, each a row, but a match that overlaps one of more
    coverage and no fewer words, or skips words of one of equal coverage, is that one's
    near relative and left out. A text without matches, a null or
    an empty one gives none. Repeated rows repeat their matches; null ids are kept.
    """
    index = Index(TEMPLATES if templates is None else templates, min_coverage)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kinds = dict(docs.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + COLUMNS
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value, min_coverage)
        for batch in batches:
            of, rows = [], []
            for at, text in enumerate(batch.column(len(keys)).to_pylist()):
                for row in scanner(text):
                    of.append(at)
                    rows.append(row)
            if rows:
                own = batch.select(range(len(keys))).take(pa.array(of)).columns
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[len(keys) :])]
                yield pa.RecordBatch.from_arrays([*own, *new], schema=arrow)

    return docs.select(*keys, "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
