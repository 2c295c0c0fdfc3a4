"""Periodic runs of words by longest common extensions from a difference cover.

Words become numbers. Only the suffixes that start at positions whose remainder
modulo ``V`` lies in a difference cover are sorted: first by ``V`` words, then by
doubling ranks. A sparse table over the common prefixes of neighbours in that order
answers the common extension of two sampled positions. Any two positions reach
sampled ones together within ``V`` steps, so their extension needs a few compared
words and one range minimum.

A run of period p and at least four periods has 3p or more words that equal the
word p later. For every p, positions on a grid of half that distance are asked for
their common extension with the position p later; each such stretch holds a grid
point whose extension covers the next half. Grids over all periods have n log n
points. Nearly all of them end at the first compared words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import per_row, table

#: A perfect difference set; each non-zero remainder is one difference of two members.
V, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Least periods and least words of a run.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Grid points asked at once in a long text.
CHUNK = 1 << 19
#: Texts up to so many words use the grid that a task prepares once.
PREPARED = 1 << 13


def _steps() -> np.ndarray:
    """For remainders a, b: the least step that takes both into the cover."""
    member = np.isin(np.arange(V), COVER)
    step = np.arange(V)
    a, b = np.meshgrid(np.arange(V), np.arange(V), indexing="ij")
    both = member[(a[..., None] + step) % V] & member[(b[..., None] + step) % V]
    return both.argmax(axis=-1)


STEPS = _steps()


class Extensions:
    """Longest common extensions of positions in one sequence of numbers (0 or more)."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = n = len(codes)
        # beyond the end stands a number that equals none inside
        self.codes = np.concatenate((codes, np.full(2 * V, -1, codes.dtype)))
        self.at = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
        self.no = np.full(n + 1, -1, np.int64)  # number of a sampled position
        self.no[self.at] = np.arange(len(self.at))
        self._sort()

    def _ahead(self, ranks: np.ndarray, by: int) -> np.ndarray:
        """Rank of the suffix ``by`` further on, 0 beyond the end; ``by`` is a multiple of V."""
        to = self.at + by
        inside = to < self.n
        out = np.zeros(len(self.at), np.int64)
        out[inside] = ranks[self.no[to[inside]]]
        return out

    def _sort(self) -> None:
        at, m = self.at, len(self.at)
        words = [self.codes[at + k] for k in range(V)]
        order = np.lexsort(words[::-1])
        new = np.zeros(m, bool)
        new[:1] = True
        for w in words:
            s = w[order]
            new[1:] |= s[1:] != s[:-1]
        del words
        levels = []  # ranks by V, 2V, 4V, ... words
        by = V
        while True:
            ranks = np.empty(m, np.int64)
            ranks[order] = np.cumsum(new)
            levels.append(ranks)
            if new.all():
                break
            key = ranks * (m + 1) + self._ahead(ranks, by)
            order = np.argsort(key, kind="stable")
            s = key[order]
            new[1:] = s[1:] != s[:-1]
            by *= 2
        self.rank = levels[-1] - 1
        low, high = order[:-1], order[1:]
        # common prefixes of neighbours: equal ranks of a level are equal stretches
        common = np.zeros(max(0, m - 1), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            to_low, to_high = at[low] + common, at[high] + common
            inside = np.maximum(to_low, to_high) < self.n
            equal = np.zeros(len(common), bool)
            ranks = levels[level]
            equal[inside] = ranks[self.no[to_low[inside]]] == ranks[self.no[to_high[inside]]]
            common[equal] += V << level
        common += self._compared(at[low] + common, at[high] + common, np.full(len(common), V))
        self.table = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j, up to ``most`` of them, word by word."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        k = 0
        while len(live):
            x, y = np.minimum(i[live] + k, self.n), np.minimum(j[live] + k, self.n)
            live = live[(self.codes[x] == self.codes[y]) & (np.maximum(x, y) < self.n)]
            k += 1
            out[live] = k
            live = live[most[live] > k]
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair of different positions."""
        step = STEPS[i % V, j % V]
        out = self._compared(i, j, step)
        go = np.flatnonzero((out == step) & (np.maximum(i, j) + step < self.n))
        if len(go):
            a = self.rank[self.no[i[go] + step[go]]]
            b = self.rank[self.no[j[go] + step[go]]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            more = np.empty(len(go), np.int64)
            for k in np.unique(level).tolist():
                of = level == k
                row = self.table[k]
                more[of] = np.minimum(row[low[of]], row[high[of] - (1 << k)])
            out[go] += more
        return out


def _need(p: np.ndarray) -> np.ndarray:
    """Words equal to the word p later that the shortest run of period p has."""
    return np.maximum((LEAST_PERIODS - 1) * p, LEAST_WORDS - p)


def grid(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of the grid points in n words for periods from low to high - 1.

    The grid of p has half the distance of the shortest stretch.
    """
    p = np.arange(low, high)
    half = _need(p) // 2
    room = n - p - (_need(p) - half)  # last position whose next half fits
    points = np.maximum(0, room // half + 1)
    first = np.cumsum(points) - points
    place = np.arange(points.sum()) - np.repeat(first, points)
    return place * np.repeat(half, points), np.repeat(p, points)


class Grid:
    """Grid points of texts of up to ``PREPARED`` words in order of the words they need."""

    def __init__(self) -> None:
        at, p = grid(PREPARED, 1, PREPARED // LEAST_PERIODS + 1)
        need = at + p + _need(p) - _need(p) // 2
        order = np.argsort(need, kind="stable")
        self.need, self.at, self.p = need[order], at[order].astype(np.int32), p[order].astype(np.int32)

    def parts(self, n: int):
        """Grid points of n words, in bounded parts."""
        if n <= PREPARED:
            to = np.searchsorted(self.need, n, "right")
            yield self.at[:to], self.p[:to]
            return
        low, most = 1, n // LEAST_PERIODS
        while low <= most:
            # points of a period: 2n / 3p at most; n for period 1
            high = low + max(1, int(CHUNK * low / n))
            yield grid(n, low, min(high, most + 1))
            low = high


def find_runs(codes: np.ndarray, points: Grid | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in order of start, then period.

    Periods are the smallest of their stretch. Runs have at least ``LEAST_PERIODS``
    periods and ``LEAST_WORDS`` words, and no neighbouring word extends them.
    """
    n = len(codes)
    if n < LEAST_WORDS:
        return []
    extensions = None
    found = []
    for at, p in (points or Grid()).parts(n):
        hit = np.flatnonzero(codes[at] == codes[at + p])
        for k in (1, 2):  # every half stretch has three words or more
            hit = hit[codes[at[hit] + k] == codes[at[hit] + p[hit] + k]]
        if not len(hit):
            continue
        i, q = at[hit].astype(np.int64), p[hit].astype(np.int64)
        order = np.lexsort((i, q))
        i, q = i[order], q[order]
        extensions = extensions or Extensions(codes)
        forward = extensions.lce(i, i + q)
        half = _need(q) // 2
        able = forward >= _need(q) - half
        i, q, half, forward = i[able], q[able], half[able], forward[able]
        # the first grid point of a stretch speaks for it
        new = np.ones(len(i), bool)
        new[1:] = (q[1:] != q[:-1]) | (i[:-1] + forward[:-1] < i[1:])
        i, q, half, forward = i[new], q[new], half[new], forward[new]
        # its start lies less than a grid step before: the least position that extends as far as i
        low, high = np.maximum(0, i - half), i.copy()
        while len(go := np.flatnonzero(low < high)):
            mid = (low[go] + high[go]) // 2
            reaches = extensions.lce(mid, mid + q[go]) >= i[go] - mid
            high[go[reaches]] = mid[reaches]
            low[go[~reaches]] = mid[~reaches] + 1
        length = i + forward - low + q
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(np.stack((low[long], length[long], q[long])))
    if not found:
        return []
    start, length, period = np.concatenate(found, axis=1)
    # multiples of a period give the same stretch; the smallest period counts
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return list(zip(start[order].tolist(), length[order].tolist(), period[order].tolist()))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    number = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def repeated_tail(words: list[bytes], seed: int) -> list[bytes]:
    """The words with a stretch at the end repeated, as the crc32 ``seed`` says; most stay as they are."""
    n, g = len(words), seed // 10
    if seed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    turn = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        turn[start + period] += 1
        turn[start + length] -= 1
    keep = np.cumsum(turn[:-1]) == 0
    return [words[k] for k in np.flatnonzero(keep).tolist()]


RESULT = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


class _Row:
    def __init__(self, edit: bool) -> None:
        self.edit, self.grid = edit, Grid()

    def __call__(self, doc_id, text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "replace").split()
        if self.edit and doc_id is not None:
            words = repeated_tail(words, zlib.crc32(str(doc_id).encode()))
        runs = find_runs(numbered(words), self.grid)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        return (
            doc_id,
            len(words),
            len(runs),
            *(best or (None, None, None)),
            1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
        )


def word_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", edit: bool = False) -> DataFrame:
    """id and ``RESULT`` of every row: runs of its words, the longest run, digests.

    Null, empty and blank texts have no words and no runs; the digests are then
    those of nothing. Of equally long runs the first counts, then the smaller
    period. ``edit`` repeats a stretch at the end of every tenth text, chosen by its
    id; texts with a null id stay as they are. Repeated rows each get a row; other
    columns are neither read nor returned. An empty table gives no row.

    A task holds one text: some 100 bytes a word for the words themselves, and for
    texts with repetitions 8 bytes for each sampled suffix (6 of 31 positions) and
    doubling step, about 30 bytes a word in all; long texts ask the grid in parts.
    """
    kind = dict(docs.dtypes)[id_col]
    return per_row(docs.select(id_col, text), f"`{id_col}` {kind}, {RESULT}", lambda: _Row(edit))


def runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, start, length, period of every run of every row's words; rows without runs are absent."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        points = Grid()
        return lambda key, value: (key, find_runs(numbered((value or "").encode("utf-8", "replace").split()), points))

    listed = per_row(
        docs.select(id_col, text), f"`{id_col}` {kind}, runs array<struct<start:long,length:long,period:long>>", _Listed(make)
    )
    return listed.select(id_col, F.inline("runs"))


class _Listed:
    """Runs as structs, as Arrow takes them."""

    def __init__(self, make) -> None:
        self.make = make

    def __call__(self):
        row = self.make()

        def structs(key, value):
            key, of = row(key, value)
            return key, [{"start": a, "length": b, "period": c} for a, b, c in of]

        return structs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text after the contract's edit."""
    return word_runs(table(spark, sf_dir, "documents"), edit=True)
