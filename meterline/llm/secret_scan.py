"""Secret scan with a recursive decoding worklist.

A text is the first layer. Every layer is scanned by the base rules and for
encoded stretches: percent escapes (%XX, %uXXXX), Unicode, hexadecimal and octal escapes,
entities (numbered, or named ones of ASCII characters), base64 (with either
alphabet), and the compressed bytes that any of them may hold. The escapes of a layer are
decoded in place, in one new layer of its whole text, as a rule may need what stands
before them. Base64 runs, joined over line ends, decode to a new layer for each of the
four alignments, whatever stands before a value in its run. gzip members, zlib and bzip2
streams are unpacked wherever they start in a decoded layer, cut ones as far as they
go; raw deflate, which has no mark, where a whole stream begins a decoded layer. No decoded layer is dropped for its bytes: one character stands for each byte, and
UTF-16 is brought together, as all rules and encodings are ASCII. New layers join the worklist;
a layer whose content was seen before in the same chain of decodings or elsewhere at
the same place is not taken again, so the list runs empty. Every layer knows which code points of the whole text each of
its characters came from, so findings inside it are mapped to spans of the text.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import per_row, table

# Kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
LEAST_VALUE = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ACCESS = 20
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is one match either way
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# The first choice of either unit peels a long chain of escaped escapes at once, so
# a hostile chain costs one layer and not one for each of its levels.
_PERCENT = re.compile(r"(%(?:25){3,})|%u([0-9A-Fa-f]{4})|%([0-9A-Fa-f]{2})")
_NAMED = {name: char for name, char in html5.items() if name.endswith(";") and len(char) == 1 and char.isascii()}
_UNICODE = re.compile(
    r"(?P<chain>\\(?:u005[cC]){3,}|\\(?:134){3,}|&(?:#38;|amp;){3,})|(?P<name>&(?:" + "|".join(_NAMED) + r"))|\\(?P<octal>[0-3]?[0-7]{2})|"
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#(?P<number>[0-9]{1,7});"
)
_LETTER = "[A-Za-z0-9+/_-]"
#: A line end inside a wrapped run, also as JSON writes it.
_WRAP = r"[\x20\t]*(?:\r\n?|\n|\\r\\n|\\n)[\x20\t]*"
_BASE64 = re.compile(
    rf"(?<!{_LETTER})(?:{_LETTER}{{16,}}+(?:{_WRAP}{_LETTER}++)*+|{_LETTER}{{1,15}}+(?:{_WRAP}{_LETTER}++)++)={{0,2}}"
)
_LINE_END = re.compile(_WRAP)
_STANDARD = bytes.maketrans(b"-_", b"+/")
LEAST_RUN = 16
#: No rule matches a shorter layer.
LEAST_LAYER = 12
# gzip, or one of the 32 headers of zlib without a preset dictionary
_ZLIB = [bytes([c, f]) for c in range(0x08, 0x79, 16) for f in range(256) if not f & 32 and (c << 8 | f) % 31 == 0]
_PACKED = re.compile("|".join(["\x1f\x8b\x08", *(re.escape(h.decode("latin-1")) for h in _ZLIB)]), re.DOTALL)
_BZ2 = re.compile(rb"BZh[1-9]1AY&SY")
_WIDE = re.compile(r"(?:[\x01-\x7f]\0){6,}|(?:\0[\x01-\x7f]){6,}")
#: Unpacked bytes are scanned in windows of so many; one begins with the last bytes of that
#: before. A stream inside such a layer is unpacked as far as a window holds it.
MAX_LAYER, OVERLAP = 64 << 20, 1 << 16


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base rules, unsorted."""
    found = []
    raw = text.encode("utf-8", "replace").lower()  # ASCII letters only
    if any(name in raw for name in _NAMES):
        found += [
            (m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE
        ]
    if "AKIA" in text:
        found += [
            (m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS
        ]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


def in_order(spans) -> list[tuple[int, str, int]]:
    """By start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[0], rank[s[1]], s[2]))


def _windows(parts: Iterable[bytes], size: int) -> Iterator[bytes]:
    """Content of any size in overlapping windows."""
    held, overlap = bytearray(), min(OVERLAP, size // 2)
    for part in parts:
        held += part
        while len(held) >= size:
            yield bytes(held[:size])
            del held[: size - overlap]
    if held:
        yield bytes(held)


def _stream(data: bytes, at: int, end: int) -> Iterator[bytes]:
    """Content piece by piece, as far as it is sound; a chunk with damage goes byte by byte."""

    def feed(unpack, chunk: bytes) -> Iterator[bytes]:
        while not unpack.eof:
            new = unpack.decompress(chunk, 1 << 20)
            chunk = unpack.unconsumed_tail
            yield new
            if not chunk and len(new) < 1 << 20:
                break

    while at < end:
        unpack = zlib.decompressobj(wbits=47)
        while at < end and not unpack.eof:
            chunk, before = data[at : min(at + (1 << 14), end)], unpack.copy()
            try:
                parts = list(feed(unpack, chunk))
            except zlib.error:
                try:
                    for i in range(len(chunk)):
                        yield from feed(before, chunk[i : i + 1])
                except zlib.error:
                    pass
                return
            yield from parts
            at += len(chunk) - len(unpack.unused_data)


def _inflate(data: bytes, at: int, limit: int) -> tuple[bytes | None, int, int]:
    """Content of the gzip members or zlib streams from ``at`` on, where they end, and where
    another may start. A damaged or cut stream gives what stands before the damage; the
    content is None beyond the limit."""
    out, size, again = [], 0, at + 1

    def add(new: bytes) -> None:
        nonlocal size
        size += len(new)
        out.append(new) if size <= limit else out.clear()

    def feed(unpack, chunk: bytes) -> None:
        while not unpack.eof:
            new = unpack.decompress(chunk, 1 << 20)
            chunk = unpack.unconsumed_tail
            add(new)
            if not chunk and len(new) < 1 << 20:
                break

    start = at
    while at < len(data) and (at == start or _PACKED.match(data[at : at + 3].decode("latin-1"))):
        unpack = zlib.decompressobj(wbits=47)
        while at < len(data) and not unpack.eof:
            chunk, before, known = data[at : at + (1 << 14)], unpack.copy(), (len(out), size)
            try:
                feed(unpack, chunk)
                at += len(chunk) - len(unpack.unused_data)
            except zlib.error:
                if known[1] <= limit:
                    del out[known[0] :]
                    size = known[1]
                try:
                    for i in range(len(chunk)):
                        at += 1
                        feed(before, chunk[i : i + 1])
                except zlib.error:
                    pass
                return (b"".join(out) if size <= limit else None), at, again
        if not unpack.eof:
            break
        again = at
    return (b"".join(out) if size <= limit else None), at, again


def _raw(data: bytes) -> Iterator[bytes]:
    """Content of the raw deflate stream that ``data`` begins with, then None if the stream is not whole."""
    unpack, at = zlib.decompressobj(wbits=-15), 0
    try:
        while at < len(data) and not unpack.eof:
            chunk = data[at : at + (1 << 14)]
            at += len(chunk)
            while chunk and not unpack.eof:
                yield unpack.decompress(chunk, 1 << 20)
                chunk = unpack.unconsumed_tail
        while not unpack.eof and (new := unpack.decompress(b"", 1 << 20)):
            yield new
    except zlib.error:
        pass
    if not unpack.eof:
        yield None


def _bz2(data: bytes, at: int, stops: list[int]) -> Iterator[bytes]:
    """Content of the bzip2 streams from ``at`` on, as far as they are sound; ``stops`` gets where
    they end and where another may start."""
    again = at + 1
    try:
        while _BZ2.match(data, at):
            unpack = bz2.BZ2Decompressor()
            while at < len(data) and not unpack.eof:
                chunk = data[at : at + (1 << 14)]
                at += len(chunk)
                yield unpack.decompress(chunk, 1 << 20)
                while not unpack.eof and not unpack.needs_input:
                    yield unpack.decompress(b"", 1 << 20)
            at -= len(unpack.unused_data)
            again = at if unpack.eof else again
    except OSError:
        pass
    stops += (at, again)


class _Layer:
    """Text whose character i came from ``starts[i]`` to ``ends[i]`` of the whole text;
    without these, all characters came from ``whole``, and without that, from themselves."""

    def __init__(self, text: str, starts=None, ends=None, whole: tuple[int, int] | None = None) -> None:
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    @property
    def first(self) -> bool:
        return self.starts is None and self.whole is None

    def at(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is not None:
            return int(self.starts[start]), int(self.ends[end - 1])
        return self.whole or (start, end)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is not None:
            return self.starts, self.ends
        of = np.arange(len(self.text) + 1)
        return of[:-1], of[1:]


def _edited(layer: _Layer, edits: list[tuple[int, int, str]]) -> _Layer:
    """The whole text of the layer with each (start, end) replaced by one character."""
    out, pos = [], 0
    for start, end, new in edits:
        out += (layer.text[pos:start], new)
        pos = end
    text = "".join([*out, layer.text[pos:]])
    if layer.whole:
        return _Layer(text, whole=layer.whole)
    starts, ends = layer.places()
    low, high = np.array([e[0] for e in edits]), np.array([e[1] for e in edits])
    step = np.zeros(len(starts) + 2, np.int8)
    step[low + 1] += 1
    step[high] -= 1
    kept = np.cumsum(step, dtype=np.int8)[: len(starts)] == 0
    to = ends.copy()
    to[low] = ends[high - 1]
    return _Layer(text, starts[kept], to[kept])


def _percent(layer: _Layer):
    """The text with all percent escapes decoded in place, so plain keywords before them
    stay. One character a byte: the rules and the encodings are ASCII, as UTF-8 keeps it."""
    if "%" in layer.text and (found := list(_PERCENT.finditer(layer.text))):
        yield _edited(layer, [(m.start(), m.end(), "%" if m[1] else _character(int(m[2] or m[3], 16))) for m in found])


def _character(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _unicode(layer: _Layer):
    """The text with all Unicode, hexadecimal and octal escapes and entities decoded in place."""
    if "\\" not in layer.text and "&" not in layer.text:
        return
    edits = []
    for m in _UNICODE.finditer(layer.text):
        if m["chain"]:
            new = m[0][0]
        elif m["name"]:
            new = _NAMED[m["name"][1:]]
        elif m["octal"]:
            new = chr(int(m["octal"], 8))
        else:
            new = _character(int(m["number"]) if m["number"] else int(next(g for g in m.groups() if g), 16))
        edits.append((m.start(), m.end(), new))
    if edits:
        yield _edited(layer, edits)


def _base64(layer: _Layer):
    """Layers of each run, wrapped lines joined, at all four alignments: groups of four decode
    by themselves, so a value anywhere in the run is whole in one of them. One character a byte."""
    for m in _BASE64.finditer(layer.text):
        if m.end() - m.start() < LEAST_RUN:
            continue
        at, run = np.arange(m.start(), m.end()), m[0]
        if "\n" in run or "\r" in run or "\\" in run:
            kept = np.ones(len(run), bool)
            for end in _LINE_END.finditer(run):
                kept[end.start() : end.end()] = False
            at, run = at[kept], _LINE_END.sub("", run)
        letters = run.rstrip("=").encode().translate(_STANDARD)
        if len(letters) < LEAST_RUN:
            continue
        for by in range(4):
            part = letters[by : len(letters) - ((len(letters) - by) % 4 == 1)]
            data = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
            if len(data) < LEAST_LAYER:
                continue
            text = data.decode("latin-1")
            if layer.whole:
                yield _Layer(text, whole=layer.whole)
                continue
            group = np.arange(len(data)) // 3 * 4 + by
            low, high = at[group], at[np.minimum(group + 3, len(at) - 1)]
            yield _Layer(text, low, high + 1) if layer.first else _Layer(text, layer.starts[low], layer.ends[high])


def _packed(layer: _Layer, limit: int):
    """Content of compressed bytes anywhere in a decoded layer, whichever way it was encoded."""
    if layer.first:
        return
    data, m = layer.text.encode("latin-1", "replace"), _PACKED.search(layer.text)
    size = 0
    for part in _raw(data):
        size = -1 if part is None else size + len(part)
    if size >= LEAST_LAYER:
        for part in _windows(_raw(data), limit):
            yield _Layer(part.decode("latin-1"), whole=layer.at(0, len(data)))
    start = _BZ2.search(data)
    while start:
        stops: list[int] = []
        for _ in _bz2(data, start.start(), stops):
            pass
        for part in _windows(_bz2(data, start.start(), stops), limit):
            yield _Layer(part.decode("latin-1"), whole=layer.at(start.start(), stops[0]))
        start = _BZ2.search(data, stops[1])
    while m:
        out, end, again = _inflate(data, m.start(), limit)
        if out is None:  # beyond one window: unpacked again, window by window
            for part in _windows(_stream(data, m.start(), end), limit):
                yield _Layer(part.decode("latin-1"), whole=layer.at(m.start(), end))
        elif len(out) >= LEAST_LAYER:
            yield _Layer(out.decode("latin-1"), whole=layer.at(m.start(), end))
        m = _PACKED.search(layer.text, again)


def _wide(layer: _Layer):
    """UTF-16 of either order in a decoded layer, its ASCII brought together in place."""
    if layer.first or "\0" not in layer.text:
        return
    edits = []
    for m in _WIDE.finditer(layer.text):
        of = m[0].replace("\0", "")
        edits += [(m.start() + 2 * i, m.start() + 2 * i + 2, c) for i, c in enumerate(of)]
    if edits:
        yield _edited(layer, edits)


def scan(text: str | None, limit: int = MAX_LAYER) -> tuple[list, list]:
    """Base spans and all spans of a text, in order; null counts as empty."""
    text = text or ""
    base = base_spans(text)
    added: set[tuple[int, str, int]] = set()
    seen: set[tuple] = set()
    # one layer a depth is held: the next sibling is made when the one before is done
    work = [iter([_Layer(text)])]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        if not layer.first:
            mark = (hashlib.blake2b(layer.text.encode("utf-8", "replace"), digest_size=16).digest(), layer.at(0, len(layer.text)))
            if mark in seen:
                continue
            seen.add(mark)
            for start, kind, end in base_spans(layer.text):
                a, b = layer.at(start, end)
                added.add((a, kind, b))
        work.append(_decoded(layer, limit))
    return in_order(base), in_order([*base, *added])


def _decoded(layer: _Layer, limit: int) -> Iterator[_Layer]:
    """All layers one decoding away."""
    for decode in (_percent(layer), _unicode(layer), _base64(layer), _packed(layer, limit), _wide(layer)):
        for new in decode:
            if new.text != layer.text:
                yield new


def _listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), limit: int = MAX_LAYER) -> DataFrame:
    """``keys``, counts and digest of the base spans, and all spans of every row.

    Null and empty texts have none. Repeated rows each get a row, null ids too;
    other columns are not read. Spans of equal start are ordered by kind, then end.
    """

    def row(*values):
        base, spans = scan(values[-1], limit)
        kinds = [kind for _, kind, _ in base]
        digest = hashlib.sha256(_listed(base).encode()).hexdigest()
        return (*values[:-1], *map(kinds.count, KINDS), digest, _listed(spans))

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + COLUMNS
    return per_row(docs.select(*keys, "text"), schema, lambda: row)


def redact(text: str | None, limit: int = MAX_LAYER) -> str | None:
    """The text with every stretch of overlapping spans replaced by the kind of its first."""
    if not text:
        return text
    out, at, spans, no = [], 0, scan(text, limit)[1], 0
    while no < len(spans):
        start, kind, end = spans[no]
        no += 1
        while no < len(spans) and spans[no][0] < end:
            end = max(end, spans[no][2])
            no += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, limit: int = MAX_LAYER) -> DataFrame:
    """Every row of ``docs`` with its secrets replaced (see ``redact``). n_chars, where there
    is such a column, follows the text; null texts and all other columns stay."""
    arrow = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            new = [redact(t, limit) for t in texts]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, arrow.field("text").type)
            if "n_chars" in names:
                of = batch.column(names.index("n_chars")).to_pylist()
                sizes = [n if t is None else len(t) for n, t in zip(of, new)]
                columns[names.index("n_chars")] = pa.array(sizes, arrow.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
