"""Vector best-fit packing of tokenised documents into sequences.

A sequence (bin) has three capacities: tokens, documents, and attention cost (the
sum of squared piece lengths). Pieces come in decreasing length; each goes to the
bin that fits it under every constraint and is best by the chosen rule: the
largest weighted dot product of its demand with the bin's residual, or the
smallest weighted norm of the residual that would be left. If none fits, a new
bin opens.

Pieces of full length are bins by themselves. The others are dealt into groups of
about ``group`` pieces and each group is packed in a task of its own; a group
leaves one or two bins partly filled, so the loss does not depend on the input's
size. Only the pieces' numbers travel: token ids stay where they were made.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterline.llm.common import WordTable, cut, table

CAPACITY, END = 2048, 0
#: Pieces that one task packs together, on average.
GROUP = 8192
#: Weights of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.02, 0.02)

# The vocabulary's pattern of words, for lower-case words that only have
# printable ASCII and the composed letters of two Latin blocks (all of them letters
# that the normal form leaves alone and whose lower case is one letter).
_SIMPLE = re.compile("[\\x20-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]*")
_LETTER = "a-z\u00df-\u00f6\u00f8-\u017e"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")
#: Distinct words and word parts that a task remembers before it starts afresh.
MEMORY = 800_000


class WordIds:
    """Token ids of words without ASCII white space.

    The vocabulary never joins across white space, and its normal form works on
    single words, so words are encoded one by one. Simple words need lower case,
    the pattern and the byte alphabet; others go through the tokenizer's own
    normalisation and splitting.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.known: dict[str, list[int]] = {}
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.alphabet = {c: split(chr(c))[0][0] for c in range(0xC0, 0x17F) if chr(c).isalpha()}

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        if len(self.known) > MEMORY:
            self.known.clear()
        joined = b" ".join(words).decode()
        if not _SIMPLE.fullmatch(joined):
            return [self._ids(w) for w in joined.split(" ")]
        alphabet = self.alphabet
        return [
            self._of(parts if w.isascii() else [p.translate(alphabet) for p in parts])
            for w in joined.lower().split(" ")
            if (parts := _PARTS.findall(w)) is not None
        ]

    def _ids(self, word: str) -> list[int]:
        if _SIMPLE.fullmatch(word):
            return self._of([p.translate(self.alphabet) for p in _PARTS.findall(word.lower())])
        normal = self.tokenizer.normalizer.normalize_str(word)
        return self._of([p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)])

    def _of(self, parts: list[str]) -> list[int]:
        out, known = [], self.known
        for part in parts:
            if (ids := known.get(part)) is None:
                ids = known[part] = [t.id for t in self.model.tokenize(part)]
            out += ids
        return out


PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    path: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """``keys``, piece, start, length, ids_crc32, slot [, ids] of every row's pieces.

    A row's ids are those of its text (null: none) and then ``END``. ``slot`` is a
    number of the piece that spreads equal and neighbouring rows alike.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kinds = dict(docs.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + PIECES + ", slot long"
    names = [*keys, "piece", "start", "length", "ids_crc32", "slot"]
    types = {"piece": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(WordIds(path), np.uint32, MEMORY)
        slot = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            of, rows, ids_of = [], [], []
            for at, text in enumerate(batch.column(len(keys)).to_pylist()):
                split = (text or "").encode().split()
                ids = words.gather(words.numbers(split))
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for no, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    slot += 1
                    of.append(at)
                    rows.append((no, start, len(piece), zlib.crc32(piece.tobytes()), slot))
                    if with_ids:
                        ids_of.append(piece.astype(np.int32))
            if rows:
                own = batch.select(range(len(keys))).take(pa.array(of)).columns
                new = [pa.array(c, types.get(n, pa.int64())) for n, c in zip(names[len(keys) :], zip(*rows))]
                more = [pa.array(ids_of, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*own, *new, *more], names=names + ["ids"] * with_ids)

    return docs.select(*keys, "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)


def fit(
    lengths: np.ndarray,
    capacities: tuple[float, float, float],
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces that fit no empty bin get one of their own."""
    lengths = np.asarray(lengths, np.int64)
    most, scale = np.array(capacities, np.float64), np.array(weights) / np.array(capacities)
    left = np.empty((3, max(1, len(lengths))))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = np.zeros(max(1, len(lengths)), np.int64)
    live = np.empty(0, np.int64)  # bins with room for the smallest piece
    opened = 0
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min() if len(lengths) else 0
    for rank, i in enumerate(order.tolist()):
        n = int(lengths[i])
        need = np.array([n, 1, n * n], np.float64)
        room = left[:, live]
        able = np.flatnonzero((room >= need[:, None]).all(axis=0))
        if len(able):
            rest = room[:, able] - need[:, None]
            if rule == "dot":
                score = -((room[:, able] * scale[:, None]) * (need * scale)[:, None]).sum(axis=0)
            else:
                score = ((rest * scale[:, None]) ** 2).sum(axis=0)
            at = live[able[score.argmin()]]
        else:
            at, left[:, opened] = opened, most
            live, opened = np.append(live, opened), opened + 1
        bins[i], offsets[i] = at, used[at]
        used[at] += n
        left[:, at] -= need
        if rank % 64 == 0:
            live = live[(left[0, live] >= least) & (left[1, live] >= 1) & (left[2, live] >= least**2)]
    return bins, offsets


def pack(
    found: DataFrame,
    capacity: int = CAPACITY,
    documents: int | None = None,
    attention: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    group: int = GROUP,
) -> DataFrame:
    """``found`` (see ``pieces``) without slot, with sequence_id and offset.

    ``documents`` and ``attention`` bound a sequence's pieces and squared lengths;
    None leaves only what ``capacity`` implies. A piece that exceeds a bound alone
    gets a sequence of its own. Pieces tie by their slot. Empty in, empty out.
    """
    most = (capacity, documents or capacity, attention or float(capacity) ** 2)
    found = cut(found, "pieces")
    rest = found.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    columns = [c for c in found.columns if c != "slot"]
    kinds = dict(found.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long"

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("slot")
        bins, offsets = fit(part.column("length").to_numpy(), most, weights, rule)
        ids = bins + (int(key[0].as_py()) + 1 << 32)
        out = part.select(columns)
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    dealt = rest.withColumn("__group", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    packed = dealt.groupBy("__group").applyInArrow(
        lambda key, part: run(key, part.drop_columns(["__group"])), schema
    )
    # full pieces have negative numbers, packed groups positive ones
    whole = found.filter(F.col("length") >= capacity).select(
        *columns, (-F.col("slot") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place.

    A null or empty text is the end token alone. Repeated rows are packed each by
    itself; null ids are kept. Other columns are not read.
    """
    return pack(pieces(table(spark, sf_dir, "documents")))
