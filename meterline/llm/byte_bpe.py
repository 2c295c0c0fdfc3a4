"""Byte-level BPE by a global shuffle of distinct words.

1. Tasks split texts into pre-tokens and number their positions inside a block of
   documents. Pre-tokens are exploded already combined: a distinct word of a block
   stands once, with its positions, and the words that share a shard (by hash) are
   one compressed row.
2. Rows meet by shard, so each distinct word of the whole input is encoded once and
   its ids join the positions of every block that has it. A word that is frequent
   in its block sends a number instead of its positions, which travel with the
   block: a hot word costs its task a few bytes a block.
   They do so as the sequence of the words' numbers, the most frequent first, with
   open positions for rare words; so passages that repeat in a block are packed well.
3. Rows meet again by block, where ids are put at their positions.

Decoding is a join with the table of token bytes. That table has as many rows as
the vocabulary, a fixed number, so it is sent to all tasks. ``decode`` joins the ids
of rows. Where texts are encoded and decoded in one job, a task of step 2 gives each
distinct id of its words once as a row; these rows are joined with the table, words
are spelt from what the join gave, and a word's bytes go where its ids go, to every
block that has it. So decoding shuffles nothing more but words of blocks.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import arrow_schema, table

#: Code points after which a block of documents is closed.
BLOCK = 20_000_000
#: Occurrences in a block from which positions travel with the block.
FREQUENT = 4


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values, seven bits a byte, and each value's number of bytes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        if not (more := values >> np.uint64(7 * k)).any():
            break
        sizes += more > 0
    out = np.zeros(int(sizes.sum()), np.uint8)
    at = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        part = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = part.astype(np.uint8) | ((sizes[has] > k + 1).astype(np.uint8) << 7)
    return out, sizes


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, and the place of each one's last byte."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    values = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        has = starts + k <= ends
        values[has] |= (data[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return values, ends


def _small(values: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the values."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _packed(value) -> bytes:
    return zstandard.compress(pickle.dumps(value, 5), 9)


def _unpacked(data: bytes):
    return pickle.loads(zstandard.decompress(data))


class _Splitter:
    """Task of step 1: a row for each shard of a block's words, and one of its documents."""

    SCHEMA = "shard int, block long, head boolean, payload binary"

    def __init__(self, pattern: str, keys: int, block: int, frequent: int, shards: int) -> None:
        self.pattern, self.keys, self.block, self.frequent, self.shards = pattern, keys, block, frequent, shards

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(self.pattern).findall
        self.no = TaskContext.get().partitionId() << 28
        self._start()
        for batch in batches:
            for at, text in enumerate(batch.column(self.keys).to_pylist()):
                words = split(text or "")
                known = self.known
                for word in dict.fromkeys(words):
                    if word not in known:
                        known[word] = len(known)
                self.tokens.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                self.rows.append(batch.slice(at, 1))
                self.size += len(text or "")
                if self.size >= self.block:
                    yield from self._close()
            if self.rows:  # keep the keys, let go of the texts
                own = pa.Table.from_batches([r.select(range(self.keys)) for r in self.rows])
                self.owners.append(own.combine_chunks())
                self.rows = []
        yield from self._close()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens: list[np.ndarray] = []
        self.rows: list[pa.RecordBatch] = []
        self.owners: list[pa.Table] = []
        self.size = 0

    def _close(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self.owners.append(pa.Table.from_batches([r.select(range(self.keys)) for r in self.rows]).combine_chunks())
        if not self.tokens:
            return
        owners = pa.concat_tables(self.owners).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, owners.schema) as out:
            out.write_table(owners)
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        spelt = [w.encode() for w in self.known]
        shard = np.fromiter((zlib.crc32(w) % self.shards for w in spelt), np.int64, len(spelt))
        # words are renumbered shard by shard, in order, so neighbours compress together
        in_order = np.array(sorted(range(len(spelt)), key=spelt.__getitem__), np.int64)
        by_shard = in_order[np.argsort(shard[in_order], kind="stable")]
        rank = np.empty(len(spelt), np.int32)
        rank[by_shard] = np.arange(len(spelt), dtype=np.int32)
        tokens, spelt, shard = rank[np.concatenate(self.tokens)], [spelt[i] for i in by_shard.tolist()], shard[by_shard]
        counts = np.bincount(tokens, minlength=len(spelt))
        # frequent words have numbers from 1, in falling order of their counts
        often = np.flatnonzero(counts >= self.frequent)
        number = np.zeros(len(spelt), np.int32)
        number[often[np.argsort(-counts[often], kind="stable")]] = np.arange(1, len(often) + 1, dtype=np.int32)
        stream = number[tokens]
        rare = tokens[stream == 0]
        order = np.argsort(rare, kind="stable").astype(np.int32)  # open positions word by word, each in order
        counts = np.bincount(rare, minlength=len(spelt))
        first = (np.cumsum(counts) - counts)[counts > 0]
        steps = order.copy()
        steps[1:] -= order[:-1]
        steps[first] = order[first]
        # a rare word packs 0 and its steps, a frequent one its number
        each = 1 + counts
        at = np.cumsum(each) - each
        values = np.zeros(int(each.sum()), np.int64)
        values[at] = number
        rest = np.ones(len(values), bool)
        rest[at] = False
        values[rest] = steps
        data, sizes_of = varints(values)
        lengths = np.add.reduceat(sizes_of, at) if len(spelt) else np.zeros(0, np.int64)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        block, self.no = self.no, self.no + 1
        head = (sink.getvalue().to_pybytes(), _small(sizes), varints(stream)[0])
        rows = [(block % self.shards, block, True, _packed(head))]
        edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(spelt)] if len(spelt) else []
        for a, b in zip(edges, edges[1:]):
            part = spelt[a:b]
            payload = (
                _small(np.fromiter(map(len, part), np.int64, b - a)),
                b"".join(part),
                _small(lengths[a:b]),
                data[bounds[a] : bounds[b]].tobytes(),
            )
            rows.append((int(shard[a]), block, False, _packed(payload)))
        types = (pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["shard", "block", "head", "payload"]
        )
        self._start()


class _Encoder:
    """Task of step 2: rows in order of their shard in, (block, head, payload, ids) out.

    With ``decoding``, a row with all ids that the task has not used before goes ahead
    of the block that uses them.
    """

    SCHEMA = "block long, head boolean, payload binary, ids array<int>"

    def __init__(self, sent, pattern: str, decoding: bool) -> None:
        self.sent, self.pattern, self.decoding = sent, pattern, decoding
        self.arrow = arrow_schema(self.SCHEMA)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = self.sent.value
        encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=of, special_tokens={})
        encode = encoding._encode_single_piece
        used = np.zeros(max(of.values(), default=-1) + 1, bool)

        class Ids(dict):
            def __missing__(self, word: bytes) -> list[int]:
                ids = self[word] = encode(word)
                return ids

        known, last = Ids(), None
        for batch in batches:
            for shard, block, head, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != last:  # no later shard has a word of this one
                    known, last = Ids(), shard
                rows = []
                if not head:
                    sizes, joined, lengths, data = _unpacked(payload)
                    ends = np.cumsum(sizes, dtype=np.int64).tolist()
                    ids = [known[joined[a:b]] for a, b in zip([0, *ends[:-1]], ends)]
                    n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
                    flat = np.fromiter((x for y in ids for x in y), np.int64, int(n_ids.sum()))
                    payload = _packed((_small(n_ids), _small(flat), lengths, data))
                    if self.decoding and len(fresh := np.unique(flat[~used[flat]])):
                        used[fresh] = True
                        rows = [(None, None, None, fresh)]
                rows.append((block, head, payload, None))
                columns = zip(zip(*rows), self.arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=self.arrow)


def _speller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined rows (block, head, payload, id, bytes) in, (block, head, payload) out.

    Rows of ids come before the blocks that use them; a task holds as many as the
    vocabulary has at most. The bytes of a block's words end its payload.
    """
    spell: dict[int, bytes] = {}
    for batch in batches:
        for block, head, payload, no, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if no is not None:
                if piece is None:
                    raise ValueError(f"the token table lacks id {no}")
                spell[no] = piece
                continue
            if not head:
                n_ids, flat, *rest = _unpacked(payload)
                pieces = [spell[x] for x in flat.tolist()]
                ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))
                of_word = np.concatenate(([0], ends[np.cumsum(n_ids, dtype=np.int64)]))
                payload = _packed((n_ids, flat, *rest, _small(np.diff(of_word)), b"".join(pieces)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([head]), pa.array([payload], pa.binary())],
                names=["block", "head", "payload"],
            )


def _positions(counts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Sums of the steps inside each run of ``counts`` values."""
    total = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0)
    return total - np.repeat(before, counts)


def reassemble(
    payloads: list[tuple[bool, bytes]],
) -> tuple[pa.Table, list[list[int]], list[bytes], list[np.ndarray]]:
    """A block's keys, the ids of its distinct words, their decoded bytes (if they were
    decoded), and each document's word numbers."""
    head = next(p for is_head, p in payloads if is_head)
    keys, sizes, stream = _unpacked(head)
    chunks = [_unpacked(p) for is_head, p in payloads if not is_head]
    owners = pa.ipc.open_stream(keys).read_all()
    sizes = sizes.astype(np.int64)
    stream, _ = from_varints(stream)
    word_at = np.full(int(sizes.sum()), -1, np.int64)
    ids_of: list[list[int]] = []
    spelt: list[bytes] = []
    if chunks:
        n_ids = np.concatenate([c[0].astype(np.int64) for c in chunks])
        ids = np.concatenate([c[1].astype(np.int64) for c in chunks]).tolist()
        lengths = np.concatenate([c[2].astype(np.int64) for c in chunks])
        data = np.frombuffer(b"".join(c[3] for c in chunks), np.uint8)
        ends = np.cumsum(n_ids).tolist()
        ids_of = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        for _, _, _, _, *decoded in chunks:
            if decoded:
                of_words, joined = decoded
                ends = np.cumsum(of_words, dtype=np.int64).tolist()
                spelt += [joined[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        values, at = from_varints(data)
        entry_end = np.searchsorted(at, np.cumsum(lengths) - 1) + 1  # values up to each word's end
        entry_start = np.concatenate(([0], entry_end[:-1]))
        lead = values[entry_start]
        counts = entry_end - entry_start - 1
        rest = np.ones(len(values), bool)
        rest[entry_start] = False
        open_at = np.flatnonzero(stream == 0)
        word_at[open_at[_positions(counts[counts > 0], values[rest])]] = np.repeat(np.arange(len(counts)), counts)
        of_number = np.full(int(max(lead.max(initial=0), stream.max(initial=0))) + 1, -1, np.int64)
        of_number[lead] = np.arange(len(lead))
        often = stream > 0
        word_at[often] = of_number[stream[often]]
    if (word_at < 0).any():
        raise RuntimeError("a block lacks ids of some positions")
    bounds = np.cumsum(sizes)
    return owners, ids_of, spelt, np.split(word_at, bounds[:-1]) if len(sizes) else []


def encode(
    docs: DataFrame,
    finish,
    schema: str,
    keys: tuple[str, ...] = ("doc_id",),
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    block: int = BLOCK,
    frequent: int = FREQUENT,
    shards: int | None = None,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """``keys`` and the columns of ``schema`` for every row of ``docs``.

    ``finish(ids_of, spelt, words)`` runs once a block and returns an iterator
    with a tuple of ``schema`` for each of its documents: ids_of are the ids of the
    block's distinct words, spelt the bytes that they decode to by ``tokens`` (see
    ``token_table``; without it nothing is decoded and spelt is empty), words their
    numbers for each document. An id that ``tokens`` lacks is an error.
    ``shards`` should grow with the input, as the shuffle partitions it follows do.
    Null texts count as empty. Repeated rows and null keys each get their row. Other
    columns are not read. An empty table gives no row. A very long text is a block of
    its own: the tasks of steps 1 and 3 hold its words' numbers, about 30 bytes a word.
    """
    spark = docs.sparkSession
    of = ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    sent = spark.sparkContext.broadcast(of)  # as many rows as the vocabulary
    kinds = dict(docs.dtypes)
    full = "".join(f"`{k}` {kinds[k]}, " for k in keys) + schema
    arrow = arrow_schema(full)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitter = _Splitter(pattern, len(keys), block, frequent, shards)
    by_shard = docs.select(*keys, "text").mapInArrow(splitter, _Splitter.SCHEMA).repartition("shard").sortWithinPartitions("shard")
    encoded = by_shard.mapInArrow(_Encoder(sent, pattern, tokens is not None), _Encoder.SCHEMA)
    if tokens is None:
        encoded = encoded.select("block", "head", "payload")
    else:
        pieces = encoded.select("block", "head", "payload", F.explode_outer("ids").alias("id"))
        # neither the explosion nor the join with a table sent to all tasks moves a row
        joined = pieces.join(F.broadcast(tokens.select("id", "bytes")), "id", "left")
        joined = joined.select("block", "head", "payload", "id", "bytes")
        encoded = joined.mapInArrow(_speller, "block long, head boolean, payload binary")

    def run(part: pa.Table) -> pa.Table:
        held = list(zip(part.column("head").to_pylist(), part.column("payload").to_pylist()))
        owners, ids_of, spelt, words = reassemble(held)
        rows = list(finish(ids_of, spelt, words))
        new = zip(*rows) if rows else [[] for _ in arrow][len(keys) :]
        columns = [*owners.columns, *[pa.array(c, f.type) for c, f in zip(new, list(arrow)[len(keys) :])]]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return encoded.groupBy("block").applyInArrow(run, full)


def _ids(ids_of, spelt, words):
    for of in words:
        yield ([i for w in of.tolist() for i in ids_of[w]],)


def encode_ids(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keys`` and ids (array of int) of every row's text."""
    return encode(docs, _ids, "ids array<int>", keys, **options)


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, bytes) of the vocabulary."""
    of = ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return spark.createDataFrame([(i, bytearray(b)) for b, i in of.items()], "id int, bytes binary")


def decode(encoded: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bytes) of each row's ids: exploded with positions, joined with the token table,
    and put together in order. ``key`` must be unique; empty ids give empty bytes; an
    id outside the vocabulary gives null."""
    rows = encoded.select(key, F.posexplode_outer("ids").alias("at", "id"))
    joined = rows.join(F.broadcast(tokens.withColumn("known", F.lit(True))), "id", "left")
    part = F.hex(F.coalesce("bytes", F.lit(b"")))
    whole = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("part")))), lambda p: p["part"]), ""
    )
    lost = F.coalesce(F.max(F.col("id").isNotNull() & F.col("known").isNull()), F.lit(False))
    return joined.groupBy(key).agg(F.when(~lost, F.unhex(whole)).alias("bytes"))


def _digests(ids_of, spelt, words):
    shown = [",".join(map(str, ids)) for ids in ids_of]
    n_ids = np.fromiter(map(len, ids_of), np.int64, len(ids_of))
    for of in words:
        at = of.tolist()
        yield (
            int(n_ids[of].sum()),
            hashlib.sha256(",".join([shown[i] for i in at]).encode()).hexdigest(),
            hashlib.sha256(b"".join([spelt[i] for i in at])).hexdigest(),
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    docs = table(spark, sf_dir, "documents")
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode(docs, _digests, schema, tokens=token_table(spark))
