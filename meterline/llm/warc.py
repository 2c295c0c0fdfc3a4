"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. Reading tasks get byte ranges of files.
A task looks for gzip magic in its range, takes a candidate only if it decodes to
a whole WARC record (version line, headers, block of the stated length, checksum)
and is followed by the end of the file or by another such header, and then goes on
member by member. It owns the records that start inside its range and reads past
the range's end to finish the last one. A task holds one record at a time.

Archives are opened through their own file system (``pyarrow.fs``), in the shared
folder. A writing task gives its files names of its own; a file counts only once
the manifest row of a successful task names it, so lost or repeated attempts leave
unread files and never double records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import arrow_schema, cut, table
from meterline.session import shared_folder

#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_SHARED = 100
#: Bytes after which a task starts its next archive, and bytes of a reading range.
FILE_BYTES, RANGE_BYTES = 256 << 20, 16 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
#: Bytes in which a record's version line ends; headers may be of any length.
_VERSION_LINE = 64
#: Reading ranges up to which each gets a task; beyond, tasks take up to ``_RANGES`` of them.
_TASKS, _RANGES = 4096, 8


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to of every row of ``pages``.

    Of rows with equal payloads of ``LEAST_SHARED`` bytes or more, those of the
    smallest page_id keep it (repeated rows of that id all do) and the others refer
    to it. Null ids are larger than others; null html is an empty payload.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.filter(F.octet_length("payload") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "first")
    )
    return rows.join(shared, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if refers_to is not None else payload)
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:  # a header line holds no control characters
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = 6) -> DataFrame:
    """Archives of ``rows`` (see ``with_revisits``) in ``folder``; gives the manifest
    (file, bytes, records) of what successful tasks wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(record(*row)) + pack.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "bytes", "records"])

    columns = rows.select("page_id", "url", "payload", "digest", "refers_to")
    return cut(columns.mapInArrow(run, "file string, bytes long, records long"), "warc-manifest")


class Archive:
    """Members of one archive file, found from any byte on."""

    def __init__(self, source, size: int) -> None:
        self.source, self.size = source, size

    def member(self, at: int) -> tuple[dict[str, str], bytes, int] | None:
        """Headers, block and end of the record whose member starts at ``at``; None if none does."""
        unpack, data, pos = zlib.decompressobj(31), bytearray(), at
        headers = length = body = None
        seen = 0  # bytes without the end of the headers
        while not unpack.eof:
            chunk = self.source.read_at(min(1 << 16, self.size - pos), pos) if pos < self.size else b""
            if not chunk:
                return None
            pos += len(chunk)
            try:
                data += unpack.decompress(chunk)
            except zlib.error:
                return None
            if headers is None:
                if data[:5] != b"WARC/"[: len(data[:5])]:
                    return None
                if len(data) >= _VERSION_LINE and b"\r\n" not in data[:_VERSION_LINE]:
                    return None
                if (end := data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                    seen = len(data)
                    continue
                headers, body = _headers(bytes(data[:end])), end + 4
                if headers is None or not headers.get("content-length", "").isdigit():
                    return None
                length = int(headers["content-length"])
        if headers is None or len(data) != body + length + 4 or data[-4:] != b"\r\n\r\n":
            return None
        return headers, bytes(data[body : body + length]), pos - len(unpack.unused_data)

    def begins(self, at: int) -> bool:
        """True at the end of the file or where a member decodes to a WARC version line."""
        if at >= self.size:
            return True
        try:
            return zlib.decompressobj(31).decompress(self.source.read_at(min(4096, self.size - at), at), 5) == b"WARC/"
        except zlib.error:
            return False

    def records(self, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """(offset, headers, block) of the records that start in [start, end)."""
        at, in_step = start, start == 0
        while at < end:
            if not in_step and (at := self._magic(at, end)) < 0:
                return
            found = self.member(at)
            if found is None or not (in_step or self.begins(found[2])):
                if in_step:
                    raise ValueError(f"no WARC record at byte {at}")
                at += 1
                continue
            yield at, found[0], found[1]
            at, in_step = found[2], True

    def _magic(self, at: int, end: int) -> int:
        """First gzip magic that starts in [at, end); -1 if none."""
        while at < end:
            chunk = self.source.read_at(min((1 << 20) + 2, self.size - at), at)
            if (i := chunk.find(_MAGIC)) >= 0:
                return at + i if at + i < end else -1
            if len(chunk) < (1 << 20) + 2:
                return -1
            at += 1 << 20
        return -1


def _headers(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        return None
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


RECORD = (
    "file string, offset long, page_id long, record_type string, target_uri string, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """``RECORD`` [and payload] of every record of the manifest's files.

    A response's size and digest are those of the payload read, and the digest must
    be the recorded one; a revisit has no payload and gives those of its headers.
    Tasks grow with the bytes: one a range, and for over ``_TASKS`` ranges one for
    ``_RANGES`` at most. A task holds one record; headers may be of any length.
    """
    schema = RECORD + ", payload binary" * with_payload
    arrow = arrow_schema(schema)
    ranges = manifest.select(
        "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes))).alias("start")
    )
    # a number given here is kept; without one all ranges, tiny as rows, would be merged into one task
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(int(max(min(n, _TASKS), -(-n // _RANGES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as source:
                    rows, held = [], 0
                    for at, headers, block in Archive(source, size).records(start, min(size, start + range_bytes)):
                        rows.append(_row(file, at, headers, block, with_payload))
                        held += len(block) if with_payload else 500
                        if held > 8 << 20:
                            yield _batch(rows, arrow)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, arrow)

    return ranges.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _row(file: str, at: int, headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "revisit":
        size, payload = int(re.search(rb"(?i)content-length:\s*(\d+)", head)[1]), None
    else:
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != stated:
            raise ValueError(f"digest differs from the payload at byte {at} of {file}")
    refers = headers.get("warc-refers-to")
    row = (
        file,
        at,
        _page(headers["warc-record-id"]),
        headers["warc-type"],
        headers.get("warc-target-uri"),
        size,
        stated,
        None if refers is None else _page(refers),
    )
    return row + (payload,) * with_payload


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and reads them back; see ``with_revisits``.

    Repeated rows and null ids each keep a record; url and other columns may be null
    or clash with nothing, as only page_id, url and html are read. Empty in, empty out.
    """
    manifest = write(with_revisits(table(spark, sf_dir, "pages")), shared_folder(spark, "warc"))
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h FROM pages
), s AS (
    SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id,
       strlen(h)::BIGINT AS payload_bytes,
       sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first
            THEN first END AS refers_to
FROM s
"""
