"""WARC archives: write pages with revisits and segments, read them back and reassemble.

Writing.  Of pages with equal payloads (SHA-1 and length) the one with the largest id is a
``response`` and the others ``revisit`` it; payloads below ``min_revisit_bytes`` are all responses.
HTTP blocks are framed in chunks, and a block longer than ``segment_bytes`` is cut into a first record and
``continuation`` records that name it as their origin.  Records are gzip members of files of about
``file_bytes``; each file is written under a temporary name and renamed.

Reading.  Whole records are finished where they are parsed.  Segments are grouped by origin
identifier (one record's own segments, so a group is never larger than a record), ordered by
segment number, checked for gaps and against the total length that the last one states, joined, and
the chunked framing is undone.  Digests are recomputed from the decoded payload.

Defined results: null html is an empty payload; a null url is left out of the header; a null id is
written as ``null`` and read back as null, and never the record others refer to; rows that share the
largest id and the payload are all responses; identical rows give as many records.  Other columns are
not read.  A record that fails a check raises an error that names it.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import written
from .files import create, make_dir, opened

CRLF = b"\r\n"
DATE = "2000-01-01T00:00:00Z"


@dataclass(frozen=True)
class Layout:
    segment_bytes: int = 16384
    chunk_bytes: int = 4096
    file_bytes: int = 32 << 20
    min_revisit_bytes: int = 0


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (data[i : i + size] for i in range(0, len(data), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(data: bytes) -> bytes:
    """Undo chunked framing; extensions after a size and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.index(CRLF, at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if data[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(data[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.0\r\n" + lines.encode() + CRLF + block + CRLF + CRLF


def page_records(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, layout: Layout) -> Iterator[bytes]:
    """The records of one page; ``keeper``: the page this one revisits, or None."""
    digest = base32_sha1(payload)
    name = f"urn:page:{'null' if page_id is None else page_id}:{digest}"
    fields = [] if url is None else [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))]
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if keeper is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{keeper}:{digest}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("Payload-Length", str(len(payload)))]
        yield record("revisit", name, fields, b"")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, layout.chunk_bytes)
    fields.append(("Content-Type", "application/http; msgtype=response"))
    parts = [block[i : i + layout.segment_bytes] for i in range(0, len(block), layout.segment_bytes)]
    if len(parts) > 1:
        fields.append(("WARC-Segment-Number", "1"))
    yield record("response", name, fields, parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        yield record("continuation", f"{name}:{i}", [("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(i)), *last], part)


def with_keepers(pages: DataFrame, layout: Layout) -> DataFrame:
    """Adds ``keeper``: the id of the response that a page revisits, else null.

    Only payloads that occur more than once are joined back, by two plain shuffles that AQE can
    split where one payload has a large share of the rows.
    """
    body = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha1(body).alias("_sha1"), F.octet_length(body).alias("_bytes"))
    shared = keyed.where(F.col("_bytes") >= layout.min_revisit_bytes).groupBy("_sha1", "_bytes").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    shared = written(shared.select("_sha1", "_bytes", "_last"), "shared-payloads")
    keeper = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_last")), F.col("_last"))
    return keyed.join(shared, ["_sha1", "_bytes"], "left").select("page_id", "url", "html", keeper.alias("keeper"))


def write_archives(pages: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:
    """Write ``pages(page_id, url, html)``; returns the list of files (``uri``), a written table."""
    make_dir(folder)
    rows = with_keepers(pages.select(F.col("page_id").cast("long"), "url", "html"), layout)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        todo = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        row = next(todo, None)
        while row is not None:
            uri, size = posixpath.join(folder, f"pages-{part:06d}-{number:04d}.warc.gz"), 0
            with create(uri) as f:
                while row is not None and size < layout.file_bytes:
                    for data in page_records(row[0], row[1], (row[2] or "").encode("utf-8", "replace"), row[3], layout):
                        member = zlib.compressobj(1, zlib.DEFLATED, 31)
                        size += f.write(member.compress(data) + member.flush())
                    row = next(todo, None)
            number += 1
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_bytes": pa.array([size], pa.int64())})

    return written(rows.mapInArrow(write, "uri string, n_bytes long"), "archive-files")


def parse(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a file, read as a stream."""
    with opened(uri) as f:
        raw, data, inflate = b"", b"", zlib.decompressobj(31)
        while raw or (raw := f.read(1 << 16)):
            data += inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                head, _, rest = data.partition(CRLF + CRLF)
                lines = head.decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record in {uri}")
                fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                size = int(fields["content-length"])
                if rest[size:] != CRLF + CRLF:
                    raise ValueError(f"{fields['warc-record-id']} does not end where its length says")
                yield fields, rest[:size]
                data, inflate = b"", zlib.decompressobj(31)
        if data:
            raise ValueError(f"{uri} ends inside a record")


def payload_from(block: bytes) -> bytes:
    head, _, body = block.partition(CRLF + CRLF)
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def reassemble(name: str, segments: list[tuple[int, int | None, bytes]]) -> list[bytes]:
    """Blocks of a segmented record: one for each first segment (identical records share a name)."""
    ordered = sorted(segments, key=lambda s: s[0])
    parts = {number: block for number, _, block in ordered}
    total = next((t for _, t, _ in ordered if t is not None), None)
    block = b"".join(parts.values())
    if list(parts) != list(range(1, len(parts) + 1)) or total != len(block):
        raise ValueError(f"segments of {name} are missing")
    return [block] * sum(number == 1 for number, _, _ in ordered)


_RAW = "name string, kind string, refers string, digest string, n_bytes long, segment int, total long, block binary"
_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _id(name: str | None) -> int | None:
    text = name.split(":")[2] if name else "null"
    return None if text == "null" else int(text)


def _finished(name: str, block: bytes, stated: str | None) -> tuple:
    payload = payload_from(block)
    digest = base32_sha1(payload)
    if stated is not None and stated != digest:
        raise ValueError(f"the payload of {name} does not have the stated digest")
    return name, "response", None, digest, len(payload), None, None, None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["name", "kind", "refers", "digest", "n_bytes", "segment", "total", "block"])


def read_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row per page record of the listed files, which are dealt out one to a task."""
    listed = files.select("uri").repartition(max(1, files.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for fields, block in parse(uri):
                    name, kind = fields["warc-record-id"].strip("<>"), fields["warc-type"]
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                    if kind == "revisit":
                        out.append((name, kind, fields["warc-refers-to"].strip("<>"), digest, int(fields["payload-length"]), None, None, None))
                    elif number is None:
                        out.append(_finished(name, block, digest))
                    else:
                        origin = fields.get("warc-segment-origin-id", name).strip("<>")
                        out.append((origin, kind, None, digest, None, int(number), None if total is None else int(total), block))
                    if len(out) >= 500:
                        yield _rows(out)
                        out = []
        if out:
            yield _rows(out)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, segments in zip(batch.column(0).to_pylist(), batch.column(1)):
                for block in reassemble(name, [(s["segment"], s["total"], s["block"]) for s in segments.as_py()]):
                    out.append(_finished(name, block, name.rpartition(":")[2]))
            if out:
                yield _rows(out)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            yield pa.RecordBatch.from_arrays(
                [pa.array([_id(n) for n in x["name"]], pa.int64()), batch.column(4), batch.column(3), batch.column(1), pa.array([_id(n) for n in x["refers"]], pa.int64())],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    raw = written(listed.mapInArrow(read, _RAW), "archive-records")
    whole = raw.where("segment IS NULL")
    grouped = raw.where("segment IS NOT NULL").groupBy("name").agg(F.collect_list(F.struct("segment", "total", "block")).alias("segments"))
    return whole.unionByName(grouped.mapInArrow(join, _RAW)).mapInArrow(pages, _PAGES)
