"""Token ids as length-delimited binary records, with an offset index beside each file.

A record file holds, for each document, ``length`` (unsigned 64 bit), the masked checksum of those
eight bytes, the payload and the payload's masked checksum, all little-endian.  The checksum is
CRC-32; masking rotates it right by 15 bits and adds a constant, so that checksums of data that hold
checksums stay sound.  The payload is a flag byte (1: id present, 2: four-byte ids), the document id
(signed 64 bit) and the token ids in two bytes each where the vocabulary allows, else in four.  The
index file ``NAME.idx`` holds each record's offset (unsigned 64 bit), so that a reader can shuffle.

Files are numbered in ascending order of document id and so are the records in each; documents with
equal ids are ordered by their texts.  Each file is written under a temporary name and renamed, and
the list of files is written once as a table, so a lost executor costs only its unfinished files.

Defined results: a null or empty text gives the end id alone; a null document id sorts first and is
read back as null; repeated rows give repeated records; an empty table gives no files.  Only the
id, the text and the ordering columns are read, whatever else there is.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import written
from .files import create, make_dir, opened
from .tokenizing import run_encoder

_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_FLAGS = struct.Struct("<Bq")
READ_BATCH = 2000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + _TAIL.pack(masked(length)) + payload + _TAIL.pack(masked(payload))


def payload_of(doc_id: int | None, ids) -> bytes:
    """``ids``: a numpy array of unsigned 32-bit integers."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    flags = (doc_id is not None) | 2 * wide
    return _FLAGS.pack(flags, doc_id or 0) + (ids if wide else ids.astype("<u2")).tobytes()


def parse_payload(payload: bytes) -> tuple[int | None, bytes]:
    """Document id and ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    flags, doc_id = _FLAGS.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_FLAGS.size)
    return doc_id if flags & 1 else None, ids.astype("<u4").tobytes()


def read_record(f) -> bytes | None:
    """The next payload of an open record file, checked; None at its end."""
    head = f.read(_HEAD.size)
    if not head:
        return None
    length, crc = _HEAD.unpack(head)
    if crc != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    body = f.read(length + 4)
    if len(body) != length + 4 or _TAIL.unpack_from(body, length)[0] != masked(body[:length]):
        raise ValueError("a record is damaged")
    return body[:length]


def read_at(uri: str, number: int) -> bytes:
    """Record ``number`` of a file through its index."""
    with opened(uri + ".idx") as f:
        f.seek(8 * number)
        (offset,) = struct.unpack("<Q", f.read(8))
    with opened(uri) as f:
        f.seek(offset)
        return read_record(f)


_WRITTEN = "shard int, uri string, n_records long, n_tokens long, n_bytes long"
_READ = "shard int, number long, doc_id long, start long, n_tokens long, ids_crc32 long"


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, order: list[Column] | None = None, partitions: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files in ``folder``; returns their list, a written table.

    ``order`` (default: id, then text) is the order of records across all files.
    """
    import numpy as np

    make_dir(folder)
    keys = order or [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    dealt = keys[:2] if order is None else keys
    sortable = docs.select("doc_id", "text", *[k.alias(f"_k{i}") for i, k in enumerate(dealt)])
    names = [F.col(f"_k{i}") for i in range(len(dealt))]
    ranged = sortable.repartitionByRange(partitions, *names) if partitions else sortable.repartitionByRange(*names)
    tail = [F.col("text")] if order is None else [F.col("doc_id"), F.col("text")]
    ranged = ranged.sortWithinPartitions(*names, *tail).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        uri = posixpath.join(folder, f"tokens-{shard:06d}.rec")
        encoder, end = run_encoder(vocabulary), np.array([end_id], "<u4")
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        tokens = at = 0
        offsets: list[int] = []
        with create(uri) as f:
            for batch in _chain(first, batches):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.concatenate([np.frombuffer(encoder.encode(text.as_py() or ""), "<u4"), end])
                    record = frame(payload_of(doc_id, ids))
                    f.write(record)
                    offsets.append(at)
                    at += len(record)
                    tokens += len(ids)
        with create(uri + ".idx") as f:
            f.write(np.array(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [uri], "n_records": [len(offsets)], "n_tokens": [tokens], "n_bytes": [at]})

    return written(ranged.mapInArrow(write, _WRITTEN), "record-files")


def _chain(first, rest):
    yield first
    yield from rest


def read_records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row per record, from the files: place, id, first token's number, tokens and CRC-32 of ids.

    The list of files (one row for each writing task) goes to the driver to number the tokens.
    """
    rows = sorted(files.select("shard", "uri", "n_tokens").collect(), key=lambda r: r["shard"])
    starts = accumulate((r["n_tokens"] for r in rows), initial=0)
    todo = [(r["shard"], r["uri"], s) for r, s in zip(rows, starts)]
    listed = spark.createDataFrame(todo, "shard int, uri string, start long").repartition(max(1, len(todo)), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["start"], []
                with opened(row["uri"]) as f:
                    while (payload := read_record(f)) is not None:
                        doc_id, ids = parse_payload(payload)
                        n = len(ids) // 4
                        out.append((row["shard"], len(out) if not out else out[-1][1] + 1, doc_id, at, n, zlib.crc32(ids)))
                        at += n
                        if len(out) > READ_BATCH:
                            yield _batch(out[:-1])
                            out = out[-1:]
                if out:
                    yield _batch(out)

    return listed.mapInArrow(read, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int32(), *[pa.int64()] * 5]
    names = ["shard", "number", "doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
