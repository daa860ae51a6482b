"""Token counts, binary records."""

import random
import zlib
from itertools import accumulate

import numpy as np
import pytest

from sieveworks.llm.binary_records import frame, masked, parse_payload, payload_of, read_at, read_record, read_records, write_records
from sieveworks.llm.common import new_path
from sieveworks.llm.q_binary_records import vocabulary as word_vocabulary
from sieveworks.llm.q_token_counts import vocabulary as byte_vocabulary
from sieveworks.llm.token_counts import token_counts
from sieveworks.llm.tokenizing import count_pieces, pre_tokens, run_encoder, tokenizer

from .conftest import prose

TEXTS = ["", "  ", "\n\n a  b\t\tc", "a<|endoftext|>b <|startoftext|>X", "İstanbul ΣΑΣ é x́", "漢字 x​z\x1cq\x85w", "I'm they'LL 's's ''s don't", "x" * 3000 + "!!'s", "½²3٣  y", "🙂🙂 a", "\x00\x01a", "Ǆ ß ŉ ẞ", "a\x0bb\x0cc", "token = 'ab'  \r\n\r\n x"]


def test_pieces_sum_to_the_librarys_count():
    path, library = byte_vocabulary(), tokenizer(byte_vocabulary())
    for text in TEXTS:
        assert sum(count_pieces(path, pre_tokens(path, text))) == len(library.encode(text, add_special_tokens=False).ids), text


def test_runs_join_to_the_librarys_ids():
    path, library = word_vocabulary(), tokenizer(word_vocabulary())
    for text in TEXTS:
        assert run_encoder(path).encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("head", [1, 50_000])
def test_token_counts(spark, odd_docs, no_docs, head):
    library = tokenizer(byte_vocabulary())
    rows = odd_docs.select("doc_id", "text").collect() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, byte_vocabulary(), 512, head).collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted((str(i), len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n))
    assert token_counts(no_docs, byte_vocabulary(), 512).count() == 0


def test_records_round_trip(spark, odd_docs, no_docs):
    library, rng = tokenizer(word_vocabulary()), random.Random(6)
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 - i, prose(rng, 30)) for i in range(50)], "doc_id long, text string"))
    files = write_records(docs, new_path(spark, "test-records"), word_vocabulary(), 1, partitions=5)
    got = sorted(read_records(spark, files).collect(), key=lambda r: (r["shard"], r["number"]))
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == list(accumulate([0] + [r["n_tokens"] for r in got]))[:-1]

    def crc(text):
        return zlib.crc32(np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())

    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["ids_crc32"]) for r in got) == sorted(((i is None, i or 0), crc(t)) for i, t in docs.collect())
    first = files.collect()[0]
    doc_id, ids = parse_payload(read_at(first["uri"], first["n_records"] - 1))
    assert len(ids) % 4 == 0 and zlib.crc32(ids) in {r["ids_crc32"] for r in got}
    empty = write_records(no_docs, new_path(spark, "test-records"), word_vocabulary(), 1)
    assert read_records(spark, empty).count() == 0


def test_damage_is_noticed(tmp_path):
    import io

    good = frame(payload_of(7, np.array([1, 70000], np.uint32)))
    assert parse_payload(read_record(io.BytesIO(good))) == (7, np.array([1, 70000], "<u4").tobytes())
    for at in (0, 9, 20, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            read_record(io.BytesIO(bytes(bad)))
    assert masked(b"") == 0xA282EAD8
