"""The registered queries on the smallest test tables, against their SQL or brute force."""

import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import accumulate
from math import ceil, floor
from pathlib import Path

import numpy as np
import pytest

from sieveworks.llm import queries
from sieveworks.llm.q_binary_records import vocabulary as word_vocabulary
from sieveworks.llm.q_token_counts import vocabulary as byte_vocabulary
from sieveworks.llm.secret_scan import KINDS, sha256_of
from sieveworks.llm.tokenizing import tokenizer

from .test_groups import brute_components
from .test_scans import brute_spans

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows(spark, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, str(FOLDER)).collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    database = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        database.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, expected = queries.queries()[name](spark, str(FOLDER)), database.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(repr(tuple(r)) for r in expected.fetchall())


def test_token_counts(spark, docs):
    library = tokenizer(byte_vocabulary())
    expected = {i: len(e.ids) for i, e in zip(docs, library.encode_batch([r["text"] for r in docs.values()], add_special_tokens=False))}
    got = rows(spark, "op4_token_counts")
    assert {i: (r["n_tokens"], r["n_bytes"], r["over_limit"]) for i, r in got.items()} == {i: (n, len(docs[i]["text"].encode()), n > 512) for i, n in expected.items()}


def test_secret_scans(spark, docs):
    got = rows(spark, "op5_secret_scans")
    assert set(got) == set(docs)
    for i, r in got.items():
        spans = brute_spans(docs[i]["text"])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x == k for _, _, x in spans) for k in KINDS] and r["base_sha256"] == sha256_of(spans)
        shown = [s for s in r["spans"].split(",") if s and not s.startswith("random:")]
        assert shown == [f"{k}:{a}:{b}" for a, b, k in spans]


def test_near_dedup(spark, docs):
    got = rows(spark, "op7_near_dedup")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components([(i, r["text"]) for i, r in docs.items()])
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_token_records(spark, docs):
    library, got = tokenizer(word_vocabulary()), rows(spark, "op8_token_records")
    order = sorted(docs)
    ids = [np.array([*e.ids, 1], "<u4") for e in library.encode_batch([docs[i]["text"] for i in order], add_special_tokens=False)]
    starts = accumulate((len(x) for x in ids), initial=0)
    assert {i: tuple(got[i])[1:] for i in got} == {i: (s, len(x), zlib.crc32(x.tobytes())) for i, x, s in zip(order, ids, starts)}


def brute_schedule(weights, blocks):
    """Slot by slot: of the next blocks that are released, the one due first (then the first name)."""
    total, at, out, slot = sum(weights.values()), dict.fromkeys(weights, 0), {}, 0
    while len(out) < sum(blocks.values()):
        due = [(ceil((at[s] + 1) * total / w), s) for s, w in weights.items() if at[s] < blocks[s] and floor(at[s] * total / w) <= slot]
        if due:
            _, s = min(due)
            out[s, at[s]] = slot
            at[s] += 1
        slot += 1
    return out


def test_mixing(spark, docs):
    got = rows(spark, "op9_mixing")
    assert set(got) == set(docs)
    bytes_of = defaultdict(int)
    for r in docs.values():
        bytes_of[r["source"]] += len(r["text"].encode())
    slots = brute_schedule({s: Fraction(float(n) ** 0.5) for s, n in bytes_of.items()}, {s: -(-n // 65536) for s, n in bytes_of.items()})
    assert all(r["slot"] == slots[r["source"], r["block"]] for r in got.values())
    by = defaultdict(list)
    for i, r in got.items():
        by[r["source"]].append((r["start"], len(docs[i]["text"].encode()), r))
    for own in by.values():
        own.sort(key=lambda x: x[0])
        assert [s for s, *_ in own] == list(accumulate([0] + [n for _, n, _ in own]))[:-1]
        assert all(r["block"] == s // 65536 and r["release"] <= r["slot"] < r["deadline"] for s, _, r in own)
