"""The pipeline's stages on cases planted in a small table, and every query's registration."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

from .conftest import prose
from .test_groups import shingle_set


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    out = tmp_path_factory.mktemp("sf")
    bench = prose(rng, 40, 5000)
    base = prose(rng, 120, 5000)
    near = base.split()
    near[60] = "other"
    docs = [(i, prose(rng, 120, 5000), "en", f"s{i % 3}", 1) for i in range(40)]
    docs += [(100, base, "en", "s0", 1), (101, base, "fr", "s1", 1), (102, " ".join(near), "en", "s2", 1), (103, prose(rng, 60, 5000) + " " + bench, "en", "s0", 1), (104, "too short", "en", "s0", 1), (105, None, None, None, None), (106, "again and again " * 40, "en", "s1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages_decide(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = {r["doc_id"] for r in docs.collect()}
    clean = set(range(40))
    assert left["quality rules"] == clean | {100, 101, 102, 103}
    assert left["MinHash near-dedup"] == clean | {100, 103}
    assert left["benchmark decontamination"] == left["mixing"] == left["binary output"] == clean | {100}
    run = corpus_pipeline.run(spark, folder).collect()
    assert {tuple(r) for r in run} == {tuple(r) for r in docs.collect()} and min(r["start"] for r in run) == 0


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_stages_take_odd_rows(spark, folder, odd_docs, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names go through all stages."""
    docs, rows = odd_docs, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == odd_docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs, before = spark.read.parquet(f"{tmp_path}/{k}"), rows
        rows = sorted((str(r["doc_id"]) for r in docs.collect()))
        assert rows == {0: ["5", "6", "7", "7", "None"]}.get(k, ["5", "7", "7", "None"]) and (before is None or len(rows) <= len(before))


def test_the_last_stage_needs_the_order_of_the_mix(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    with pytest.raises(ValueError, match="order of the mix"):
        corpus_pipeline.token_records(spark, docs.groupBy("doc_id").agg(F.max("text").alias("text")), folder)
    listed = spark.createDataFrame([(3, "a b"), (1, "c"), (2, None)], "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in corpus_pipeline.token_records(spark, listed, folder).orderBy("start").collect()] == [3, 1, 2]


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def jaccard(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y)


def test_near_copies_from_four_fifths_on(spark):
    rng = random.Random(13)
    docs, gone = [], set()
    for i in range(60):
        base = prose(rng, 120, 5000).split()
        changed = list(base)
        places = (20, 60, 100) if i % 3 == 2 else (20, 60)
        for k in places:
            changed[k] = f"n{i}"
        share = jaccard(" ".join(base), " ".join(changed))
        assert 0.75 < share < 0.8 if i % 3 == 2 else 0.8 <= share < 0.85
        gone |= {2 * i + 1} if i % 3 < 2 else set()
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(changed))]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - gone
