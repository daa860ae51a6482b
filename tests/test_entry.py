"""The driver contract without the training-text part; streams."""

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveworks import session
from sieveworks.operators.grep import Rule
from sieveworks.plans import fact_queries, queries
from sieveworks.streaming.rescan import follow

ROOT = Path(__file__).parent.parent


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) >= 45


def test_sessions_keep_a_given_master(monkeypatch):
    for name in ("MASTER", "PYSPARK_GATEWAY_PORT", "PYSPARK_SUBMIT_ARGS"):
        monkeypatch.delenv(name, raising=False)
    assert not session._master_given()
    for name, value in (("PYSPARK_GATEWAY_PORT", "1"), ("MASTER", "yarn"), ("PYSPARK_SUBMIT_ARGS", "--master yarn pyspark-shell"), ("PYSPARK_SUBMIT_ARGS", "--conf spark.master=yarn pyspark-shell")):
        with monkeypatch.context() as m:
            m.setenv(name, value)
            assert session._master_given()


def test_entry_imports_without_the_optional_part():
    code = "import sys\nfor m in ('sieveworks.llm', 'corpus_pipeline'): sys.modules[m] = None\nimport __spark_entry__ as e\nassert 'pipeline' not in e.queries() and len(e.queries()) == len(e.base.QUERIES)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = Path("/root/testdata/sf0.001")
    if not folder.is_dir():
        pytest.skip("no test data")
    database = duckdb.connect()
    for path in folder.glob("*.parquet"):
        database.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def plain(rows):
        return sorted(repr(tuple(r)) for r in rows)

    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, str(folder))
        expected = database.execute(sql)
        columns = [c[0] for c in expected.description]
        assert sorted(columns) == sorted(got.columns), name
        assert plain(got.select(*columns).collect()) == plain(expected.fetchall()), name


def test_files_made_from_a_small_table_are_spread(spark, tmp_path):
    spark.range(1000).selectExpr("id AS p_partkey", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("catalog_entries", "catalog_libraries"):
            sizes = [n for n in queries.QUERIES[name](spark, str(tmp_path)).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
            assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes), name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_scanned_tree_is_spread(spark, tmp_path):
    spark.range(1000).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    sizes = [n for n in fact_queries._tree(spark, str(tmp_path)).files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_postings_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([(1, "One fooBar one"), (2, None), (1, "one")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["tokenize_tf"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, "bar", 1), (1, "foo", 1), (1, "foobar", 1), (1, "one", 3)]
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L?, term", plan)


def test_a_stream_matches_what_arrives(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in (1, 2):
        spark.createDataFrame([(part, f"line {part}\nhit {part}")], "id long, text string").write.mode("append").parquet(source)
        query = follow(spark, source, "id long, text string", F.col("id").cast("string"), F.col("text"), [Rule("hit", "hit")], out, f"{tmp_path}/check")
        query.awaitTermination(60)
        assert spark.read.parquet(out).count() == part
