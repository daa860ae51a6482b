"""A training corpus from raw documents: quality, near copies, benchmark leaks, mix, token records.

``STAGES`` lists the stages in order.  Each function takes ``(spark, docs, sf_dir)``; ``docs`` is what
the stage before kept, written as Parquet and read again.  All but the last return the columns of ``docs``.
The mix shows in the order of its rows: files, and rows inside them, ascend by slot, and the last stage
writes token records in that order.  Every stage passes on columns of any name and gives an empty table for an
empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sieveworks.llm.binary_records import read_records, write_records
from sieveworks.llm.common import new_path, recorded, remove_path, table
from sieveworks.llm.decontaminate import keep_clean
from sieveworks.llm.mixing import mixed
from sieveworks.llm.near_dedup import Join, keep_one
from sieveworks.llm.q_binary_records import END_ID, vocabulary
from sieveworks.llm.q_quality_rules import good_labels
from sieveworks.llm.quality_rules import keep_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies of the corpus share four fifths of their five-word shingles; the 85 of query 7 is its own.
#: In simulated pairs at exactly 0.80, 12 trees of full depth miss 9 of 1000 and 20 trees 1 of 1000.
NEAR = Join(percent=80, trees=20)

#: Tables that earlier stages wrote on the way to their results.
_leftovers: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """Run a stage and delete what earlier stages wrote, unless ``docs`` still reads it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _leftovers else []
        for path in [p for p in _leftovers if not any(p.removeprefix("file://") in f for f in read)]:
            remove_path(spark, path)
            _leftovers.remove(path)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _leftovers.extend(made)
        return out

    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality rules keep; null and empty texts go, each repeated row is judged alike, a null language is one of its own."""
    return keep_documents(docs, good_labels(table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group; null ids, null and empty texts stay, and so do identical rows of a kept document."""
    return keep_one(docs, NEAR)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, an empty benchmark clears all."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix; a null source is one of its own, a null or empty text counts one byte."""
    return mixed(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all rows, in the order of the mix.

    Documents that come from files are taken by file number and row in it, whatever tasks read them;
    documents of a table in memory by their rows.  A plan over files that hides their rows is an error.
    """
    folder = new_path(spark, "token-records")
    if docs.inputFiles():
        try:
            placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        except AnalysisException as hidden:
            raise ValueError("the order of the mix is in files and rows: read the stage before as it was written") from hidden
    else:
        placed = docs.select("doc_id", "text", F.lit("").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    order = [F.regexp_extract("_file", r"part-(\d+)", 1).try_cast("long"), F.col("_file"), F.col("_row")]
    files = write_records(placed, folder, vocabulary(), END_ID, order)
    return read_records(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", _tidy(quality)),
    ("MinHash near-dedup", _tidy(near_copies)),
    ("benchmark decontamination", _tidy(benchmark_leaks)),
    ("mixing", _tidy(mix)),
    ("binary output", _tidy(token_records)),
]

#: Near-dedup, mixing and tokenizing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = new_path(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
