"""Query 5.  SQL has no leftmost non-overlapping spans; the tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .secret_scan import find_secrets


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_secret_scans": op5_secret_scans}
SQL: dict[str, str] = {}
