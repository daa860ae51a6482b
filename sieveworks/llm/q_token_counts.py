"""Query 4.  SQL has no tokenizer; the tests hold it against the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .token_counts import token_counts

LIMIT = 512


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), LIMIT)


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
