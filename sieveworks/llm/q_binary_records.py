"""Query 8.  SQL has no tokenizer; the tests hold it against the library and the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .binary_records import read_records, write_records
from .common import new_path, table

END_ID = 1


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = write_records(docs, new_path(spark, "token-records"), vocabulary(), END_ID)
    return read_records(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op8_token_records": op8_token_records}
SQL: dict[str, str] = {}
