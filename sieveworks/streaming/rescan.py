"""Incremental grep over a folder of Parquet files (an extension).

New files are matched as they arrive; each batch appends its matches and a change count, so totals never
need the whole corpus again.  Exactly-once comes from the checkpoint and a folder per batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.grep import Rule, grep
from ..sources.corpus import Corpus


def follow(spark: SparkSession, folder: str, schema: str, path: Column, text: Column, rules: list[Rule], out: str, checkpoint: str) -> StreamingQuery:
    """Match rules on rows that appear in ``folder``; matches go to ``out``, batch by batch, until nothing is new."""
    arriving = spark.readStream.schema(schema).parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        found = grep(Corpus.from_table(rows, path, text).lines, rules)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
