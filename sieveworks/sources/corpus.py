"""A corpus: files with paths and texts, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.redact import sanitize
from ..functions.text import ancestors, base_name, digest, parent_path, split_lines


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in even parts for all cores, or by ``keys``.

    A file of short rows is read by few tasks, however many rows it has and whatever is made from them.
    """
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


@dataclass(frozen=True)
class Corpus:
    """``files(path, content)`` and, by column pruning, no more than a plan needs of them.

    A null content is a file that cannot be read: it is listed and holds no lines.
    """

    files: DataFrame

    @classmethod
    def from_table(cls, table: DataFrame, path: Column, text: Column) -> Corpus:
        return cls(table.select(path.alias("path"), F.regexp_replace(text, "\\r\\n?", "\n").alias("content")))

    @cached_property
    def lines(self) -> DataFrame:
        """``path, line, text`` with lines counted from one."""
        each = self.files.where(F.col("content").isNotNull()).select("path", F.posexplode(split_lines(F.col("content"))).alias("_at", "text"))
        return each.select("path", (F.col("_at") + 1).alias("line"), "text")

    @cached_property
    def safe_lines(self) -> DataFrame:
        """:attr:`lines` with ``safe_text``, the line of the file masked as a whole: context decides what is secret."""
        pairs = F.arrays_zip(split_lines(F.col("content")).alias("text"), split_lines(sanitize("content")).alias("safe_text"))
        each = self.files.where(F.col("content").isNotNull()).select("path", F.posexplode(pairs).alias("_at", "_l"))
        return each.select("path", (F.col("_at") + 1).alias("line"), F.col("_l.text").alias("text"), F.coalesce("_l.safe_text", F.lit("")).alias("safe_text"))

    @cached_property
    def dirs(self) -> DataFrame:
        """``path, name, parent, depth`` of every directory above a file."""
        paths = self.files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
        return paths.select("path", base_name(F.col("path")).alias("name"), parent_path(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"))

    @cached_property
    def listing(self) -> DataFrame:
        """``path, size, line_count, digest`` of every file; the digest is of its UTF-8 text."""
        content = F.col("content")
        return self.files.select("path", F.octet_length(content).cast("long").alias("size"), F.size(split_lines(content)).cast("long").alias("line_count"), digest(content).alias("digest"))
