"""Digests of a collection and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def content_digests(files: DataFrame) -> DataFrame:
    """``path, digest`` of each file's UTF-8 text."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


def fold(rows: DataFrame, line, order: str) -> DataFrame:
    """``digest, n``: SHA-256 over all lines joined in order.

    The lines meet in one row: right for listings of up to about a million files.  Beyond, use
    :func:`bucketed_fold`.
    """
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("_all"), F.count("*").alias("n"))
    return listed.select(F.sha2(F.array_join(F.transform("_all", lambda x: x["line"]), "").cast("binary"), 256).alias("digest"), "n")


def bucketed_fold(rows: DataFrame, line, order: str, buckets: int = 4096) -> DataFrame:
    """``digest, n`` as a two-level fold: lines by hashed bucket, then the buckets' digests."""
    bucket = F.pmod(F.xxhash64(order), F.lit(buckets))
    level = rows.groupBy(bucket.alias("_b")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("_all"), F.count("*").alias("n"))
    level = level.select("_b", "n", F.sha2(F.array_join(F.transform("_all", lambda x: x["line"]), "").cast("binary"), 256).alias("d"))
    top = level.agg(F.array_sort(F.collect_list(F.struct("_b", "d"))).alias("_all"), F.sum("n").alias("n"))
    return top.select(F.sha2(F.array_join(F.transform("_all", lambda x: x["d"]), "").cast("binary"), 256).alias("digest"), "n")


def differences(left: DataFrame, right: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """``key, change``: what is missing, added or changed between two listings."""
    a = left.select(key, F.col(digest).alias("_a"))
    b = right.select(key, F.col(digest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where(F.col("change").isNotNull())
