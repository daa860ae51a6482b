"""Inventories: distinct items in first-seen order, completeness, pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

LIMIT = 5000
PAGE_DEFAULT, PAGE_MAX, SEARCH_MAX = 100, 200, 50


def items(findings: DataFrame, keys: list[str], value: str, order: list[str], most: int | None = None) -> DataFrame:
    """``keys, ordinal, value, n_evidence``: distinct values per key numbered from 0 by first occurrence.

    With ``most`` only the first values of each key are numbered, and each task sends no more than those.
    """
    distinct = findings.groupBy(*keys, F.col(value).alias("value")).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("n_evidence"))
    place = Window.partitionBy(*keys).orderBy("_first", "value")
    numbered = distinct.withColumn("_n", F.row_number().over(place))
    if most:
        numbered = numbered.where(F.col("_n") <= most)
    return numbered.withColumn("ordinal", (F.col("_n") - 1).cast("long")).drop("_first", "_n")


def with_limit(found: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """``keys, n_items, completeness, stop_reason``: one item beyond the limit shows that there are more."""
    seen = found.where(F.col("ordinal") <= limit).groupBy(*keys).agg(F.count("*").alias("_n"))
    over = F.col("_n") > limit
    return seen.select(
        *keys,
        F.least("_n", F.lit(limit)).cast("long").alias("n_items"),
        F.when(over, F.lit("incomplete")).otherwise(F.lit("complete")).alias("completeness"),
        F.when(over, F.lit(f"collection limit {limit} reached")).alias("stop_reason"),
    )


def checked_cursor(cursor: str | None, total: int) -> int:
    """Offset of a cursor: a decimal without sign or leading zero, at most the total."""
    if cursor is None:
        return 0
    if not re.fullmatch(r"0|[1-9][0-9]*", cursor, re.A) or int(cursor) > total:
        raise ValueError("invalid cursor")
    return int(cursor)


def clamped(n: int, most: int) -> int:
    return max(1, min(n, most))


def page(found: DataFrame, keys: list[str], offset: int, limit: int | None) -> DataFrame:
    """Items of one page with ``total`` and ``next_cursor`` (null on the last page)."""
    if limit is not None and limit <= 0:
        raise ValueError("a page holds at least one item")
    total = found.groupBy(*keys).agg(F.count("*").alias("total"))
    inside = F.col("ordinal") >= offset
    if limit is not None:
        inside = inside & (F.col("ordinal") < offset + limit)
    end = F.lit(offset + limit if limit is not None else 2**62)
    return found.where(inside).join(total, keys).withColumn("next_cursor", F.when(end < F.col("total"), end.cast("string")))


def with_evidence(found: DataFrame, evidence: DataFrame, on: list[str]) -> DataFrame:
    """Items that kept evidence; the others go."""
    return found.join(evidence, on, "left_semi")
