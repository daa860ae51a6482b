"""Aggregates with a stated order: first seen, sorted, capped, prioritised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_seen(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with ``first``, the place of their first occurrence."""
    return rows.groupBy(value).agg(F.min(F.struct(*order)).alias("first"))


def joined_first_seen(rows: DataFrame, keys: list[str], value: str, order: list[str], sep: str = ", ") -> DataFrame:
    """One row per key: its distinct values in order of first occurrence, joined (``summary``)."""
    distinct = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    listed = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", value))).alias("_all"))
    return listed.select(*keys, F.array_join(F.transform("_all", lambda x: x[value]), sep).alias("summary"))


def sorted_names(rows: DataFrame, keys: list[str], value: str, most: int | None = None) -> DataFrame:
    """One row per key: its distinct values sorted (``names``), the first ``most``, and ``n_names``."""
    distinct = rows.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    counted = rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_names"))
    shown = distinct
    if most:
        shown = distinct.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("_n") <= most)
    listed = shown.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_all"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = counted.join(listed.select(*[F.col(k).alias(f"_{k}") for k in keys], "_all"), same, "left")
    return out.select(*keys, F.coalesce(F.array_join("_all", ", "), F.lit("")).alias("names"), "n_names")


def counted_groups(rows: DataFrame, key: str, order: list[str], most: int | None = None) -> DataFrame:
    """``key, n, place``: groups by descending count, ties by first occurrence; ``place`` from one.

    Places run over all groups; with ``most`` each task keeps its first groups only.
    """
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "_first"))
    ranked = counted.withColumn("_n", place)
    if most:
        ranked = ranked.where(F.col("_n") <= most)
    return ranked.select(key, "n", F.col("_n").cast("long").alias("place"))


def claimed_by(value: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """The first group with a keyword inside the value, else null."""
    out = F.lit(None).cast("string")
    for name, words in reversed(groups):
        out = F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(value), w)), F.lit(name)).otherwise(out)
    return out


def all_hold(rows: DataFrame, keys: list[str], holds: Column) -> DataFrame:
    """``keys, complete``: whether the condition holds on every row (a null does not)."""
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("complete"))


def resolved(rows: DataFrame, key: str, names: DataFrame, alias: str, name: str) -> DataFrame:
    """``rows`` with ``resolved``: the name that ``names`` gives for the key, else the key itself."""
    found = names.select(F.col(alias).alias(key), F.col(name).alias("_name"))
    return rows.join(found, key, "left").withColumn("resolved", F.coalesce("_name", F.col(key))).drop("_name")


def edges(rows: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct edges without loops."""
    return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()
