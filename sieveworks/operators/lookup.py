"""Files and directories by name, priority and what lies below them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.globs import glob_any
from ..functions.text import ancestors, path_parts


def glob(files: DataFrame, globs: list[str]) -> DataFrame:
    return files.where(glob_any(F.col("path"), globs))


def find_first(paths: DataFrame, wanted: list[str]) -> DataFrame:
    """The first of ``wanted`` that exists among ``paths(path)``."""
    rank = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col("path"))
    return paths.where(F.col("path").isin(wanted)).orderBy(rank).limit(1)


def find_dirs(dirs: DataFrame, names: list[str]) -> DataFrame:
    return dirs.where(F.col("name").isin(names))


def nearest_root(dirs: DataFrame) -> DataFrame:
    """The shallowest directory, ties by path components."""
    return dirs.orderBy("depth", path_parts(F.col("path"))).limit(1)


def dirs_with_files(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Directories with one of ``files`` anywhere below: an equality join on each file's ancestors."""
    above = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return dirs.join(above, "path", "left_semi")


def files_below(files: DataFrame) -> DataFrame:
    """``dir, n_files``: how many files lie anywhere below each directory."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n_files"))


def named_children(dirs: DataFrame, parent_name: str, reserved: list[str], must_hold: list[str]) -> DataFrame:
    """Children of directories called ``parent_name`` that hold one of ``must_hold`` and have no reserved name."""
    parents = dirs.where(F.col("name") == parent_name).select(F.col("path").alias("parent"))
    children = dirs.join(parents, "parent").where(~F.col("name").isin(reserved))
    inner = dirs.where(F.col("name").isin(must_hold)).select(F.col("parent").alias("path")).distinct()
    return children.join(inner, "path", "left_semi")
