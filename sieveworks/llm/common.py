"""Shared plumbing: durable intermediate tables, whole-row packing, column expressions."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that separates words in every contract: space and U+0009..U+000D.
WS = "[\\x20\\x09-\\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: str | None = None
_record: list[str] | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the setting is absent a temporary folder is made, but only if driver and executors are one
    process, as in tests; on a cluster such a folder would be another one on each machine.
    """
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="sieveworks-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _record is not None:
        _record.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths made inside, so that a caller can delete them once its result is written elsewhere."""
    global _record
    before, _record = _record, []
    try:
        yield _record
    finally:
        _record = before


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Delete the tables written inside at the end, but for those passed to the function it yields."""
    global _record
    before, _record = _record, []
    kept: list[str] = []
    try:
        yield lambda *tables: kept.extend(t._sieveworks_path for t in tables)
    finally:
        made, _record = _record, before
        for path in made:
            if path not in kept:
                remove_path(spark, path)
            elif before is not None:
                before.append(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage durably: a lost executor loses nothing that was written.  The shuffle files of the
    write go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._sieveworks_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for table in tables:
        path = getattr(table, "_sieveworks_path", None)
        if path:
            remove_path(table.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so that lambdas do not evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
