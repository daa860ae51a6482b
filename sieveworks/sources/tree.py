"""A directory tree as a Spark data source: ``spark.read.format("source_tree").load(root)``.

File sources of Spark skip names that begin with a dot or an underscore, which hold CI and ignore files;
this one lists them.  The driver lists, tasks read.  Links are not followed, pruned directories and
binary suffixes are left out, texts are decoded as UTF-8 with replacement, line ends become ``\\n``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .build_files import settings_facts
from .corpus import Corpus

# Directories that are never entered, suffixes that are never read.
PRUNED = frozenset([".git", ".gradle", ".idea", "build", "node_modules", ".cxx", ".kotlin", ".sieveworks"])
BINARY = frozenset([".apk", ".aab", ".jar", ".class", ".png", ".jpg", ".jpeg", ".gif", ".mp4", ".mov", ".zip", ".rar", ".webp", ".ico"])
PART_BYTES = 16 << 20


def outermost(root: str, excluded: Sequence[str]) -> list[str]:
    """Excluded paths below the root, absolute, without those inside another; others cannot matter and go."""
    base = os.path.realpath(root)
    inside = sorted({p for p in (os.path.realpath(os.path.join(base, e)) for e in excluded) if os.path.commonpath([base, p]) == base}, key=lambda p: (p.count(os.sep), p))
    return [p for i, p in enumerate(inside) if not any(p.startswith(q.rstrip(os.sep) + os.sep) for q in inside[:i])]


def walk(root: str, excluded: Sequence[str] = ()) -> Iterator[tuple[str, str, os.stat_result]]:
    """``(relative path, absolute path, stat)`` of each regular file, in order of path components."""
    left_out = set(outermost(root, excluded))
    todo = [] if os.path.realpath(root) in left_out else [("", os.path.realpath(root))]
    while todo:
        prefix, folder = todo.pop()
        below = []
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            relative = f"{prefix}{entry.name}"
            if entry.is_symlink() or os.path.normpath(entry.path) in left_out or any(ord(c) < 32 or c in ":\\" for c in entry.name):
                continue
            if entry.is_dir():
                if entry.name not in PRUNED:
                    below.append((f"{relative}/", entry.path))
            elif entry.is_file() and os.path.splitext(entry.name)[1].lower() not in BINARY:
                yield relative, entry.path, entry.stat()
        todo += reversed(below)


def decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, str, int, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.text = options.get("text", "true") == "true"
        self.excluded = [e for e in options.get("exclude", "").split(",") if e]

    def partitions(self) -> Sequence[InputPartition]:
        parts: list[list[tuple[str, str, int, int]]] = [[]]
        size = 0
        for relative, path, stat in walk(self.root, self.excluded):
            if size > PART_BYTES or len(parts[-1]) > 5000:
                parts.append([])
                size = 0
            parts[-1].append((relative, path, stat.st_size, stat.st_mtime_ns))
            size += stat.st_size
        return [_Part(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for relative, path, size, mtime in partition.files:
            content = None
            if self.text:
                try:
                    descriptor = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
                    with os.fdopen(descriptor, "rb") as f:
                        content = decoded(f.read())
                except OSError:
                    content = None
            yield relative, size, mtime, content


class SourceTree(DataSource):
    """Options: ``path``, ``text`` (false lists without reading), ``exclude`` (paths below the root, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, size long, mtime_ns long, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, text: bool = True, exclude: Sequence[str] = ()) -> DataFrame:
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("text", str(text).lower())
    if exclude:
        reader = reader.option("exclude", ",".join(exclude))
    return reader.load(root)


def open_tree(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> Corpus:
    return Corpus(read_tree(spark, root, exclude=exclude))


def project_name(spark: SparkSession, root: str) -> str:
    """What the first settings script with a name says, else the directory's name."""
    for name in ("settings.gradle.kts", "settings.gradle"):
        found = read_tree(spark, root).where(F.col("path") == name).first()
        told = next((n for kind, n, _ in settings_facts(found["content"] or "") if kind == "root_name"), None) if found else None
        if told:
            return told
    return os.path.basename(os.path.realpath(root))


def project_roots(root: str, markers: Sequence[str] = ("settings.gradle.kts", "settings.gradle")) -> list[str]:
    """Directories that hold a settings script, nearest the root first, then by path."""
    found = {os.path.dirname(p) for p, _, _ in walk(root) if os.path.basename(p) in markers}
    return sorted(found, key=lambda d: (d.count("/") + bool(d), d.split("/")))
