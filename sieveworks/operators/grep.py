"""Pattern search over lines: all rules in one pass, caps in corpus order, fallback tiers, whole-file search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.globs import glob_any
from ..functions.text import path_parts

MAX_MATCHES = 200


@dataclass(frozen=True)
class Rule:
    """One search: lines of files under ``globs`` that match ``pattern``.

    ``label`` names what a match means, ``tier`` orders fallbacks inside a label (the least tier
    that matches anything counts), ``case_sensitive`` and ``every_match`` as they say.
    """

    id: str
    pattern: str
    globs: tuple[str, ...] = ("**/*",)
    label: str = ""
    tier: int = 0
    case_sensitive: bool = False
    every_match: bool = False

    @property
    def java(self) -> str:
        return self.pattern if self.case_sensitive else f"(?iu){self.pattern}"


def _match(rule: Rule) -> Column:
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)) if rule.every_match else F.array(F.regexp_extract(text, rule.java, 0))
    hits = F.transform(found, lambda m, i: F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.label).alias("label"), F.lit(rule.tier).alias("tier"), (i + 1).alias("ordinal"), m.alias("match_text")))
    return F.when(glob_any(F.col("path"), rule.globs) & text.rlike(rule.java), hits)


def grep(lines: DataFrame, rules: list[Rule], shown: str = "text") -> DataFrame:
    """``rule_id, label, tier, path, line, ordinal, line_content, match_text``, uncapped.

    Every rule is tested on each line of one scan; a line that matches several rules gives a row for
    each, so the result is a bag.  ``shown`` is the column that becomes ``line_content``, such as a
    masked form of the line.
    """
    hits = F.flatten(F.filter(F.array(*[_match(r) for r in rules]), lambda m: m.isNotNull()))
    each = lines.select("path", "line", F.col(shown).alias("line_content"), F.explode(hits).alias("m"))
    return each.select("m.rule_id", "m.label", "m.tier", "path", "line", "m.ordinal", "line_content", "m.match_text")


def capped(matches: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` matches of each rule in corpus order (path components, then line).

    The cap is a constant, so Spark cuts each partition before the shuffle.
    """
    order = Window.partitionBy("rule_id").orderBy(path_parts(F.col("path")), "line", "ordinal")
    return matches.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def first_tier(matches: DataFrame) -> DataFrame:
    """Of each label the matches of its least tier."""
    least = matches.groupBy("label").agg(F.min("tier").alias("tier"))
    return matches.join(least, ["label", "tier"], "left_semi")


def grep_whole(files: DataFrame, pattern: str, globs: tuple[str, ...]) -> DataFrame:
    """``path, line_start, line_end, match_text`` of matches that may span lines.

    Offsets are not exposed by the built-in expressions, so batches of files go through Arrow.
    """
    regex = re.compile(pattern, re.I | re.M)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                for m in regex.finditer(text):
                    start = text.count("\n", 0, m.start()) + 1
                    end = text.count("\n", 0, max(m.start(), m.end() - 1)) + 1
                    rows.append((path, start, end, text.split("\n", start)[start - 1].strip()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["path", "line_start", "line_end", "match_text"])

    chosen = files.where(glob_any(F.col("path"), globs)).select("path", "content")
    return chosen.mapInArrow(search, "path string, line_start int, line_end int, match_text string")
