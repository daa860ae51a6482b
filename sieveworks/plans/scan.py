"""A scan: every detector over a corpus, as one evidence table and one section table.

All line probes run in a few passes of many rules over one table of lines; whole-file patterns, path
probes and substring gates add their rows; reducers turn rows into sections.  The number of sections is
fixed, so the result is small whatever the corpus.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.globs import glob_any
from ..operators import grep
from ..operators.sections import EVIDENCE_LIMIT, accepted, capped_evidence
from ..sources import build_files
from ..sources.corpus import Corpus
from . import structured
from .registry import DETECTORS, LAYERS, Detector, Probe

#: Rules of one pass; more would make a single expression too large to compile.
RULES_A_PASS = 48
_COLUMNS = "section string, probe int, label string, counts boolean, rule_id string, path string, line int, line_end int, line_content string, match_text string, provenance string"


def broken(spark: SparkSession) -> set[str]:
    """Detectors with a pattern that does not compile.  They are left out, so that one of them fails alone."""
    compile_one = spark.sparkContext._jvm.java.util.regex.Pattern.compile

    def fails(p: Probe) -> bool:
        try:
            re.compile(p.pattern) if p.kind == "whole" else compile_one(p.pattern)
        except (re.error, IllegalArgumentException):
            return True
        return False

    return {d.id for d in DETECTORS if any(fails(p) for p in d.probes if p.pattern)}


def _probes(kind: str, without: set[str] = frozenset()) -> list[tuple[Detector, int, Probe]]:
    return [(d, i, p) for d in DETECTORS for i, p in enumerate(d.probes) if p.kind == kind and d.id not in without]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _line_matches(lines: DataFrame) -> DataFrame:
    """All line matches of all probes and structured rules, fallbacks resolved."""
    where, rules = {}, []
    for n, (d, i, p) in enumerate(_probes("lines", broken(lines.sparkSession))):
        rules.append(grep.Rule(f"p{n}", p.pattern, p.globs, label=f"{d.id}/{p.pattern}", tier=p.tier, case_sensitive=p.case_sensitive))
        where[f"p{n}"] = (d.id, i, p.label)
    rules += structured.RULES
    passes = [grep.grep(lines, rules[i : i + RULES_A_PASS], "safe_text") for i in range(0, len(rules), RULES_A_PASS)]
    found = _union(passes).persist(StorageLevel.MEMORY_AND_DISK)  # read for the least tiers and for its rows
    spark = lines.sparkSession
    names = spark.createDataFrame([(k, *v) for k, v in where.items()], "rule_id string, section string, probe int, name string")
    tiered = {r.label for r in rules if r.tier}
    plain, falling = found.where(~F.col("label").isin(*tiered)), found.where(F.col("label").isin(*tiered))
    both = plain.unionByName(grep.first_tier(falling).select(*plain.columns))
    out = both.join(F.broadcast(names), "rule_id", "left")
    return out.select("section", "probe", F.coalesce("name", F.lit("")).alias("label"), F.lit(True).alias("counts"), "rule_id", "path", "line", F.col("line").alias("line_end"), F.trim("line_content").alias("line_content"), "match_text", F.lit("source_lines").alias("provenance"))


def _whole_matches(corpus: Corpus) -> DataFrame:
    parts = []
    for d, i, p in _probes("whole", broken(corpus.files.sparkSession)):
        hits = grep.grep_whole(corpus.files, p.pattern, p.globs)
        hits = hits.withColumn("line", F.col("line_start"))
        parts.append(hits.select(F.lit(d.id).alias("section"), F.lit(i).alias("probe"), F.lit(p.label).alias("label"), F.lit(True).alias("counts"), F.lit(f"{d.id}/{i}").alias("rule_id"), "path", "line", "line_end", F.lit("").alias("line_content"), "match_text", F.lit("source_lines").alias("provenance")))
    return _union(parts)


def _file_matches(corpus: Corpus) -> DataFrame:
    """Path probes, directories and substring gates: one pass over files, one over directories."""

    def row(d: Detector, i: int, p: Probe, counts: bool):
        return F.struct(F.lit(d.id).alias("section"), F.lit(i).alias("probe"), F.lit(p.label).alias("label"), F.lit(counts).alias("counts"), F.lit(p.snippet).alias("snippet"))

    def holds(p: Probe):
        text = F.lower("content") if p.lower else F.col("content")
        has = [F.contains(text, F.lit(h)) for h in p.has]
        inside = reduce(lambda a, b: a | b if p.any_of else a & b, has)
        for x in p.lacks:
            inside = inside & ~F.contains(text, F.lit(x))
        return glob_any(F.col("path"), p.globs) & F.coalesce(inside, F.lit(False))

    by_path = [F.when(glob_any(F.col("path"), p.globs), row(d, i, p, True)) for d, i, p in _probes("files")]
    gates = [F.when(holds(p), row(d, i, p, bool(p.snippet))) for d, i, p in _probes("gate")]
    files = corpus.files.select("path", F.explode(F.array_compact(F.array(*by_path, *gates))).alias("m"))
    by_name = [F.when(F.col("name").isin(*p.globs), row(d, i, p, True)) for d, i, p in _probes("dirs")]
    dirs = corpus.dirs.select("path", F.explode(F.array_compact(F.array(*by_name))).alias("m"))
    none = F.lit(None)
    return files.unionByName(dirs).select("m.section", "m.probe", "m.label", "m.counts", F.lit("").alias("rule_id"), "path", none.cast("int").alias("line"), none.cast("int").alias("line_end"), F.col("m.snippet").alias("line_content"), F.lit("").alias("match_text"), F.lit("file").alias("provenance"))


def matches(corpus: Corpus) -> DataFrame:
    """All evidence rows of a corpus, persisted: reducers read it several times."""
    lines = corpus.safe_lines.persist(StorageLevel.MEMORY_AND_DISK)
    every = _union([_line_matches(lines), _whole_matches(corpus), _file_matches(corpus)])
    return every.persist(StorageLevel.MEMORY_AND_DISK)


def evidence(corpus: Corpus, found: DataFrame, limit: int | None = EVIDENCE_LIMIT) -> DataFrame:
    """The first ``limit`` rows of each section's evidence, in corpus order, that prove their range.

    A rule gives its first matches only, as many as one search shows; :func:`sections` counts all.  Adds ``ordinal``,
    ``evidence_total`` (before the cut) and what proves a range: the lines of the file and its digest.
    """
    every = found.where(F.col("section").isNotNull() & F.col("counts"))
    of_rules = every.where("rule_id <> ''").withColumn("ordinal", F.lit(1))
    shown = every.where("rule_id = ''").unionByName(grep.capped(of_rules, grep.MAX_MATCHES).drop("ordinal"))
    cut = capped_evidence(shown, ["section"], [F.split("path", "/"), F.col("line"), F.col("probe")], limit)
    listed = corpus.listing.select("path", F.col("line_count").alias("source_line_count"), F.col("digest").alias("source_digest"))
    whole = cut.join(listed, "path", "left").withColumnsRenamed({"line": "line_start"})
    return accepted(whole.withColumns({"project": F.lit(None).cast("string"), "property": F.lit(None).cast("string")})).drop("project", "property")


def _dimension(spark: SparkSession) -> DataFrame:
    gone = broken(spark)
    rows = [(n, d.layer, d.id, d.title, d.kind, d.summary, d.missing, d.decides, d.structured, d.keywords, d.id in gone) for n, d in enumerate(DETECTORS)]
    return spark.createDataFrame(rows, "place int, layer string, section string, title string, kind string, template string, missing string, decides string, structured boolean, keywords string, broken boolean")


def sections(corpus: Corpus, found: DataFrame | None = None) -> DataFrame:
    """One row per section, in registry order: ``layer, section, title, kind, detected, summary, evidence_total, error``.

    A corpus without files gives every section, undetected.  A section all of whose evidence is rejected is not
    detected, and a detector that fails says so; neither touches the others.
    """
    spark = corpus.files.sparkSession
    found = matches(corpus) if found is None else found
    simple = found.where(F.col("section").isNotNull())
    per = simple.groupBy("section", "probe", "label").agg(F.count_if("counts").alias("k"))
    labels = F.transform(F.array_sort(F.collect_list(F.when(F.col("label") != "", F.struct("probe", "label", "k")))), lambda x: x)
    reduced = per.groupBy("section").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("label") != "", F.col("k"))), F.lit(0)).alias("labelled"), labels.alias("l"))
    distinct = simple.groupBy("section").agg(F.count_distinct("match_text").alias("distinct"))
    dimension = F.broadcast(_dimension(spark))
    facts = build_files.facts(corpus).persist(StorageLevel.MEMORY_AND_DISK)
    special = structured.sections(corpus, facts, found).select("section", F.col("detected").alias("s_detected"), F.col("summary").alias("s_summary"), F.col("evidence_total").alias("s_total"))

    joined = dimension.join(reduced, "section", "left").join(distinct, "section", "left").join(special, "section", "left")
    names = F.array_distinct(F.transform("l", lambda x: x["label"]))
    pieces = F.transform("l", lambda x: F.replace(x["label"], F.lit("{k}"), x["k"].cast("string")))
    text = F.split("template", "[|]")[0]
    for mark, value in (("{labels}", F.array_join(names, ", ")), ("{sorted}", F.array_join(F.array_sort(names), ", ")), ("{parts}", F.array_join(pieces, "; ")), ("{n}", F.col("n").cast("string")), ("{labelled}", F.col("labelled").cast("string")), ("{distinct}", F.col("distinct").cast("string"))):
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("")))
    text = F.when((text == "") & F.contains("template", F.lit("|")), F.split("template", "[|]")[1]).otherwise(text)
    simple_found = F.when(F.col("decides") == "labels", F.size("l") > 0).otherwise(F.coalesce("n", F.lit(0)) > 0)
    seen = F.coalesce(F.when(F.col("structured"), F.col("s_detected")).otherwise(simple_found), F.lit(False))
    total = F.coalesce(F.when(F.col("structured"), F.col("s_total")).otherwise(F.col("n")), F.lit(0))
    rejected = F.when(seen & F.col("section").isin(*structured.UNPROVEN), total).otherwise(F.lit(0))
    detected = seen & (rejected == 0) & ~F.col("broken")
    summary = F.when(F.col("broken"), F.lit("Detection unavailable")).when(seen, F.when(F.col("structured"), F.col("s_summary")).otherwise(text)).otherwise(F.col("missing"))
    error = F.when(F.col("broken"), F.lit("Detector failed")).when(rejected > 0, F.format_string("Omitted %d invalid evidence entries", rejected.cast("long")))
    return joined.select("place", "layer", "section", "title", "kind", "keywords", detected.alias("detected"), summary.alias("summary"), F.when(detected, total).otherwise(F.lit(0)).cast("long").alias("evidence_total"), error.alias("error")).orderBy("place")


def layers(found: DataFrame) -> DataFrame:
    """``layer, title, sections, detected`` of a section table."""
    titles = found.sparkSession.createDataFrame(list(LAYERS.items()), "layer string, title string")
    rolled = found.groupBy("layer").agg(F.count("*").alias("sections"), F.count_if("detected").alias("detected"))
    return F.broadcast(titles).join(rolled, "layer", "left").orderBy("layer")
