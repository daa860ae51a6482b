"""Texts that a reader sees: status line, overview, layer lists, sections with located evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What a status line says of each state; {why} is the reason, if one is known.
STATES = {
    "missing": "Nothing has been scanned; run a scan",
    "schema_mismatch": "The stored scan has another schema; run a scan",
    "damaged": "The stored scan is incomplete or damaged; run a scan",
    "fresh": "The scan is up to date",
    "stale": "The scan is out of date; run a scan",
}


def status_line(state: str, scanned_at: str | None = None, files: int | None = None, commit: str | None = None, head: str | None = None, changed: int | None = None) -> str:
    """One line; the time, files and commits only where the state lets them mean something."""
    parts = [STATES[state]]
    if state in ("fresh", "stale"):
        built = commit and ", ".join([f"built at {commit[:12]}", *([f"HEAD {head[:12]}"] if head and head != commit else []), *([f"{changed} files changed since"] if changed else [])])
        parts += [p for p in (scanned_at and f"scanned {scanned_at}", f"{files} files", built) if p]
    return ", ".join(parts)


def section_lines(sections: DataFrame) -> DataFrame:
    """``layer, place, line``: ``[+]`` or ``[-]``, the id and the summary."""
    mark = F.when(F.col("detected"), F.lit("+")).otherwise(F.lit("-"))
    return sections.select("layer", "place", F.format_string("[%s] %-32s %s", mark, F.col("section"), F.col("summary")).alias("line"))


def location() -> Column:
    """Where an evidence row stands: lines of a file, a file, or a property of a build model's project."""
    lines = F.when(F.col("line_start") == F.col("line_end"), F.format_string("%s:%d", "path", "line_start")).otherwise(F.format_string("%s:%d-%d", "path", "line_start", "line_end"))
    return F.when(F.col("provenance") == "source_lines", lines).otherwise(F.concat("path", F.lit(" (file)")))


def evidence_lines(evidence: DataFrame) -> DataFrame:
    """``section, ordinal, line``: the place, two blanks, the text there."""
    return evidence.select("section", "ordinal", F.concat(location(), F.lit("  "), F.coalesce("line_content", F.lit(""))).alias("line"))


def section_text(section: dict, shown: list[str], total: int) -> str:
    label = "Error" if section["error"] else "Detected" if section["detected"] else "Not found"
    out = [f"{section['title']} ({section['section']})", f"{label}: {section['error'] or section['summary']}"]
    if shown:
        out += ["", *(f"  {line}" for line in shown), *([f"  ... {total - len(shown)} more"] if total > len(shown) else [])]
    return "\n".join(out)


def overview_text(overview: dict, state: str) -> str:
    width = max(map(len, overview["highlights"]), default=0)
    shown = [f"  {name:<{width}}  {said}" for name, said in overview["highlights"].items()]
    layers = [f"  {x['layer']:<20} {x['detected']}/{x['sections']} detected" for x in overview["layers"]]
    return "\n".join([f"{overview['project']} ({state})", "", *shown, "", *layers])
