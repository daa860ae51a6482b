"""``python -m sieveworks scan|status|layers|overview|search|show ROOT ...``; every reader takes ``--json``.

Exit codes: 0 done, 1 not found or stale, 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .formats import evidence_lines, overview_text, section_lines, section_text
from .functions.redact import sanitize_deep, sanitize_text
from .operators.sections import EVIDENCE_LIMIT
from .plans.registry import LAYERS
from .render import write_layers
from .session import session
from .store import Store, open_store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sieveworks")
    out.add_argument("--store")
    out.add_argument("--json", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("scan", "status", "layers", "overview", "search", "show"):
        command = commands.add_parser(name)
        command.add_argument("root")
        if name == "scan":
            command.add_argument("--force", action="store_true")
            command.add_argument("--markdown")
            command.add_argument("--refresh-header", action="store_true")
            command.add_argument("--evidence-limit", type=int, default=EVIDENCE_LIMIT, help="0: no limit")
        if name == "status":
            command.add_argument("--verify-content", action="store_true")
        if name == "search":
            command.add_argument("query")
            command.add_argument("--limit", type=int, default=10)
            command.add_argument("--layer")
        if name == "show":
            command.add_argument("layer")
            command.add_argument("section", nargs="?")
            command.add_argument("--cursor")
            command.add_argument("--limit", type=int, default=100)
    return out


def answer(store: Store, args: argparse.Namespace) -> tuple[object, str, int]:
    """Data, the same as text, and the exit code."""
    if args.command == "scan":
        action = store.refresh(args.force, args.refresh_header, args.evidence_limit or None)
        if args.markdown:
            write_layers(store.sections(), args.markdown, args.refresh_header)
        found = store.status()
        return {"action": action} | vars(found), f"{action}: {found.line}", 0
    if args.command == "status":
        found = store.status(args.verify_content)
        return vars(found) | {"summary": found.line}, found.line, 0 if found.state == "fresh" else 1
    if args.command == "layers":
        rows = [r.asDict() for r in store.layers().collect()]
        return rows, "\n".join(f"{r['layer']:<20} {r['detected']}/{r['sections']}  {r['title']}" for r in rows), 0
    if args.command == "overview":
        found = store.overview()
        return found, overview_text(found, store.status().state), 0
    if args.command == "search":
        rows = [r.asDict() for r in store.search(args.query, args.limit, args.layer).collect()]
        return rows, "\n".join(f"{r['score']:8.3f}  {r['layer']}/{r['section']}  ({r['matched_terms']})" for r in rows) or "Nothing found", 0
    if not args.section:
        rows = store.sections().where(F.col("layer") == args.layer).orderBy("place")
        lines = [r["line"] for r in section_lines(rows).orderBy("place").collect()]
        if not lines:
            raise LookupError(f"no layer {args.layer}")
        return [r.asDict() for r in rows.collect()], "\n".join([f"{args.layer}  {LAYERS[args.layer]}", "", *lines]), 0
    section = store.section(args.layer, args.section)
    page, following = store.evidence_page(args.section, args.cursor, args.limit)
    shown = [r["line"] for r in evidence_lines(page).orderBy("ordinal").collect()]
    data = {"section": section, "evidence": [r.asDict() for r in page.collect()], "next_cursor": following}
    return data, section_text(section, shown, section["evidence_total"]), 0


def main(argv: list[str] | None = None) -> int:
    """Wrong use ends with 2, as argparse does; what is not there or not fresh with 1."""
    args = parser().parse_args(argv)
    try:
        data, text, code = answer(open_store(session(), args.root, args.store), args)
    except (LookupError, ValueError) as e:
        print(sanitize_text(str(e)), file=sys.stderr)
        return 1
    print(json.dumps(sanitize_deep(data), ensure_ascii=False, indent=2) if args.json else sanitize_text(text))
    return code


if __name__ == "__main__":
    sys.exit(main())
