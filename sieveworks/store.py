"""Generations of scan results: published whole, checked on reading, refreshed only when something changed.

A generation is a folder of Parquet tables and a manifest; the pointer file is written last, so readers
see the old generation or the new one, never a part.  The state of a store is ``missing``, ``fresh``, ``stale``,
``damaged`` or ``schema_mismatch``.
"""

from __future__ import annotations

import datetime
import fcntl
import hashlib
import json
import os
import shutil
import tempfile
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .formats import status_line
from .operators import fingerprint, inventory, search
from .operators.sections import EVIDENCE_LIMIT
from .plans import scan
from .plans.registry import HIGHLIGHTS, LAYERS
from .render import digest_of, write_layers
from .sources.tree import open_tree, project_name, project_roots, read_tree
from .sources.version_control import changed_since, checkout

SCHEMA_VERSION = 4
POINTER = "current.json"


@dataclass(frozen=True)
class Status:
    state: str
    scanned_at: str | None = None
    files: int | None = None
    commit: str | None = None
    head: str | None = None
    changed: int | None = None

    @property
    def line(self) -> str:
        return status_line(**vars(self))


def open_store(spark: SparkSession, path: str, folder: str | None = None) -> Store:
    """The store of the project nearest to ``path``, which has to hold a settings script; of several the first counts, with a warning."""
    if not os.path.isdir(path):
        raise LookupError(f"no such directory: {path}")
    roots = project_roots(path)
    if not roots:
        raise LookupError(f"no settings script below {path}")
    if len(roots) > 1:
        warnings.warn(f"{len(roots)} projects below {path}; taking {roots[0] or '.'}", stacklevel=2)
    return Store(spark, os.path.join(path, roots[0]), folder)


def _write(path: Path, text: str) -> None:
    """Replace a small file in one step."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(part, path)


class Store:
    """Scan results of one source tree in one folder."""

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None):
        self.spark, self.root = spark, os.path.realpath(root)
        self.folder = Path(folder or f"{self.root}/.sieveworks")
        if Path(self.root).is_relative_to(self.folder.resolve()):
            raise ValueError("the store may not hold the tree it describes")

    @contextmanager
    def lock(self) -> Iterator[None]:
        """One writer at a time; a second one fails at once."""
        self.folder.mkdir(parents=True, exist_ok=True)
        with open(self.folder / ".lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            yield

    def _fingerprint(self, content: bool) -> str:
        listed = read_tree(self.spark, self.root, text=content)
        fields = [F.sha2(F.col("content").cast("binary"), 256)] if content else [F.col("size").cast("string"), F.col("mtime_ns").cast("string")]
        line = F.concat(F.concat_ws("\0", "path", *fields), F.lit("\n"))
        return fingerprint.bucketed_fold(listed.select("path", line.alias("l")), F.col("l"), "path").first()["digest"]

    def manifest(self) -> dict | None:
        try:
            return json.loads((self.folder / POINTER).read_text("utf-8"))
        except FileNotFoundError:
            return None
        except ValueError:
            return {}

    def _tables_valid(self, found: dict) -> bool:
        try:
            return found["digest"] == self._digest(self._table("sections", found)) and found["evidence"] == self._evidence_digest(self._table("evidence", found))
        except (AnalysisException, KeyError):
            return False

    def status(self, verify_content: bool = False) -> Status:
        """The quick fingerprint decides; where it differs, or on request, the content does."""
        found = self.manifest()
        if found is None:
            return Status("missing")
        if not found or not (self.folder / found.get("generation", "?") / "sections").is_dir():
            return Status("damaged")
        told = (found["scanned_at"], found["files"])
        if commit := found.get("commit"):
            told += (commit, checkout(self.root).commit, changed_since(self.root, commit))
        if type(found.get("schema_version")) is not int or found["schema_version"] != SCHEMA_VERSION:
            return Status("schema_mismatch", *told)
        if not self._tables_valid(found) or not self._layers_valid(found):
            return Status("damaged", *told)
        same = not verify_content and found["quick"] == self._fingerprint(False) or found["content"] == self._fingerprint(True)
        return Status("fresh" if same else "stale", *told)

    @staticmethod
    def _digest(sections: DataFrame) -> str:
        rows = [r.asDict() for r in sections.orderBy("place").collect()]
        return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    @staticmethod
    def _evidence_digest(evidence: DataFrame) -> str:
        line = F.to_json(F.struct(*sorted(evidence.columns)))
        return fingerprint.bucketed_fold(evidence.select(line.alias("l")), F.col("l"), "l").first()["digest"]

    def _layers_valid(self, found: dict) -> bool:
        """Whether the generated part of each layer's file is as it was published."""
        return all(digest_of(self.folder / "layers", layer) == d for layer, d in found.get("layers", {}).items())

    def _publish_layers(self, found: dict, fresh_headers: bool = False) -> dict:
        write_layers(self._table("sections", found), str(self.folder / "layers"), fresh_headers)
        return found | {"layers": {layer: digest_of(self.folder / "layers", layer) for layer in LAYERS}}

    def _table(self, name: str, found: dict | None = None) -> DataFrame:
        found = found or self.manifest()
        if not found:
            raise LookupError("nothing has been scanned")
        return self.spark.read.parquet(str(self.folder / found["generation"] / name))

    def refresh(self, force: bool = False, fresh_headers: bool = False, evidence_limit: int | None = EVIDENCE_LIMIT, progress: Callable[[int, int, str], None] | None = None) -> str:
        """Scan if needed; says what was done.

        ``no_op``; ``metadata_updated`` (same contents, other times); ``headers_refreshed`` (layer files anew, as
        ``fresh_headers`` asks); ``artifacts_repaired`` (layer files anew, as they were damaged); ``scanned``.
        Contents are read only where times or sizes differ, and once for a scan's fingerprint.  ``progress`` hears
        of each step: number, steps, name.
        """
        steps = ["fingerprint", "evidence", "sections", "layers"]

        def tell(step: str) -> None:
            if progress:
                progress(steps.index(step) + 1, len(steps), step)

        with self.lock():
            tell("fingerprint")
            found, quick, content = self.manifest(), self._fingerprint(False), None
            usable = bool(found) and found.get("schema_version") == SCHEMA_VERSION and found.get("evidence_limit") == evidence_limit and self._tables_valid(found)
            same = usable and not force and quick == found["quick"]
            if usable and not force and not same:
                content = self._fingerprint(True)
                same = content == found["content"]
            if same:
                damaged = not self._layers_valid(found)
                action = "headers_refreshed" if fresh_headers else "artifacts_repaired" if damaged else "metadata_updated" if quick != found["quick"] else "no_op"
                if damaged or fresh_headers:
                    found = self._publish_layers(found, fresh_headers)
                if action != "no_op":
                    _write(self.folder / POINTER, json.dumps(found | {"quick": quick}, indent=2, ensure_ascii=False))
                return action
            content = content or self._fingerprint(True)
            corpus = open_tree(self.spark, self.root)
            name = f"g-{content[:16]}-{os.getpid()}"
            tell("evidence")
            every = scan.matches(corpus)
            scan.evidence(corpus, every, evidence_limit).write.mode("overwrite").parquet(str(self.folder / name / "evidence"))
            tell("sections")
            scan.sections(corpus, every).write.mode("overwrite").parquet(str(self.folder / name / "sections"))
            if self._fingerprint(False) != quick:
                shutil.rmtree(self.folder / name)
                raise RuntimeError("the tree changed while it was scanned")
            tell("layers")
            made = {"schema_version": SCHEMA_VERSION, "generation": name, "quick": quick, "content": content, "files": corpus.files.count(), "evidence_limit": evidence_limit}
            made["project"], made["commit"] = project_name(self.spark, self.root), checkout(self.root).commit
            made["scanned_at"] = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
            made["digest"] = self._digest(self._table("sections", made))
            made["evidence"] = self._evidence_digest(self._table("evidence", made))
            made = self._publish_layers(made, fresh_headers)
            _write(self.folder / POINTER, json.dumps(made, indent=2, ensure_ascii=False))
            if found and found.get("generation") not in (None, name):
                shutil.rmtree(self.folder / found["generation"], ignore_errors=True)
            return "scanned"

    # --- readers

    def sections(self) -> DataFrame:
        return self._table("sections")

    def layers(self) -> DataFrame:
        return scan.layers(self.sections())

    def section(self, layer: str, section: str) -> dict:
        row = self.sections().where((F.col("layer") == layer) & (F.col("section") == section)).first()
        if row is None:
            raise LookupError(f"no section {layer}/{section}")
        return row.asDict()

    def evidence_page(self, section: str, cursor: str | None = None, limit: int = inventory.PAGE_DEFAULT) -> tuple[DataFrame, str | None]:
        """Evidence of one section in corpus order, and the cursor of the next page."""
        rows = self._table("evidence").where(F.col("section") == section)
        total = rows.count()
        offset, limit = inventory.checked_cursor(cursor, total), inventory.clamped(limit, inventory.PAGE_MAX)
        page = rows.orderBy("ordinal").offset(offset).limit(limit)
        return page, str(offset + limit) if offset + limit < total else None

    def search(self, query: str, limit: int = 10, layer: str | None = None) -> DataFrame:
        """BM25 over titles and search words (twice), ids, layer titles, summaries, and evidence as stored."""
        line = F.concat_ws(" ", "path", "line_content")
        shown = self._table("evidence").groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("t")))), lambda x: x["t"]), " ").alias("t"))
        titles = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])
        twice = F.concat_ws(" ", "title", "keywords")
        docs = self.sections().join(shown, "section", "left")
        docs = docs.select("layer", "section", "detected", F.concat_ws(" ", F.replace("section", F.lit("_"), F.lit(" ")), titles[F.col("layer")], twice, twice, F.col("summary"), "t").alias("text"))
        inside = F.col("layer") == layer if layer else None
        return search.search(docs, query, ["layer", "section"], "text", inventory.clamped(limit, inventory.SEARCH_MAX), detected=F.col("detected"), where=inside)

    def overview(self) -> dict:
        """The project's name, highlights that were detected, layers, and what was not found."""
        rows = {(r["layer"], r["section"]): r for r in self.sections().collect()}
        shown = {name: rows[(a, b)]["summary"] for name, a, b in HIGHLIGHTS if rows[(a, b)]["detected"]}
        return {"project": self.manifest().get("project"), "highlights": shown, "layers": [r.asDict() for r in self.layers().collect()], "undetected": [f"{a}/{b}" for (a, b), r in rows.items() if not r["detected"]]}
