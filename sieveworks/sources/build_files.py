"""Facts from structured files: build scripts, settings, version catalogs, manifests, CI files.

Every parser takes a text and returns ``(kind, name, detail)`` facts in file order.  :func:`facts`
runs them over a corpus in Arrow batches; a file that cannot be parsed gives a ``failure`` fact
rather than an error.
"""

from __future__ import annotations

import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.globs import glob_any, glob_pattern
from .corpus import Corpus

Fact = tuple[str, str, str | None]

# Calls, keywords, reserved names and attributes that parsers know.
_CALL = re.compile(r"""\b(?:create|register|maybeCreate|named|getByName)\s*\(\s*["']([A-Za-z0-9_]+)["']""")
_NOT_NAMES = frozenset("if else when for while do try catch finally fun val var return it this apply also let run with forEach map filter each all configureEach matching withType".split())
_CONTAINER_ACCESS = frozenset("getByName findByName named register create maybeCreate".split())
_RESERVED_KEYS = frozenset("stages variables include default workflow".split())
_COMPONENTS = frozenset(["activity", "activity-alias", "service", "receiver", "provider"])
_ANDROID = "{http://schemas.android.com/apk/res/android}"
_LINK_PATHS = ("path", "pathPrefix", "pathPattern", "pathAdvancedPattern")
_QUOTED = re.compile(r"""["']([^"']+)["']""")


def block(text: str, name: str) -> str:
    """The braces of the first ``name {`` and what is between them; empty if there is none or it never closes."""
    start = re.search(rf"\b{re.escape(name)}\s*\{{", text)
    if not start:
        return ""
    depth = 0
    for m in re.finditer("[{}]", text[start.end() - 1 :]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[start.end() - 1 : start.end() - 1 + m.end()]
    return ""


def container_names(braces: str) -> list[str]:
    """Entries declared directly inside a container block, first seen first."""
    names: list[str] = []
    depth, since = 0, 0
    for m in chain(re.finditer("[{}]", braces), [None]):
        before = braces[since : m.start()] if m else braces[since:]
        if depth == 1 or m is None:
            calls = _CALL.findall(before)
            if m and m[0] == "{":
                bare = re.search(r"([A-Za-z_]\w*)\s*$", before, re.A)
                if calls and before.rstrip().endswith(")"):
                    names.append(calls[-1])
                elif bare and bare[1] not in _NOT_NAMES:
                    names.append(bare[1])
            else:
                names += calls
        if m:
            depth = max(0, depth + (1 if m[0] == "{" else -1))
            since = m.end()
    return list(dict.fromkeys(names))


def plugins(text: str) -> list[str]:
    inside = block(text, "plugins")
    found = re.findall(r"""id\s*\(\s*["']([^"']+)["']\s*\)""", inside) + re.findall(r"alias\s*\(\s*[\w.]+\.([^)]+)\s*\)", inside)
    return sorted({*found, *re.findall(r"""apply\s+plugin\s*:\s*["']([^"']+)["']""", text)})


def project_dependencies(text: str) -> list[str]:
    found = set(re.findall(r"""project\s*\(\s*["'](:[\w:]+)["']\s*\)""", text))
    for accessor in re.findall(r"projects((?:\.[A-Za-z0-9_]+)+)", text):
        steps = accessor.split(".")[1:]
        if not _CONTAINER_ACCESS.intersection(steps):
            found.add(":" + ":".join(steps))
    return sorted(found)


#: Include calls: in brackets over any lines; or a row with the word that is no comment, and the rows after it
#: that begin with a quote or colon, as long as each but the last ends with a comma.
_IN_BRACKETS = re.compile(r"include\s*\(([^)]*)\)")
_IN_ROWS = re.compile(r"""(?m)^[^\S\n]*(?!//|\#|\s)(?=.*include).*(?:\n[^\S\n]*["':].*,[^\S\n]*$)*(?:\n[^\S\n]*["':].*)?""")


def included_modules(text: str) -> list[str]:
    """Quoted ``:module`` paths of include calls."""
    calls = _IN_BRACKETS.findall(text) + _IN_ROWS.findall(text)
    return sorted({path for call in calls for path in _QUOTED.findall(call) if path.startswith(":")})


def script_facts(text: str) -> list[Fact]:
    return [
        *(("plugin", p, None) for p in plugins(text)),
        *(("project_dependency", p, None) for p in project_dependencies(text)),
        *(("build_type", n, None) for n in container_names(block(text, "buildTypes"))),
        *(("flavor", n, None) for n in container_names(block(text, "productFlavors"))),
    ]


def settings_facts(text: str) -> list[Fact]:
    name = re.search(r"""rootProject\.name\s*=\s*["']([^"']+)["']""", text)
    return [*([("root_name", name[1], None)] if name else []), *(("module", m, None) for m in included_modules(text))]


def _library(alias: str, value: object, versions: dict[str, str]) -> Fact | None:
    if isinstance(value, str):
        module, _, version = value.rpartition(":")
        return "library", alias, f"{module or value}\t{version}"
    if not isinstance(value, dict):
        return None
    module, group, name = (value.get(k) for k in ("module", "group", "name"))
    if not isinstance(module, str):
        if not (isinstance(group, str) and isinstance(name, str)):
            return None
        module = f"{group}:{name}"
    version = value.get("version")
    if isinstance(version, dict):
        ref, wanted = version.get("ref"), version.get("require") or version.get("prefer")
        version = versions.get(ref) if isinstance(ref, str) else wanted
    return "library", alias, f"{module}\t{version if isinstance(version, str) else ''}"


def catalog_facts(text: str) -> list[Fact]:
    """Versions, libraries (module and version in the detail), plugins and bundles of a TOML catalog."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return [("failure", "catalog", None)]

    def part(name: str) -> dict:
        return data[name] if isinstance(data.get(name), dict) else {}

    versions = {k: str(v) for k, v in part("versions").items()}
    plugin_ids = {k: v.partition(":")[0] if isinstance(v, str) else v.get("id") if isinstance(v, dict) else None for k, v in part("plugins").items()}
    return [
        *(("version", k, v) for k, v in versions.items()),
        *filter(None, (_library(k, v, versions) for k, v in part("libraries").items())),
        *(("plugin_alias", k, v) for k, v in plugin_ids.items() if isinstance(v, str)),
        *(("bundle", k, ",".join(map(str, v))) for k, v in part("bundles").items() if isinstance(v, list)),
    ]


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _attribute(element: ET.Element, name: str) -> str | None:
    return element.get(_ANDROID + name) or element.get("android:" + name)


def manifest_facts(text: str) -> list[Fact]:
    """Deep links, exported components, components that are exported only implicitly."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return [("failure", "manifest", None)]
    out: list[Fact] = []
    for element in root.iter():
        kind = _local(element.tag)
        for data in element if kind == "intent-filter" else ():
            scheme, host = _attribute(data, "scheme"), _attribute(data, "host")
            if _local(data.tag) == "data" and (scheme or host):
                port = _attribute(data, "port")
                path = next(filter(None, (_attribute(data, p) for p in _LINK_PATHS)), "")
                out.append(("deep_link", f"{scheme or '*'}://{host or '*'}{f':{port}' if port else ''}{path}", None))
        name = _attribute(element, "name") if kind in _COMPONENTS else None
        if name:
            exported = _attribute(element, "exported")
            if exported == "true":
                out.append(("exported", f"{kind} {name}", None))
            elif exported is None and any(_local(child.tag) == "intent-filter" for child in element):
                out.append(("implicit_export", f"{kind} {name}", None))
    return out


def ci_facts(text: str) -> list[Fact]:
    """Stages of the first ``stages:`` list, and keys in the first column that are no reserved words."""
    listed = re.search(r"stages:\s*\n((?:\s+-\s+\w+\n?)+)", text)
    stages = re.findall(r"-\s+(\w+)", listed[1]) if listed else []
    keys = [row.split(":")[0].strip() for row in text.splitlines() if row and row[0] not in " #" and ":" in row]
    return [*(("stage", s, None) for s in stages), *(("job", k, None) for k in keys if k and k[0] != "." and k not in _RESERVED_KEYS)]


PARSERS: list[tuple[tuple[str, ...], Callable[[str], list[Fact]]]] = [
    (("**/build.gradle.kts", "**/build.gradle"), script_facts),
    (("settings.gradle.kts", "settings.gradle"), settings_facts),
    (("gradle/libs.versions.toml",), catalog_facts),
    (("**/AndroidManifest.xml",), manifest_facts),
    ((".gitlab-ci.yml",), ci_facts),
]


def facts(corpus: Corpus) -> DataFrame:
    """``path, kind, ordinal, name, detail`` of every structured file of the corpus."""
    known = [(re.compile("|".join(map(glob_pattern, globs)), re.S), parse) for globs, parse in PARSERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                for pattern, parse in known:
                    if pattern.fullmatch(path):
                        rows += [(path, kind, i, name, detail) for i, (kind, name, detail) in enumerate(parse(text))]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "kind", "ordinal", "name", "detail"])

    chosen = corpus.files.where(glob_any(F.col("path"), [g for globs, _ in PARSERS for g in globs])).select("path", "content")
    return chosen.mapInArrow(run, "path string, kind string, ordinal int, name string, detail string")
