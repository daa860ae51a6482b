"""What version control says of a tree, on the driver: one row of metadata, all null where there is none."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass

TIMEOUT_S = 10
_ID = re.compile("[0-9a-f]{40}(?:[0-9a-f]{24})?")


@dataclass(frozen=True)
class Checkout:
    commit: str | None = None
    dirty: bool | None = None
    root: str | None = None


def object_id(text: str | None) -> str | None:
    """A whole object id in lower case, else null."""
    found = (text or "").strip().lower()
    return found if _ID.fullmatch(found) else None


def _ask(root: str, *words: str) -> str | None:
    """Output of a query that takes no locks and starts no monitor; null if it fails or takes too long."""
    command = ["git", "--no-optional-locks", "-c", "core.fsmonitor=false", "-C", root, *words]
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=TIMEOUT_S)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode == 0 else None


def checkout(root: str) -> Checkout:
    commit = object_id(_ask(root, "rev-parse", "HEAD"))
    if commit is None:
        return Checkout()
    top, changes = _ask(root, "rev-parse", "--show-toplevel"), _ask(root, "status", "--porcelain", "--", root)
    return Checkout(commit, None if changes is None else bool(changes.strip()), (top or "").strip() or None)


def changed_since(root: str, commit: str | None) -> int | None:
    """Files below the root that differ from a commit."""
    known = object_id(commit)
    names = _ask(root, "diff", "--name-only", known, "--", root) if known else None
    return None if names is None else sum(bool(n.strip()) for n in names.splitlines())
