"""Path globs as regular expressions.

``**/`` crosses any number of directories, ``**`` anything, ``*`` and ``?`` stay inside one
component.  Brackets and braces are ordinary characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column

_TOKEN = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
_MEANING = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_pattern(glob: str) -> str:
    """The regular expression of one glob, without anchors."""
    return "".join(_MEANING.get(t) or re.sub(r"([^\w/ ])", r"\\\1", t) for t in _TOKEN.findall(glob))


def glob_any(path: Column, globs: Iterable[str]) -> Column:
    """Whether a path matches any glob: one anchored alternation, so a path appears once."""
    return path.rlike("(?s)^(?:" + "|".join(map(glob_pattern, globs)) + ")\\z")
