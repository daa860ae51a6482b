"""Column functions on texts and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that end a line (CR LF counts as one end).
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines of a text; the end of the last line opens no further line, an empty text has none."""
    parts = F.split(text, LINE_ENDS)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def strip(text: Column) -> Column:
    """Without white space at both ends, all of Unicode's."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def path_parts(path: Column) -> Column:
    """Components of a path: the sort key of the corpus order."""
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Path without its last component; empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest last."""
    return let(path_parts(path), lambda p: F.transform(F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(p, 1, i), "/")))


def safe_path(path: Column) -> Column:
    """A relative path with forward slashes and no empty or ``.`` parts; null where it is not safe.

    Unsafe: empty, absolute, with a drive or colon, a parent step, or a control character.
    """
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = path.rlike("[\\x00-\\x1f\\x7f]") | slashed.startswith("/") | F.contains(path, F.lit(":")) | F.exists(parts, lambda p: p == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def name_tokens(text: Column) -> Column:
    """Identifier-aware tokens: each run of letters and digits in lower case, then its camel parts if several.

    Camel boundaries are marked and letters lowered in the whole text at once; only texts with a
    boundary are looked at run by run.
    """
    mark = "\x01"
    known = F.translate(F.coalesce(text, F.lit("")), mark, " ")
    marked = F.regexp_replace(F.regexp_replace(known, "([a-z0-9])([A-Z])", f"$1{mark}$2"), "([A-Z])([A-Z][a-z])", f"$1{mark}$2")
    low = F.translate(marked, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def parts(run: Column) -> Column:
        return F.when(F.contains(run, F.lit(mark)), F.concat(F.array(F.translate(run, mark, "")), F.split(run, mark))).otherwise(F.array(run))

    def tokens(whole: Column) -> Column:
        runs = F.array_remove(F.split(whole, f"[^a-z0-9{mark}]+"), "")
        return F.when(F.contains(whole, F.lit(mark)), F.flatten(F.transform(runs, parts))).otherwise(runs)

    return let(low, tokens)


def without_stop_words(tokens: Column, stop: list[str]) -> Column:
    """Tokens that are no stop words, or all of them if every one is."""
    kept = F.array_except(F.array_distinct(tokens), F.array(*[F.lit(s) for s in stop]))
    return F.when(F.size(kept) > 0, F.filter(tokens, lambda t: F.array_contains(kept, t))).otherwise(tokens)


def markdown_escape(text: Column) -> Column:
    """Text that Markdown shows as it is: markup characters escaped, block openers at line starts too."""
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    out = F.regexp_replace(out, "([\\\\`*_\\[\\]])", "\\\\$1")
    out = F.regexp_replace(out, "(?m)^(\\s*)([#+-])", "$1\\\\$2")
    return F.regexp_replace(out, "(?m)^(\\s*[0-9]+)([.)])", "$1\\\\$2")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
