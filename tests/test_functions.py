"""Text, glob and redaction functions."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sieveworks.functions.globs import glob_pattern
from sieveworks.functions.redact import REDACTED, mask_patterns, sanitize, sanitize_columns, sanitize_deep, sanitize_text
from sieveworks.functions.text import ancestors, markdown_escape, name_tokens, parent_path, safe_path, split_lines, without_stop_words
from sieveworks.operators.search import STOP_WORDS, query_terms


def column(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in frame.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_lines(spark):
    texts = ["", "a", "a\n", "a\n\n", "a\r\nb\rc\x0bd\x85e\u2028f", "\n"]
    assert column(spark, texts, split_lines) == [t.splitlines() for t in texts]


def test_paths(spark):
    assert column(spark, ["a/b/c", "a"], ancestors) == [["a", "a/b"], []]
    assert column(spark, ["a/b/c", "a"], parent_path) == ["a/b", ""]
    given_paths = ["a/./b//c", "a\\b", "/a", "c:/a", "a/../b", "", "a\nb", "."]
    assert column(spark, given_paths, safe_path) == ["a/b/c", "a/b", None, None, None, None, None, None]


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("**/*.kt", ["a.kt", "x/y/a.kt"], ["a.kts", "a.kt\n"]),
        ("*.gradle*", ["b.gradle", "b.gradle.kts"], ["x/b.gradle"]),
        ("**/docs/**/*", ["docs/a", "x/docs/y/z"], ["docs", "adocs/a"]),
        ("a?[b]{c}.t", ["ax[b]{c}.t"], ["a/[b]{c}.t", "axb.t"]),
        ("**/*gradle*", ["gradlew", "x/gradle.properties"], ["gradle/x"]),
    ],
)
def test_globs(glob, yes, no):
    pattern = re.compile(glob_pattern(glob), re.S)
    assert all(pattern.fullmatch(p) for p in yes) and not any(pattern.fullmatch(p) for p in no)


def test_tokens(spark):
    names = ["testInstrumentationRunner", "libs.versions.toml", "HTTPServer :core:network", "", None, "é9aB"]
    expected = [["testinstrumentationrunner", "test", "instrumentation", "runner"], ["libs", "versions", "toml"], ["httpserver", "http", "server", "core", "network"], [], [], ["9ab", "9a", "b"]]
    assert column(spark, names, name_tokens) == expected
    assert query_terms("where is the HTTPServer") == ["httpserver", "http", "server"] and query_terms("where is the") == ["where", "is", "the"]
    assert column(spark, [["the", "di", "di"], ["the"]], lambda c: without_stop_words(c, STOP_WORDS), "array<string>") == [["di", "di"], ["the"]]


def test_markdown(spark):
    assert column(spark, ["a<b>&_c_", "# x\n- y\n1. z\n 2) w", "[l](`m`)*"], markdown_escape) == ["a&lt;b&gt;&amp;\\_c\\_", "\\# x\n\\- y\n1\\. z\n 2\\) w", "\\[l\\](\\`m\\`)\\*"]


SECRETS = [
    'val apiKey = "abc123"',
    "password: hunter2",
    'API_TOKEN: String = "x" + "y"',
    "https://user:pw@host/x",
    "https://h/x?token=abc&b=1",
    "Authorization: Basic abc",
    'buildConfigField("String", "SECRET_NAME", "\\"v\\"")',
    "eyJhbGciOi.eyJzdWIi.c2ln",
    '"QUJDREVGR0hJSktMTU5PUFFSU1RVVg=="',
    "Bearer abc.def-1",
    "id 123e4567-e89b-12d3-a456-426614174000",
    "'0123456789abcdef0123456789abcdef'",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
    '<string name="api_key">value</string>',
    "client_secret: |\n  line one\n  line two\nnext: 1",
]
HARMLESS = ["tokenCount = 5", "val secret = null", "password = readPassword()", "a plain sentence", "timeout: 30", "https://host/path?x=1"]


def test_sanitize_masks_and_keeps():
    for text in SECRETS:
        masked = sanitize_text(text)
        assert REDACTED in masked and masked.count("\n") == text.count("\n"), text
        assert sanitize_text(masked) == masked, text
    for text in HARMLESS:
        assert sanitize_text(text) == text
    assert sanitize_text('secret = listOf(\n "a",\n "b"\n)\nnext = 1') == f"secret = {REDACTED}\n\n\n\nnext = 1"
    assert sanitize_text(None) is None and sanitize_text("") == ""


MASKED = [
    f'val apiKey = "{REDACTED}"',
    f"password: {REDACTED}",
    f'API_TOKEN: String = "{REDACTED}"',
    f"https://{REDACTED}@host/x",
    f"https://h/x?token={REDACTED}",  # an assignment comes first
    f"Authorization: {REDACTED}",
    f'buildConfigField("String", "SECRET_NAME", "{REDACTED}")',
    REDACTED,
    f'"{REDACTED}"',
    f"Bearer {REDACTED}",
    f"id {REDACTED}",
    f"'{REDACTED}'",
    f"{REDACTED}\n\n",
    f'<string name="api_key">{REDACTED}</string>',
    f"client_secret: {REDACTED}\n\n\n",
]
#: Where the value of an assignment ends.
ENDS = {
    "token = a\nb = 1": f"token = {REDACTED}\nb = 1",
    "token = a +\n b\nc": f"token = {REDACTED}\n\nc",
    "token = a\n  + b\nc": f"token = {REDACTED}\n\nc",
    "f(token = (a, b), c)": f"f(token = {REDACTED}, c)",
    "token = a # why": f"token = {REDACTED} # why",
    "token = 'a;b'; x": f"token = '{REDACTED}'; x",
    'token = """a\n"b" """\nx': f'token = """{REDACTED}\n"""\nx',
    "token = abc'd'": f"token = {REDACTED}'d'",
    "tokenTimeout = 5": "tokenTimeout = 5",
    "token = 5": f"token = {REDACTED}",
}


def test_sanitize_exactly():
    assert [sanitize_text(t) for t in SECRETS] == MASKED
    assert {t: sanitize_text(t) for t in ENDS} == ENDS


def test_sanitize_deep(spark):
    nested = {"a": ["token=abcdef", 1, None, {"b": "password: x1"}], "token=k": True}
    assert sanitize_deep(nested) == {"a": [f"token={REDACTED}", 1, None, {"b": f"password: {REDACTED}"}], "token=k": True}
    rows = spark.createDataFrame([(1, "token=abcdef", ["password: x1", None], {"k": ("Bearer abc", 2)}), (2, None, None, None)], "i int, t string, l array<string>, m map<string,struct<s:string,n:int>>")
    got = sanitize_columns(rows).orderBy("i").collect()
    assert got[0].asDict(True) == {"i": 1, "t": f"token={REDACTED}", "l": [f"password: {REDACTED}", None], "m": {"k": {"s": f"Bearer {REDACTED}", "n": 2}}}
    assert tuple(got[1]) == (2, None, None, None)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="tokenSECRET=:\"'(){}\n ,;+#x1", max_size=60))
def test_sanitize_keeps_lines(text):
    assert sanitize_text(text).count("\n") == text.count("\n")


def test_sanitize_column(spark):
    assert column(spark, [*SECRETS, None, ""], sanitize) == [*map(sanitize_text, SECRETS), None, ""]
    assert column(spark, ["x Bearer abc 'y'"], mask_patterns) == [f"x Bearer {REDACTED} 'y'"]
