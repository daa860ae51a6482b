"""Query 1 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .line_dedup import Winnow, dedup_lines

HOW = Winnow()


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), HOW)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"), F.md5(F.col("text")).alias("text_md5"))


_SPACE = "[\\x20\\x09-\\x0D]"


def _ends() -> str:
    """Lines of the window that begins at line n (from 1) of a document; null if it does not fill one."""
    cases, words = [], "words[n]"
    for k in range(1, HOW.window):
        cases.append(f"WHEN {words} >= {HOW.long_words} THEN {k}")
        words += f" + words[n + {k}]"
    return f"CASE {' '.join(cases)} WHEN n + {HOW.window - 1} <= len(words) THEN {HOW.window} END"


def _beside(sign: str, i: str, j: str) -> str:
    """Equal lines beside a window and its first place."""
    out = str(HOW.window - 1)
    for k in reversed(range(1, HOW.window)):
        out = f"CASE WHEN {i} {sign} {k} >= 1 AND {j} {sign} {k} >= 1 AND a.ls[{i} {sign} {k}] = b.ls[{j} {sign} {k}] THEN {out} ELSE {k - 1} END"
    return out


OP1_SQL = f"""
WITH t AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
l AS (SELECT doc_id, all_lines[pos + 1] AS line, pos FROM (SELECT doc_id, all_lines, unnest(range(len(all_lines))) AS pos FROM t)),
worded AS (SELECT *, len(list_filter(regexp_split_to_array(line, '{_SPACE}+'), lambda x: x <> '')) AS n_words FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT doc_id, list(line ORDER BY pos) AS ls, list(pos ORDER BY pos) AS ps, list(n_words ORDER BY pos) AS words FROM worded GROUP BY doc_id),
starts AS (SELECT doc_id, ls, words, unnest(range(1, len(ls) + 1)) AS n FROM d),
win AS (SELECT doc_id, n, k, ls[n : n + k - 1] AS own FROM (SELECT *, {_ends()} AS k FROM starts) WHERE k IS NOT NULL),
ranked AS (SELECT doc_id, n, k, row_number() OVER f AS r, first_value(doc_id) OVER f AS first_doc, first_value(n) OVER f AS m FROM win WINDOW f AS (PARTITION BY own ORDER BY doc_id, n)),
reached AS (SELECT a.doc_id, a.ps, n - {_beside('-', 'n', 'm')} AS low, n + k - 1 + {_beside('+', '(n + k - 1)', '(m + k - 1)')} AS high
    FROM ranked r JOIN d a ON a.doc_id = r.doc_id JOIN d b ON b.doc_id = r.first_doc WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(ps[low : high]) AS pos FROM reached),
listed AS (SELECT doc_id, list_sort(list(pos)) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(all_lines)::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed,
    md5(CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter(all_lines, lambda x, i: NOT list_contains(coalesce(removed, []), i - 1)), chr(10)) END) AS text_md5
FROM t LEFT JOIN listed USING (doc_id)
"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
SQL = {"op1_line_dedup": OP1_SQL}
