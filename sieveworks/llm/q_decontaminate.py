"""Query 2 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .decontaminate import MISMATCH, Seeds, contamination

HOW = Seeds()


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), HOW)
    return out.select("doc_id", "contaminated", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), "overlap")


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D.,;:!?\"()|]+'), lambda w: w <> '')"


#: Whatever a run or a short item that counts looks like, so many words of it in a row are equal.
_GRAM = 4


def _grams(source: str, key: str, n: int, condition: str) -> str:
    taken = " || ' ' || ".join(f"ws[i + {p + 1}]" for p in range(n))
    return f"SELECT {key}, i, {n} AS gram, {taken} AS seed FROM (SELECT {key}, ws, unnest(range(len(ws) - {n - 1})) AS i FROM {source} WHERE {condition})"


def _all_grams(source: str, key: str, conditions: list[str]) -> str:
    return " UNION ALL ".join(_grams(source, key, n, c) for n, c in enumerate(conditions, 1))


_EXACT = [f"len(ws) = {n}" for n in range(1, _GRAM)] + [f"len(ws) >= {_GRAM}"]
_ASKED = [f"EXISTS (FROM b WHERE len(b.ws) = {n})" for n in range(1, _GRAM)] + ["true"]

#: Every alignment that shares four words in a row is scored; no mask comes in.
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
ds AS ({_all_grams('d', 'r', _ASKED)}), bs AS ({_all_grams('b', 'item_id', _EXACT)}),
hits AS (SELECT DISTINCT ds.r, bs.item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (gram, seed)),
aligned AS (SELECT h.r, h.item_id, len(b.ws) AS n,
    list_transform(range(greatest(0, -shift), least(len(b.ws), len(d.ws) - shift)), lambda j: (d.ws[j + shift + 1] = b.ws[j + 1])::INT) AS same
    FROM hits h JOIN d USING (r) JOIN b ON b.item_id = h.item_id),
scored AS (SELECT r, item_id, n, list_reduce(list_transform(same, lambda s: {{'score': s, 'equal': s, 'best': s}}),
    lambda a, x: {{'score': CASE WHEN a.score + x.score * {MISMATCH + 1} - {MISMATCH} >= 0 THEN a.score + x.score * {MISMATCH + 1} - {MISMATCH} ELSE 0 END,
        'equal': CASE WHEN a.score + x.score * {MISMATCH + 1} - {MISMATCH} >= 0 THEN a.equal + x.equal ELSE 0 END,
        'best': greatest(a.best, CASE WHEN a.score + x.score * {MISMATCH + 1} - {MISMATCH} >= 0 THEN a.equal + x.equal ELSE 0 END)}}).best AS best FROM aligned),
held AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items, max(best) AS overlap
    FROM scored WHERE best >= least(n, {HOW.min_overlap}) GROUP BY r)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, '') AS items, coalesce(overlap, 0)::BIGINT AS overlap
FROM d LEFT JOIN held USING (r)
"""

QUERIES = {"op2_decontaminate": op2_decontaminate}
SQL = {"op2_decontaminate": OP2_SQL}
