"""Query 3 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .quality_rules import MEASURES, RATIOS, Risk, judge

HOW = Risk()


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (F.col("quality") == 1).alias("good"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("stratum"))
    return judge(docs, good_labels(table(spark, sf_dir, "labels")), HOW)


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SOLID = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"
_RATE = HOW.alpha / len(RATIOS)


def _ratio(name: str) -> str:
    top, below = RATIOS[name]
    return f"{top}::DOUBLE / greatest({below}, 1)::DOUBLE"


_TESTS = "\nUNION ALL\n".join(
    f"SELECT stratum, '{name}' AS rule, {i} AS step, {cut} AS cut, count(*) AS n, count(*) FILTER ({_ratio(name)} > {cut}) AS k FROM held GROUP BY stratum"
    for name in RATIOS
    for i, cut in enumerate(HOW.grid)
)
_OVER = " OR ".join(f"coalesce({_ratio(name)} > (SELECT min(cut) FROM chosen c WHERE c.stratum IS NOT DISTINCT FROM m.stratum AND c.rule = '{name}'), false)" for name in RATIOS)

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, {_WORDS} AS ws, {_SOLID} AS solid, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM grams JOIN twice USING (r, g), (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, length(solid)::BIGINT AS word_chars,
    length(regexp_replace(solid, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    length(regexp_replace(solid, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(solid, '[^!]', '', 'g'))::BIGINT AS n_marks
    FROM d JOIN w USING (r) LEFT JOIN cov USING (r)),
held AS (SELECT m.* FROM m JOIN labels USING (doc_id) WHERE quality = 1),
tests AS ({_TESTS}),
tails AS (SELECT *, CASE WHEN k >= n * {_RATE} THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RATE}) + (n - i) * ln(1 - {_RATE})))) END AS p FROM tests),
ran AS (SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY step) AS worst, (SELECT count(DISTINCT coalesce(stratum, chr(0))) FROM held) AS strata FROM tails),
chosen AS (SELECT stratum, rule, min(cut) AS cut FROM ran WHERE worst <= {HOW.delta} / (strata * {len(RATIOS)}) GROUP BY stratum, rule),
v AS (SELECT m.*, (n_words < {HOW.min_words} OR 100 * n_repeat_words > {HOW.max_repeat_percent} * n_words) AS base_failed, ({_OVER}) AS over_cut FROM m)
SELECT doc_id, stratum, {', '.join(MEASURES)}, base_failed, NOT base_failed AND NOT over_cut AS kept FROM v
"""

QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL = {"op3_quality_rules": OP3_SQL}
