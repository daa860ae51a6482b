"""Query 10 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .url_filter import SUFFIXES, Reputation, UrlRule, filter_urls

#: The rules of the query, (host, path, verdict).
RULES = [
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
]
HOW = Reputation()


def outcomes(labels: DataFrame) -> DataFrame:
    """A page is bad if the label with its id says low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), outcomes(table(spark, sf_dir, "labels")), RULES, HOW)


_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
    for r in sorted(RULES, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
)
_VERDICTS = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in RULES)
_PAIRS = ", ".join(f"'{s}'" for s in SUFFIXES)


def _level(name: str, counts: str, parent: str) -> str:
    return f"""
{name}_s AS (SELECT 1 / least({HOW.max_rho}, greatest({HOW.min_rho}, coalesce(
    (sum((k - n * {parent}) * (k - n * {parent})) - sum(n * {parent} * (1 - {parent}))) / nullif(sum(n * (n - 1) * {parent} * (1 - {parent})), 0), {HOW.min_rho}))) - 1 AS s FROM {counts}),
{name}_m AS (SELECT *, CASE WHEN n > 0 THEN mean * (1 - mean) / (n + s + 1) ELSE ({parent} * (1 - {parent}) + s * {parent}_var) / (s + 1) END AS var
    FROM (SELECT c.*, s, (k + s * {parent}) / (n + s) AS mean FROM {counts} c CROSS JOIN {name}_s))"""


#: Steps of the integral; it runs from so far below that nothing is left there.
_STEPS = 20_000
_LOW = "(ln(x / (1 - x)) - 60 - 40 / a)"
_AT = f"({_LOW} + (ln(x / (1 - x)) - {_LOW}) * i / {_STEPS})"
_DENSITY = f"exp(lgamma(a + b) - lgamma(a) - lgamma(b) - a * ln(1 + exp(-{_AT})) - b * ln(1 + exp({_AT})))"
_CDF = f"list_sum(list_transform(range({_STEPS + 1}), lambda i: {_DENSITY} * CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) * (ln(x / (1 - x)) - {_LOW}) / {3 * _STEPS}"


OP10_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM u),
split AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
lab AS (SELECT doc_id AS page_id, (quality = 0 OR toxic = 1) AS bad FROM labels),
counts AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad::INT), 0)::DOUBLE AS k, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS parts
    FROM split LEFT JOIN lab USING (page_id) GROUP BY host),
named AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]*)?$') THEN ''
    WHEN array_to_string(parts[-2:], '.') IN ({_PAIRS}) THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM counts),
hosts AS (SELECT host, n, k, suffix, CASE WHEN suffix = '' THEN array_to_string(parts, '.')
    ELSE array_to_string(parts[greatest(1, len(parts) - len(string_split(suffix, '.'))):], '.') END AS domain FROM named),
rate AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS parent, coalesce(sum(n), 0) AS labelled FROM hosts),
total AS (SELECT *, parent * (1 - parent) / (labelled + 3) AS parent_var FROM rate),
suf AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(parent) AS parent, any_value(parent_var) AS parent_var FROM hosts CROSS JOIN total GROUP BY suffix),
{_level('suf', 'suf', 'parent')},
dom AS (SELECT h.domain, sum(h.n) AS n, sum(h.k) AS k, any_value(m.mean) AS parent, any_value(m.var) AS parent_var FROM hosts h JOIN suf_m m USING (suffix) GROUP BY h.domain, h.suffix),
{_level('dom', 'dom', 'parent')},
hst AS (SELECT h.host, h.n, h.k, m.mean AS parent, m.var AS parent_var FROM hosts h JOIN dom_m m USING (domain)),
{_level('hst', 'hst', 'parent')},
posterior AS (SELECT host, mean * (mean * (1 - mean) / var - 1) AS a0, (1 - mean) * (mean * (1 - mean) / var - 1) AS b0 FROM hst_m),
sided AS (SELECT host, far, CASE WHEN far THEN b0 ELSE a0 END AS a, CASE WHEN far THEN a0 ELSE b0 END AS b, CASE WHEN far THEN {1 - HOW.max_bad} ELSE {HOW.max_bad}::DOUBLE END AS x FROM (SELECT *, {HOW.max_bad} > (a0 + 1) / (a0 + b0 + 2) AS far FROM posterior)),
-- the integral of the density by Simpson's rule in the log odds, where it is smooth
doubts AS (SELECT host, far, {_CDF} AS p FROM sided),
blocked AS (SELECT host FROM doubts WHERE CASE WHEN far THEN 1 - p ELSE p END < {HOW.doubt} AND (SELECT labelled FROM total) > 0),
ruled AS (SELECT page_id, host, path, CASE {_FITS} END AS rule FROM split)
SELECT page_id, host, path, rule, CASE rule {_VERDICTS} ELSE CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END END AS verdict FROM ruled
"""

QUERIES = {"op10_url_filters": op10_url_filters}
SQL = {"op10_url_filters": OP10_SQL}
