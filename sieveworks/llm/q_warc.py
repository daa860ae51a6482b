"""Query 6 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import new_path, table
from .warc import Layout, read_archives, write_archives

LAYOUT = Layout()


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(spark, write_archives(pages, new_path(spark, "archives"), LAYOUT))


_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS last_id FROM h),
r AS (SELECT *, payload_bytes >= {LAYOUT.min_revisit_bytes} AND last_id IS NOT NULL AND page_id IS DISTINCT FROM last_id AS again FROM g)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::INTEGER), lambda v: {_DIGITS}), '') AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last_id END AS refers_to
FROM r
"""

QUERIES = {"op6_warc": op6_warc}
SQL = {"op6_warc": OP6_SQL}
